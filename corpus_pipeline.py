"""A corpus pipeline of five stages; run() applies them to documents.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns a DataFrame
that is written as Parquet and reread as the next stage's docs. All but the last keep the columns of
documents; the last returns the piece ids. Counted as part of factloom.llm.

Empty tables give empty tables; null and empty texts and null ids pass all filters; a row that occurs again with its id and text
is one document and stays once (ngram_jaccard); further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontaminate, jaccard, pii, sentencepieces, toxicity
from factloom.llm.common import load, materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, trained on the labelled ones, doesn't reject; null ids stay in."""
    return toxicity.accepted(docs, toxicity.fit_toxicity(docs, load(spark, sf_dir, "labels")))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that with the smallest id."""
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in every text; n_chars follows the text."""
    return pii.mask(docs, length="n_chars" if "n_chars" in docs.columns else None)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the text's piece ids."""
    return sentencepieces.encode_pieces(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("sentencepieces", sentencepiece_stage),
]

#: The classifier and the random field can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
