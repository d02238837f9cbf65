"""Benchmark decontamination (5, native): size-partitioned MinHash containment search.

Items and documents are sets of hashed 5-word shingles (lower case; with fewer words the whole sequence
is one). Items are partitioned by size into classes of a factor of two. Of each item a bottom-k MinHash
sketch is kept, its k fixed by the class: k = slack(upper size of the class) + 1, where slack(n) is how
many of n shingles a document may miss. A document that contains at least THRESHOLD of the item misses
at most slack(n) of the sketch, so it hits the rest: the search has no false negatives. Candidates are
then verified by exact containment: the texts of the document's and the item's shingles are compared,
not their hashes. Only DataFrame functions are used.

Null and empty items match nothing, null and empty documents hold nothing; repeated items or documents
with one id count once, with the union of their shingles; equal hashes tie on the hash itself; empty
tables give no rows; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import load, materialize

WORDS, PERCENT = 5, 75
#: Rows of (hash, item) that are broadcast at most; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def _over_words(text: Column, shown, kind: str, n: int) -> Column:
    """shown(words) of each of the text's n-word shingles, with repeats; kind is the result's element type."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def each(w: Column) -> Column:
        own = F.when(F.size(w) == 0, F.array().cast(f"array<{kind}>")).when(F.size(w) < n, F.array(shown(w)))
        return own.otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: shown(F.slice(w, i, n))))

    # Bound as a lambda's variable, the words are split once per text; written out, once per shingle.
    return F.element_at(F.transform(F.array(words), each), 1)


def shingles(text: Column, n: int = WORDS) -> Column:
    """Hashes of the text's n-word shingles (with repeats)."""
    return _over_words(text, lambda w: F.xxhash64(w), "bigint", n)


def shingle_texts(text: Column, n: int = WORDS) -> Column:
    """The n-word shingles themselves (with repeats)."""
    return _over_words(text, lambda w: F.concat_ws(" ", w), "string", n)


def item_table(items: DataFrame, key: str = "item_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Rows item_id, h, s (the shingle), n (shingles of the item), need (shared at least), k (sketch size), rank of h in the item."""
    rows = items.select(F.col(f"`{key}`").alias("item_id"), F.explode(shingle_texts(F.col(f"`{text}`"))).alias("s")).distinct()
    rows = rows.select("item_id", "s", F.xxhash64(F.split("s", " ")).alias("h"))
    own = W.partitionBy("item_id")
    sized = rows.select("item_id", "h", "s", F.count("*").over(own).alias("n"), F.row_number().over(own.orderBy("h", "s")).alias("rank"))
    upper = F.pow(F.lit(2), F.floor(F.log2("n")) + 1).cast("long") - 1
    slack = lambda n: n - F.ceil(n * percent / 100)
    return sized.select("item_id", "h", "s", "n", "rank", F.ceil(F.col("n") * percent / 100).alias("need"), F.least(F.col("n"), slack(upper) + 1).alias("k"))


def _hinted(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Pairs doc_id, item_id, n_item, n_shared of documents that contain at least percent of an item's shingles."""
    table = materialize(item_table(items, item_key, item_text, percent))
    size = table.count()
    sketch = table.where("rank <= k").select("item_id", "h", (F.least("k", "n") - (F.col("n") - F.col("need"))).alias("hits"))
    every = docs.select(F.col(f"`{key}`").alias("doc_id"), F.explode(shingles(F.col(f"`{text}`"))).alias("h"))
    found = every.join(_hinted(sketch, size), "h").groupBy("doc_id", "item_id").agg(F.countDistinct("h").alias("got"), F.first("hits").alias("hits"))
    candidates = materialize(found.where("got >= hits").select("doc_id", "item_id"))
    n = candidates.count()
    texts = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(_hinted(candidates, n), "doc_id")
    whole = table.groupBy("item_id").agg(F.collect_list("s").alias("own"), F.first("n").alias("n_item"), F.first("need").alias("need"))
    pairs = texts.join(_hinted(whole, size), "item_id")
    shared = pairs.select("doc_id", "item_id", "n_item", "need", F.array_intersect(shingle_texts(F.col("text")), F.col("own")).alias("shared"))
    # Rows of one id count as one document.
    counted = shared.groupBy("doc_id", "item_id", "n_item", "need").agg(F.size(F.array_distinct(F.flatten(F.collect_list("shared")))).alias("n_shared"))
    return counted.where("n_shared >= need").select("doc_id", "item_id", F.col("n_item").cast("long"), F.col("n_shared").cast("long"))


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that contain no item; rows and columns otherwise as they were."""
    hit = materialize(contained(docs, items, key, text).select("doc_id").distinct())
    n, hit = hit.count(), hit.withColumnRenamed("doc_id", "__hit")
    return docs.join(_hinted(hit, n), F.col(f"`{key}`") == hit["__hit"], "left_anti")


def op5_decontamination(spark, sf_dir):
    return contained(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


_SHINGLES = """SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM ({})"""
_DOC = _SHINGLES.format("SELECT doc_id AS id, regexp_extract_all(lower(text), '[^ \\t-\\r]+') AS w FROM documents")
_ITEM = _SHINGLES.format("SELECT item_id AS id, regexp_extract_all(lower(text), '[^ \\t-\\r]+') AS w FROM benchmark")
ORACLE = f"""
WITH d AS ({_DOC}), i AS ({_ITEM}), n AS (SELECT id, count(*) AS n FROM i GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, CAST(any_value(n.n) AS BIGINT) AS n_item, CAST(count(*) AS BIGINT) AS n_shared
FROM d JOIN i USING (s) JOIN n ON n.id = i.id GROUP BY d.id, i.id HAVING 100 * count(*) >= 75 * any_value(n.n)
"""
