"""The pipeline's stages on a small corpus, and the registered queries' names."""

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from factloom.llm import queries


def test_stages_keep_what_they_should(spark, tmp_path):
    clean = [f"clean{i} " + " ".join(f"c{i}x{k}" for k in range(60)) for i in range(40)]
    near = [clean[0], clean[0] + " tail"]
    toxic = [" ".join(f"t{i}y{k} vile{'ness' if k % 9 else ''}" for k in range(40)) for i in range(40)]
    item = " ".join(f"item{k}" for k in range(30))
    texts = [*clean, *near, *toxic, clean[1] + " " + item + " end", "mail me at ann@mail.example.com please", None, ""]
    n = len(texts)
    documents = pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": texts, "lang": ["en"] * n, "source": ["s"] * n, "n_chars": pa.array([len(t or "") for t in texts], pa.int64())})
    labels = pa.table({"doc_id": pa.array(range(82), pa.int64()), "quality": pa.array([1] * 82, pa.int32()), "toxic": pa.array([int(42 <= i) for i in range(82)], pa.int32())})
    pq.write_table(documents, tmp_path / "documents.parquet")
    pq.write_table(labels, tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": [item]}), tmp_path / "benchmark.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == documents.column_names, name
            docs.write.parquet(str(tmp_path / f"out{k}"))
            docs = spark.read.parquet(str(tmp_path / f"out{k}"))
            kept = {r.doc_id: r.text for r in docs.collect()}
            if name == "toxicity":
                assert not set(kept) & set(range(42, 82)) and set(range(42)) <= set(kept)
            if name == "ngram_jaccard":
                assert 0 in kept and not {40, 41} & set(kept) and {*range(1, 40), 84, 85} <= set(kept)
            if name == "decontamination":
                assert 82 not in kept and set(range(40)) <= set(kept)
            if name == "personal_data":
                assert kept[83] == "mail me at <email> please"
    assert set(docs.columns) == {"doc_id", "ids"}


def test_every_operator_has_its_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
