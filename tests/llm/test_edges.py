"""Long texts, repeated rows, null ids, empty tables and clashing names, where the operators' own tests have none of these."""

import hashlib
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from factloom.llm import jaccard, media, pii, token_counts


def twice(spark, text):
    rows = [(1, text, "a", 1), (1, text, "a", 1), (None, text, None, None), (2, None, "b", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n_bytes int")


LONG = ("Mail ann@mail.example.com or +1 (628) 555-0193 about 192.0.2.7; " + "the words of a long text go on and on " * 12) * 4_000


def test_media_of_megabytes(spark):
    assert len(LONG) > 2_000_000
    got = media.media_features(twice(spark, LONG)).collect()
    assert len(got) == 4 and len({(r.media_sha256, r.pcm_sha256, r.feature) for r in got if r.n_bytes}) == 1
    data = LONG.encode()
    payload = data + b"\xff" * (-len(data) % 576)
    assert got[0].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[0].tail_crc32 == zlib.crc32(payload[-32:])
    stored = {r.doc_id: bytes(r.media) for r in media.store_media(twice(spark, "short text")).collect()}
    own = media.media_features(twice(spark, "short text")).collect()[0]
    sound = media.pcm_file(stored[1])
    assert (own.pcm_bytes, own.pcm_sha256) == (len(sound), hashlib.sha256(sound).hexdigest()) and own.feature.endswith(f"{zlib.crc32(sound):08x}")


def test_personal_data_of_megabytes(spark):
    got = pii.detect(twice(spark, LONG)).collect()
    assert len(got) == 4 and [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got] == [(4000, 4000, 0, 4000)] * 3 + [(0, 0, 0, 0)]
    assert got[0].spans == got[1].spans == got[2].spans and got[0].spans.startswith("email:5:25,")


def test_token_counts_of_megabytes(spark):
    tokenizers = pytest.importorskip("tokenizers")
    n = len(tokenizers.Tokenizer.from_file(token_counts.default_vocabulary()).encode(LONG, add_special_tokens=False).ids)
    got = token_counts.count_tokens(twice(spark, LONG)).collect()
    assert [r.n_tokens for r in got] == [n, n, n, 0]


def test_jaccard_of_megabytes(spark):
    text = " ".join(f"w{k * k % 100_003}" for k in range(300_000))
    rows = [(5, text), (3, text + " end"), (9, " ".join(f"v{k}" for k in range(200_000))), (9, None)]
    got = sorted((r.doc_id, r.component_id, r.n_shingles > 0) for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3, True), (5, 3, True), (9, 9, False), (9, 9, True)]


def _tables(path, rows, more):
    names = ["doc_id", "text", "lang", "source", "n_chars", *more]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), *[pa.int64()] * len(more)]
    pq.write_table(pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}), path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32()), "toxic": pa.array([], pa.int32())}), path / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), path / "benchmark.parquet")


def test_the_pipeline_over_empty_tables(spark, tmp_path):
    _tables(tmp_path, [], [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and out.columns == ["doc_id", "ids"]


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(40))
    more = ["__toxic", "__out", "__hit", "__kept", "__sid", "m"]
    rows = [(1, text, "en", "s", 9, *range(6)), (1, text, "en", "s", 9, *range(6)), (2, text + " x", "en", "s", 9, *range(6)), (3, None, None, None, None, *range(6)), (None, "lost", "en", "s", 4, *range(6))]
    _tables(tmp_path, rows, more)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        names = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
        docs.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
    kept = docs.collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 3] and all(r["__toxic"] == 0 and r["m"] == 5 for r in kept)
