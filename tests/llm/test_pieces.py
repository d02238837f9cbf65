"""SentencePiece codec: lanes, commits, very long texts, empty tables and repeated rows."""

import random

import pyarrow.parquet as pq
import pytest

from factloom.llm import sentencepieces as S

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=S.default_model())


@pytest.fixture
def fresh():
    c = S.PieceCodec(S.default_model())
    assert c.commits == 0
    return c


def ids(c, texts):
    return [list(S._ints(x)) for x in c.encode_all(texts)]


def test_documents_are_committed_piece_by_piece_and_equal_the_library(fresh, library):
    texts = pq.read_table(DOCUMENTS, columns=["text"])["text"].to_pylist()
    assert ids(fresh, texts) == [library.encode(t or "") for t in texts]
    assert fresh.commits > len(texts)  # new words, each committed at its end


def test_long_stretches_are_committed_by_their_survivors(fresh, library):
    r = random.Random(5)
    run = "".join(r.choice(["tion", "the", "ing", "er", "on", "a", "st"]) for _ in range(20_000))
    before = fresh.commits
    assert ids(fresh, [run])[0] == library.encode(run)
    assert fresh.commits - before > 1000  # one stretch, no boundary that holds all paths by itself
    window = [len(x) for x in (fresh.segments([run[i : i + 50] for i in range(0, len(run), 50)]),) for x in x]
    assert sum(window) == len(run)


def test_texts_of_megabytes_in_blocks(fresh, library):
    r = random.Random(6)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 12))) for _ in range(3000)]
    text = " ".join(r.choice(words) for _ in range(300_000)) + "  \n" + "é" * 1000 + "▁▁ x" + "z" * 300_000 + " end "
    assert len(text) > 2_000_000
    assert ids(fresh, [None, text, ""]) == [[], library.encode(text), []]
    assert fresh.decode(ids(fresh, [text])[0]) == text.replace("▁", " ")


def test_a_full_memo_and_full_pair_tables_change_nothing(monkeypatch, library):
    monkeypatch.setattr(S, "MEMO_LIMIT", 40)
    monkeypatch.setattr(S, "PAIR_LIMIT", 64)
    monkeypatch.setattr(S, "SLICE", 500)
    c, texts = S.PieceCodec(S.default_model()), pq.read_table(DOCUMENTS, columns=["text"])["text"].to_pylist()[:60]
    assert ids(c, texts) == [library.encode(t or "") for t in texts]
    assert len(c.memo) <= 40 and len(c.older) <= 40


def test_empty_tables_repeated_rows_and_null_ids(spark):
    schema = "doc_id long, text string, ids string, n_ids int"  # columns that clash with the results'
    empty = spark.createDataFrame([], schema)
    assert S.encode_pieces(empty).collect() == [] and S.piece_digest(empty).collect() == []
    assert S.decode_pieces(spark.createDataFrame([], "doc_id long, ids array<int>")).collect() == []
    rows = spark.createDataFrame([(1, "one two", "a", 1), (1, "one two", "a", 1), (None, "one two", None, None), (None, None, None, None)], schema)
    got = sorted((r.doc_id is None, tuple(r.ids)) for r in S.encode_pieces(rows).collect())
    assert len(got) == 4 and got[0] == got[1] and {g[1] for g in got if g[0]} == {(), got[0][1]}
    assert S.decode_pieces(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text is None
