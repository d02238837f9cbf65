"""Repeated ids in keep_one: a text goes only if a copy of it stays."""

from factloom.llm import jaccard


def test_an_id_by_several_texts_keeps_what_is_no_copy(spark):
    words = lambda p: " ".join(f"{p}{k}" for k in range(40))
    a, b, c, d = (words(p) for p in "abcd")
    rows = [(1, a), (2, a + " tail"), (2, b), (3, c), (3, d), (3, d), (4, ""), (None, a), (4, d.upper() + " more")]
    for n in (1, 5):
        got = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()), key=str)
        assert got == sorted([(1, a), (2, b), (3, c), (3, d), (4, ""), (None, a)], key=str)
