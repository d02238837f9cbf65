"""The classifier's forward pass and query by brute force; long texts, repeated rows, null ids, clashing columns."""

import math
import random
import zlib

import numpy as np
import pytest

from factloom.llm import toxicity as T


def brute_score(model, text):
    """The score of one text, window by window, in plain Python."""
    vectors = []
    for token in (text or "").lower().split():
        word = T.stem(token)
        cells = [zlib.crc32(word.encode()) % T.BUCKETS] + [zlib.crc32(f"{p}:{word[:p]}".encode()) % T.BUCKETS for p in T.PREFIXES]
        vectors.append([sum(float(model["table"][c][d]) for c in cells) / len(cells) for d in range(T.WIDTH)])
    n = len(vectors)
    vectors += [[0.0] * T.WIDTH] * (max(T.SPANS) + T.POOL)
    z = float(model["base"])
    for k, span in enumerate(T.SPANS):
        for f in range(T.FILTERS):
            seen = [
                float(model["bias"][k][f]) + sum(vectors[i + j][d] * float(model["kernels"][k][j][d][f]) for j in range(span) for d in range(T.WIDTH))
                for i in range(n + T.POOL - 1)
            ]
            for p, v in enumerate(sorted(seen, reverse=True)[: T.POOL]):
                z += max(v, 0.0) * float(model["out"][k][p][f])
    p = 1 / (1 + math.exp(-z))
    marks = [T._MARKS.get(T.stem(t)) for t in (text or "").lower().split()]
    votes = [marks.count(g) for g in range(len(T.FUNCTION_WORDS))]
    g = votes.index(max(votes)) if any(votes) else len(T.FUNCTION_WORDS)
    return T.calibrated(p, model["limits"][g])


@pytest.fixture(scope="module")
def model():
    r = random.Random(3)
    made = T._empty_model(5)
    made["limits"] = [r.uniform(0.2, 0.8) for _ in T.LANGUAGES]
    return made


def test_the_query_scores_as_brute_force_does(spark, model):
    assert len(T.SPANS) >= 3
    r = random.Random(4)
    words = "The and, der das (nicht) el los vile odd stuff! Ünder été 12 a".split()
    texts = [None, "", "one", "x y"] + [" ".join(r.choice(words) for _ in range(r.randint(1, 30))) for _ in range(25)]
    rows = [(i, t, "clash", 0.5) for i, t in enumerate(texts)] + [(3, "x y", "clash", None), (None, "the vile", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double")
    got = T.score_toxicity(docs, model).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    assert len(by[3]) == 2 and by[3][0].score == by[3][1].score
    for i, t in [*enumerate(texts), (None, "the vile")]:
        assert abs(by[i][0].score - brute_score(model, t)) < 1e-4
        assert by[i][0].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and by[i][0].predicted == int(by[i][0].score >= 0.7)


def test_long_texts_are_pooled_piece_by_piece(model, monkeypatch):
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 6) for _ in range(n)) for n in (1, 2, 7, 8, 9, 23, 24, 25, 400)]
    whole = [p for p, _ in T._scored(model, texts)]
    for size in (4, 8, 24):
        monkeypatch.setattr(T, "WORDS_AT_ONCE", size)
        assert np.allclose([p for p, _ in T._scored(model, texts)], whole, atol=1e-6)


def test_a_text_of_megabytes(model):
    text = "some words of the text " * 200_000
    assert len(text) > 4_000_000
    found = T._scored(model, [text, "some words of the text " * 3])
    assert abs(found[0][0] - found[1][0]) < 1e-3 and found[0][1] == found[1][1]
