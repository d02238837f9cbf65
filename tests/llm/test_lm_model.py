"""The interpolated score and its weights by brute force; long texts, repeated rows, null ids, clashing columns."""

import math
import random
import re
import zlib

import numpy as np

from factloom.llm import lm

WORDS = "the of and to in a is that it x9 Été été".split()


def tokens(text):
    return re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def counts(rows):
    one, two, starts = {}, {}, 0
    for key, text in rows:
        if zlib.crc32(str(key).encode()) % 5 != 1:
            own = tokens(text)
            starts += 1
            for a, b in zip(["<start>", *own], own, strict=False):
                one[b] = one.get(b, 0) + 1
                two[a, b] = two.get((a, b), 0) + 1
    return one, two, starts


def bucket(c):
    return 1 + int(math.log2(c)) if c > 0 else 0


def test_scores_by_brute_force(spark, monkeypatch):
    r = random.Random(14)
    weights = np.array([[r.random() + 0.1 for _ in range(3)] for _ in range(65)])
    weights /= weights.sum(axis=1, keepdims=True)
    monkeypatch.setattr(lm, "learn_weights", lambda cells, v: weights)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(0, 60)))) for i in range(150)]
    rows += [(7, rows[7][1]), (7, "another text by the id"), (None, "the of"), (None, None), (900, ""), (901, "NEW Words only"), (902, "the new the of " * 60_000)]
    docs = spark.createDataFrame([(k, t, 1.5, "clash") for k, t in rows], "doc_id long, text string, score double, held_out string")
    got = sorted(((x.doc_id is None, x.doc_id or 0, x.n_tokens, x.score) for x in lm.score(docs).collect()))
    one, two, starts = counts(rows)
    n, v = sum(one.values()), len(one)
    want = []
    for key, text in rows:
        total, before = 0.0, "<start>"
        own = tokens(text)
        for w in own:
            c = starts if before == "<start>" else one.get(before, 0)
            a, b, u = weights[bucket(c)]
            total += math.log10(a * (two.get((before, w), 0) / c if c else 0) + b * one.get(w, 0) / n + u / (v + 1))
            before = w
        want.append((key is None, key or 0, len(own), total))
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-8 * max(1, abs(w[3]))


def test_weights_are_those_of_em_over_every_token(spark):
    r = random.Random(15)
    rows = [(i, " ".join(r.choice(WORDS if r.random() < 0.8 else ["rare" + str(r.randint(0, 400))]) for _ in range(r.randint(5, 60)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    batches, v, n = lm.counted(docs)
    got = lm.learn_weights(lm.held_out_histogram(batches, n), v)
    one, two, starts = counts(rows)
    assert (n, v) == (sum(one.values()), len(one))
    data = {}
    for key, text in rows:
        if zlib.crc32(str(key).encode()) % 5 != 1:
            before = "<start>"
            for w in tokens(text):
                c = (starts if before == "<start>" else one[before]) - 1
                data.setdefault(bucket(c), []).append(((two[before, w] - 1) / c if c else 0.0, (one[w] - 1) / (n - 1), 1 / (v + 1)))
                before = w
    for b, p in data.items():
        if len(p) < 200:
            continue
        p, w = np.array(p), np.array(lm.PRIOR if b else (0, 0.9, 0.1))
        for _ in range(lm.ROUNDS):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = share.mean(axis=0)
        assert np.abs(got[b] - w).max() < 0.05, (b, got[b], w)
