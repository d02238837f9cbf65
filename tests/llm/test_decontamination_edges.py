"""Decontamination against brute force: hot passages, very long texts, repeated ids, nulls and clashing columns."""

import random
import re

from factloom.llm import decontaminate as D


def brute(docs, items):
    def sh(texts):
        out = set()
        for t in texts:
            w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
            out |= {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        return out

    by = lambda rows: {k: sh([t for i, t in rows if i == k]) for k in {i for i, _ in rows}}
    d, b = by(docs), by(items)
    return {(x, y, len(b[y]), len(d[x] & b[y])) for x in d for y in b if b[y] and 100 * len(d[x] & b[y]) >= 75 * len(b[y])}


def test_containment_by_brute_force(spark):
    r = random.Random(12)
    word = lambda: r.choice("the of a to in é is on".split()) + str(r.randint(0, 9))
    items = [(k, " ".join(word() for _ in range(r.choice([1, 3, 4, 5, 6, 9, 17, 33, 80])))) for k in range(12)] + [(3, None), (20, ""), (21, "one two"), (21, "three four five six seven eight")]
    docs = []
    for i in range(60):
        words = [word() for _ in range(r.randint(0, 60))]
        for _, t in r.sample(items[:12], r.randint(0, 2)):
            own = t.split()
            for _ in range(r.randint(0, 2)):
                own[r.randrange(len(own))] = "odd"
            at = r.randint(0, len(words))
            words[at:at] = own
        docs.append((i % 50, "\t ".join(words).upper() if i % 7 == 0 else " ".join(words)))
    docs += [(100, None), (101, ""), (102, "ONE  two"), (103, " ".join(word() for _ in range(150_000)) + " " + items[8][1])]
    frame = lambda rows, key: spark.createDataFrame([(k, t, 1, "x") for k, t in rows], f"{key} long, text string, h int, n string")
    found = D.contained(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    assert {tuple(x) for x in found} == brute(docs, items) and len(found) == len({(x.doc_id, x.item_id) for x in found})


def test_empty_tables_either_side(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contained(none, items).count() == 0 and D.contained(some, items.limit(0)).count() == 0
    assert D.clean(some, items.limit(0)).count() == 1 and D.clean(some, items).count() == 0 and D.clean(none, items).count() == 0
