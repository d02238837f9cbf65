"""Sets that are too far from all others at a key don't meet them there; sets that link always do."""

import random

import numpy as np

from factloom.llm import jaccard


def test_variants_too_far_from_a_group_leave_its_keys_and_links_stay(spark):
    r = random.Random(4)
    sets = {}
    for i in range(40):  # a group, of which each differs in up to five of 120 elements
        gone = set(r.sample(range(120), r.randint(0, 5)))
        sets[i] = {k for k in range(120) if k not in gone} | {1000 + k for k in r.sample(range(30), len(gone))}
    for i in range(40, 60):  # share 92 with the group, which links with no set of 120
        sets[i] = {k for k in range(120) if k not in set(r.sample(range(120), 28))}
        sets[i] = set(sorted(sets[i])[:92]) | {2000 + k for k in r.sample(range(60), 28)}
    for i in range(60, 64):  # smaller ones that do
        sets[i] = set(r.sample(range(120), 100))
    count = {k: sum(k in s for s in sets.values()) for s in sets.values() for k in s}
    rows = []
    for i, s in sets.items():
        order = sorted((k for k in s if count[k] > 1), key=lambda k: (count[k], k))
        if len(order) >= jaccard.needed(len(s)):
            first = len(order) - jaccard.needed(len(s)) + 1
            rows.append((i, len(s), np.array(sorted(order), np.uint64).tobytes(), order[:first]))
    every = jaccard.keyed_sets(spark.createDataFrame(rows, "sid long, n long, shared binary, keys array<long>"))
    before, at = {}, {}
    for x in every.collect():
        before.setdefault(x.token, set()).add(x.sid)
    for x in jaccard.within_reach(every).collect():
        at.setdefault(x.token, set()).add(x.sid)
    meet = lambda lists: {(a, b) for found in lists.values() for a in found for b in found if a < b}
    links = {(a, b) for a in sets for b in sets if a < b and jaccard.linked(len(sets[a] & sets[b]), len(sets[a]), len(sets[b]))}
    assert links <= meet(at) < meet(before)
    assert len(meet(at) - links) * 2 < len(meet(before) - links)
