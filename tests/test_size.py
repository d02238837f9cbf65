"""Work that grows with a table, not with its square or with the number of rounds."""

from collections import Counter

import pytest

from factloom.operators import blocks, models
from factloom.operators import dataflow as D
from factloom.operators import graph as G
from factloom.operators import loop
from factloom.operators import merge as M
from factloom.operators import relational as R
from factloom.operators import sequence as Q
from factloom.operators import solver as S
from factloom.sources import facts


def above_lists(df) -> str:
    """The part of a plan that handles the rows of lists that were taken apart; all of it if there are none."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("Generate explode")[0] if "Generate explode" in plan else plan


@pytest.fixture
def short_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 3)


def test_block_join_is_an_inner_join(spark, short_blocks):
    left = [(i % 4 if i % 5 else None, i) for i in range(40)] + [(1, 6), (1, 6)]
    right = [(i % 6, i + 100, "ab"[i % 2]) for i in range(50)] + [(1, 107, "b")]
    got = blocks.block_join(spark.createDataFrame(left, "k long, v long"), spark.createDataFrame(right, "k long, a long, c string"), "k", "v", "a", ["c"])
    assert Counter(map(tuple, got.collect())) == Counter((v, a, c) for k, v in left for q, a, c in right if k == q)


def test_direct_edges_are_not_shuffled(spark, short_blocks):
    sites = [(i, [0, 1, None][i % 3], f"f{i % 2}", 1) for i in range(30)] + [(0, 0, "f0", 1), (3, 1, "f1", 1), (99, 0, "f0", 0), (98, 0, None, 1)]
    functions = [(i, f"f{i % 3}", [0, 1, 2, None][i % 4], ["external", "internal", "external", "internal", None][i % 5], i % 7 and 1) for i in range(40)] + [(0, "f0", 0, "external", 0), (5, "f1", 1, "external", 1)]
    got = S.direct_edges(spark.createDataFrame(sites, "id long, file_id long, callee_text string, is_direct int"), spark.createDataFrame(functions, "id long, name string, file_id long, linkage string, is_defined int"))
    want = set()
    for site in {s[0] for s in sites if s[3]}:
        seen = [(i, d, link == "internal") for s, file, text, direct in sites if s == site and direct for i, n, f, link, d in functions if n == text and n and link and (link != "internal" or f is not None and f == file)]
        want |= {(site, i, "direct" if d else "external") for i, d, own in seen if own or not any(o for *_, o in seen)}
    rows = [tuple(r) for r in got.select("call_site_id", "callee", "resolution").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert "Exchange" not in above_lists(got) and "Aggregate" not in above_lists(got)


def test_relinked_edges_are_not_shuffled(spark, short_blocks):
    edges = [(i, f"f{i % 4}", f"s{i % 3}", [1, 2, None][i % 3], ["external", "indirect"][i % 2]) for i in range(24)]
    defs = [(i, f"f{i % 3}", f"s{i % 2}", [1, 3, None, 2, 1][i % 5], i % 4 // 3, f"o{i % 6}") for i in range(60)]
    got = M.relink(spark.createDataFrame(edges, "edge_id long, name string, signature string, target_id long, resolution string"), spark.createDataFrame(defs, "def_id long, name string, signature string, target_id long, is_weak int, origin string"))
    want = []
    for edge, name, sig, target, kind in edges:
        seen = [d for d in defs if d[1] == name]
        for good in (lambda d: d[2] == sig, lambda d: d[3] == target is not None, lambda d: d[4] == 0):
            seen = [d for d in seen if good(d)] or seen
        of = kind if not seen or kind == "indirect" else "direct" if len({d[5] for d in seen}) == 1 else "ambiguous"
        want += [(edge, d[0], of) for d in seen] or [(edge, None, of)]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert "Aggregate" not in above_lists(got) and "Window" not in above_lists(got)


def test_contexts_of_a_place_are_listed_once(spark):
    nodes = [(i, i % 3) for i in range(30)] + [(0, 1), (0, 1), (1, None), (99, None), (98, 7)]
    sets = [(0, 5), (0, 12), (1, 5), (1, 3), (2, 8)]
    got = D.cross_context(spark.createDataFrame(nodes, "node long, fn long"), spark.createDataFrame(sets, "fn long, context long"), spark.createDataFrame([(8,), (8,)], "id long"))
    by = {n: sorted({c for m, f in nodes if m == n for g, c in sets if g == f}) for n in {n for n, _ in nodes}}
    assert sorted(map(tuple, got.collect())) == sorted((n, ",".join(map(str, c)), len(c) > 1 or 8 in c) for n, c in by.items() if c)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan  # nodes only meet lists that are made


def test_bridges_and_twins_are_not_shuffled(spark, short_blocks):
    names = [(i, f"ns::A{i % 2}{['Proxy', 'Stub', 'Client'][i % 3]}::{'On' if i % 6 == 1 else ''}M{i % 2}", 1) for i in range(60)]
    functions = spark.createDataFrame(names + names[:7], "id long, name string, is_defined int")
    got = models.ipc_bridges(functions, functions.select("id"))
    want = {(i, j) for i, a, _ in names for j, b, _ in names if i % 3 != 1 and j % 3 == 1 and i % 2 == j % 2}
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert "Exchange" not in above_lists(got) and "Aggregate" not in above_lists(got)
    rows = [(i, "param" if i % 3 else "local", [1, 2, None][i % 5 % 3], f"v{i % 2}") for i in range(50)]
    twins = R.parameter_twins({"variables": spark.createDataFrame(rows, "id long, kind string, fn_id long, name string")})
    own = [r for r in rows if r[1] == "param" and r[2] is not None]
    assert Counter(map(tuple, twins.collect())) == Counter((a[0], b[0]) for a in own for b in own if a[2:] == b[2:] and a[0] != b[0])
    assert "Exchange" not in above_lists(twins)


def test_pairs_of_events_leave_a_worker_piecewise(spark, monkeypatch):
    monkeypatch.setattr(Q, "SLICE", 4)
    monkeypatch.setattr(Q, "PAIRS", 16)
    events = [(g, 100 * g + i * 7 % 30, i * 5 % 7, i % 3) for g in range(3) for i in range(30 if g else 1)] + [(9, 1, 0, 0), (9, 2, 0, 0)]
    edges = [(g, a, (a * 3 + g) % 7) for g in range(3) for a in range(7)]
    gaps = [(1, 107), (2, 200)]
    frame = spark.createDataFrame(events, "cfg_id long, event long, block long, ordinal long")
    got = Q.event_relations(frame, spark.createDataFrame(edges, "cfg_id long, src long, dst long"), spark.createDataFrame(gaps, "cfg_id long, event long"))
    want = []
    for g in {e[0] for e in events}:
        own, flow = sorted(e[1:] for e in events if e[0] == g), Q.Flow([e[1:] for e in edges if e[0] == g])
        want += [(g, a[0], b[0], "unknown" if {(g, a[0]), (g, b[0])} & set(gaps) else flow.relate(a[1:], b[1:])) for i, a in enumerate(own) for b in own[i + 1 :]]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "i#" in plan  # slices, not whole graphs


def test_combined_keeps_no_sets(spark):
    relations = [(k, r) for k in range(256) for i, r in enumerate(Q.RELATIONS) if k >> i & 1]
    got = Q.combined(spark.createDataFrame(relations * 2, "k long, relation string"), ["k"])
    precede, follow = {"sequenced_before", "guaranteed_before", "may_precede", "may_both", "unordered"}, {"may_follow", "may_both", "unordered"}

    def of(r: set) -> str:
        if len(r) == 1:
            return min(r)
        if "unknown" in r:
            return "unknown"
        if r <= {"sequenced_before", "guaranteed_before"}:
            return "guaranteed_before"
        return ("may_both" if r & follow else "may_precede") if r & precede else "may_follow" if r & follow else "exclusive"

    assert sorted(map(tuple, got.collect())) == [(k, of({r for q, r in relations if q == k})) for k in range(1, 256)]
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_places_meet_ranges_near_them_only(spark):
    spans = [(i, i % 2, 4 * i + 1, 4 * i + 1 + (i % 9 if i % 50 else 3000)) for i in range(300)] + [(900, 0, -5, 7), (901, 0, 9, 8), (902, 1, 64, 64), (903, 1, 64, 64), (904, None, 1, 9)]
    ranges = spark.createDataFrame(spans, "id long, file_id long, line_start long, line_end long")
    lines = [(f, n) for f in (0, 1, 2, None) for n in (*range(-6, 90), 600, 1199, 4100, None)]
    got = R.innermost(ranges, spark.createDataFrame(lines * 2, "file_id long, line long"))
    want = []
    for f, n in lines:
        held = [s for s in spans if n is not None and f is not None and s[1] == f and s[2] <= n <= s[3]]
        best = [s for s in held if len(held) == 1 or s[2] < n < s[3] and all(o[2] <= s[2] and o[3] >= s[3] and o[2:] != s[2:] for o in held if o[0] != s[0])]
        want.append((f, n, best[0][0] if best else None))
    assert Counter(map(tuple, got.select("file_id", "line", "owner").collect())) == Counter(want)
    assert R.innermost(ranges, spark.createDataFrame(lines, "file_id long, line long"))._jdf.queryExecution().optimizedPlan().toString().count("cell#") > 2


def test_edges_are_made_once_for_all_rounds(spark):
    made = spark.sparkContext.accumulator(0)

    def read(batches):
        made.add(1)
        yield from batches

    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long").coalesce(1)
    edges = chain.mapInArrow(read, "a long, b long")
    root = spark.createDataFrame([(0,)], "id long")
    assert sorted(r.id for r in G.reachable(edges, root).collect()) == list(range(13)) and made.value == 1
    made.value = 0
    found = G.neighbourhood(edges, root, 5)
    assert sorted(map(tuple, found.nodes.collect())) == [(i, i) for i in range(6)] and found.truncated.first()[0] and found.edges.count() == 5 and made.value == 1
    made.value = 0
    got = D.visible_neighbourhood(edges, root, spark.createDataFrame([(2,), (3,), (7,)], "id long"), 3)
    assert sorted(map(tuple, got.collect())) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 1), (5, 2), (6, 3)] and made.value == 1
    made.value = 0
    got = D.collapse_hidden(edges.selectExpr("a", "b", "concat('o', a % 3) operation"), spark.createDataFrame([(i,) for i in range(2, 9)], "id long"))
    assert sorted(map(tuple, got.collect())) == [(0, 1, "o0"), (1, 9, "o0,o1,o2"), (9, 10, "o0"), (10, 11, "o1"), (11, 12, "o2")] and made.value == 1


def test_few_new_rows_do_not_shuffle_the_known(spark, monkeypatch):
    monkeypatch.setattr(loop, "BROADCAST_ROWS", 3)
    known = loop.cut(spark.range(100).selectExpr("id a", "id % 7 b"))
    got = loop.unknown(spark.createDataFrame([(5, 5), (5, 6), (200, 1)], "a long, b long"), known, 100, ["a", "b"], True)
    assert sorted(map(tuple, got.collect())) == [(5, 6), (200, 1)] and "Exchange hash" not in got._jdf.queryExecution().executedPlan().toString()


def test_shuffles_are_dealt_by_the_size_of_the_input(spark, monkeypatch):
    monkeypatch.setattr(facts, "BYTES_A_PART", 100_000)
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    small = facts.adapt(spark, "/root/testdata/sf0.001")
    small["call_edges"]
    few = int(spark.conf.get(key))
    large = facts.adapt(spark, "/root/testdata/sf0.1")
    large["call_edges"]
    assert few < 10 and 100 < int(spark.conf.get(key)) < 130
    spark.conf.unset(key)
