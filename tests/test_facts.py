"""The hand-written fact tables and the answers that follow from them by hand."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import dataflow, export, graph, merge, relational, sequence, solver
from factloom.sources.facts import FactSet, MissingFacts, from_rows, read_facts

FILES = ("id long, path string, sha256 string, is_dep int", [(1, "/proj/main.c", "", 0)])
FN = "id long, name string, file_id long, line_start int, line_end int, linkage string, signature string, is_defined int, is_dep int, is_weak int, target_id long"
FUNCTIONS = (FN, [(10, "main", 1, 10, 20, "external", "fn", 1, 0, 0, None), (11, "helper", 1, 22, 24, "external", "fn", 1, 0, 0, None), (12, "proto", 1, 30, 30, "external", "fn", 0, 0, 0, None)])
SITE = "id long, caller_fn_id long, file_id long, line int, col int, callee_text string, is_direct int, expansion_file_id long, expansion_line int, expansion_col int"
SITES = (SITE, [(100, 10, 1, 15, 5, "helper", 1, None, None, None), (101, 11, 1, 23, 5, "proto", 1, None, None, None), (102, 11, 1, 24, 1, "cb", 0, None, None, None), (103, 11, 1, 24, 1, "cb", 0, None, None, None)])
EDGE = "id long, call_site_id long, caller_fn_id long, callee_fn_id long, resolution string"
EDGES = (EDGE, [(200, 100, 10, 11, "direct"), (201, 101, 11, 12, "external")])
VARIABLES = ("id long, name string, kind string, fn_id long, file_id long, line int, col int, is_synthetic int", [(20, "g", "global", None, 1, 5, 5, 0), (21, "x", "local", 10, 1, 12, 9, 0), (22, "y", "local", 10, 1, 12, 18, 0)])
NODES = ("id long, kind string, label string, detail string, var_id long, fn_id long", [(300, "var", "g", "", 20, None), (301, "var", "x", "", 21, None), (302, "loc", "cell of g", "", None, None), (303, "var", "y", "", 22, None)])
FLOW = ("src_node long, dst_node long, kind string", [(300, 301, "copy"), (301, 302, "store"), (302, 300, "copy")])


@pytest.fixture(scope="module")
def facts(spark):
    return from_rows(spark, files=FILES, functions=FUNCTIONS, call_sites=SITES, call_edges=EDGES, variables=VARIABLES, flow_nodes=NODES, flow_edges=FLOW)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_calls_and_their_filters(facts):
    assert rows(relational.calls(facts), "caller", "callee", "resolution", "line") == [("helper", "proto", "external", 23), ("main", "helper", "direct", 15)]
    assert rows(relational.calls(facts, from_="main"), "callee") == [("helper",)]
    assert rows(relational.calls(facts, to="ain"), "callee") == []
    assert relational.calls(facts, file="MAIN.C").count() == 2 and relational.calls(facts, file="main_c").count() == 0


def test_functions_at_and_resolution(facts):
    assert rows(relational.functions_at(facts, "main.c", 23), "id") == [(11,)]
    assert relational.resolve_function(facts, "main.c:12") == 10 and relational.resolve_function(facts, "proto") == 12
    with pytest.raises(relational.Ambiguous, match="nearest: helper"):
        relational.resolve_function(facts, "main.c:26")
    with pytest.raises(relational.Ambiguous):
        relational.resolve_function(facts, "nobody")


def test_call_graph_depth_leaves_and_truncation(facts):
    g = graph.call_graph(facts, 10, 1)
    assert rows(g.nodes, "id", "depth") == [(10, 0), (11, 1)] and g.truncated.first()[0]
    g = graph.call_graph(facts, 10, 3)
    assert rows(g.nodes, "id", "depth") == [(-103, 2), (10, 0), (11, 1), (12, 2)] and not g.truncated.first()[0]
    assert rows(graph.call_graph(facts, 12, 5, down=False).nodes, "id", "depth") == [(10, 2), (11, 1), (12, 0)]


def test_a_cycle_ends_and_is_not_truncated(spark, facts):
    loop = facts.with_relation("call_edges", facts["call_edges"].unionByName(spark.createDataFrame([(202, None, 11, 10, "direct")], EDGE)))
    g = graph.call_graph(loop, 10, 8)
    assert (10, 0) in rows(g.nodes, "id", "depth") and not g.truncated.first()[0]


def test_chains_stop_at_the_end_and_keep_parallel_edges(spark):
    e = spark.createDataFrame([(1, 1, 2), (2, 1, 2), (3, 2, 3), (4, 2, 1), (5, 3, 2), (6, 1, 3)], "id long, a long, b long")
    got, cut = graph.chains(e, 1, 3, 4)
    assert [(r.length, list(r.edges)) for r in got.collect()] == [(1, [6]), (2, [1, 3]), (2, [2, 3])] and not cut.first()[0]
    got, cut = graph.chains(e, 1, 3, 4, limit=1)
    assert [list(r.edges) for r in got.collect()] == [[1, 3]] and cut.first()[0]
    assert rows(graph.chains(e, 1, 1, 3)[0], "length") == [(0,), (2,), (2,), (3,)]


def test_filter_keeps_roots_and_hangs_on_what_is_cut_off(spark, facts):
    g = graph.call_graph(facts, 10, 3)
    kept = graph.filter_graph(g, facts["functions"].select("id", "name"), spark.createDataFrame([(10,)], "id long"), ["^proto$"])
    assert rows(kept.edges, "a", "b") == [(11, 12)] and rows(kept.nodes, "id", "depth") == [(10, 0), (11, 1), (12, 2)]


def test_strong_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1)], "a long, b long")
    assert rows(graph.strong_components(e), "id", "component") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7)]


def test_waves_leave_cycles_out(spark):
    e, n = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4)], "a long, b long"), spark.range(1, 7)
    assert {r.id: r.wave for r in graph.waves(e, n).collect()} == {3: 0, 6: 0, 2: 1, 1: 2, 4: None, 5: None}


def test_dispatch_through_a_struct_slot(spark):
    c = [("gep", 1, 50, 7), ("addr_of", 50, 900, None), ("addr_of", 2, 801, None), ("store", 1, 2, None), ("gep", 3, 50, 7), ("load", 4, 3, None)]
    constraints = spark.createDataFrame(c, "kind string, dst long, src long, field long")
    locations = spark.createDataFrame([(900, "global", None, None), (801, "function", "DispatchToMessage", None)], "loc long, kind string, text string, type_id long")
    cells = solver.field_cells(locations.where("kind = 'global'").select("loc"), [7])
    targets = spark.createDataFrame([(61, 4)], "call_site_id long, node long")
    actuals, formals = spark.createDataFrame([(61, 0, 2)], "call_site_id long, arg_index int, node long"), spark.createDataFrame([(801, 0, 70)], "loc long, arg_index int, node long")
    got = solver.solve(constraints, locations, cells, call_targets=targets, actuals=actuals, formals=formals)
    assert rows(got.calls, "call_site_id", "callee") == [(61, 801)] and not got.partial
    assert ("p", 70, 801) in rows(got.facts, "t", "x", "o")


def test_points_to_by_brute_force(spark):
    import random

    r = random.Random(3)
    c = [(r.choice(["copy", "load", "store", "addr_of"]), r.randint(0, 25), r.randint(0, 25), None) for _ in range(60)]
    facts = {("p", d, s) for k, d, s, _ in c if k == "addr_of"}
    while True:
        new = set()
        for k, d, s, _ in c:
            for t, x, o in facts:
                if t == "p" and k == "copy" and x == s:
                    new.add(("p", d, o))
                if t == "p" and k == "load" and x == s:
                    new |= {("p", d, v) for u, y, v in facts if u == "m" and y == o}
                if t == "p" and k == "store" and x == d:
                    new |= {("m", o, v) for u, y, v in facts if u == "p" and y == s}
        if new <= facts:
            break
        facts |= new
    got = solver.solve(spark.createDataFrame(c, "kind string, dst long, src long, field long"))
    assert set(rows(got.facts, "t", "x", "o")) == facts


def test_returns_through_recursion(spark):
    r = spark.createDataFrame([(1, "call", 2), (2, "call", 1), (2, "var", 9), (3, "heap", 5)], "fn_id long, kind string, value long")
    assert rows(solver.expand_returns(r), "fn_id", "kind", "value") == [(1, "var", 9), (2, "var", 9), (3, "heap", 5)]


def test_innermost_definition(spark):
    ranges = spark.createDataFrame([(1, 1, 1, 20), (2, 1, 5, 10), (3, 1, 12, 14), (4, 1, 12, 14)], "id long, file_id long, line_start int, line_end int")
    places = spark.createDataFrame([(1, n) for n in (1, 5, 7, 13, 18, 30)], "file_id long, line int")
    assert {r.line: r.owner for r in relational.innermost(ranges, places).collect()} == {1: 1, 5: None, 7: 2, 13: None, 18: 1, 30: None}


def test_relations_of_events():
    f = sequence.Flow([(0, 1), (1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 4)])
    assert f.relate((1, 0), (4, 0)) == "guaranteed_before" and f.relate((2, 0), (4, 0)) == "may_precede" and f.relate((4, 0), (2, 0)) == "may_follow"
    assert f.relate((2, 0), (3, 0)) == "exclusive" and f.relate((4, 0), (5, 0)) == "may_both" and f.relate((1, 0), (1, 1)) == "sequenced_before" and f.relate((1, 1), (1, 1)) == "unordered"


def test_hidden_nodes_cost_nothing_and_vanish(spark):
    e = spark.createDataFrame([(1, 2, "copy"), (2, 3, "load"), (3, 4, "copy"), (2, 5, "store"), (4, 6, "copy")], "a long, b long, operation string")
    hidden, start = spark.createDataFrame([(2,)], "id long"), spark.createDataFrame([(1,)], "id long")
    assert rows(dataflow.visible_neighbourhood(e, start, hidden, 1), "id", "level") == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 0)]
    assert rows(dataflow.collapse_hidden(e, hidden), "a", "b", "operations") == [(1, 3, "copy,load"), (1, 5, "copy,store"), (3, 4, "copy"), (4, 6, "copy")]


def test_relinking_prefers_signature_image_and_strength(spark):
    edges = spark.createDataFrame([(1, "f", "s", 1, "external"), (2, "g", "s", 1, "indirect"), (3, "h", "s", 1, "external")], "edge_id long, name string, signature string, target_id long, resolution string")
    defs = spark.createDataFrame([(10, "f", "s", 1, 0, "a"), (11, "f", "s", 2, 0, "b"), (12, "f", "t", 1, 0, "c"), (13, "g", "x", 3, 1, "d"), (14, "g", "x", 3, 0, "e")], "def_id long, name string, signature string, target_id long, is_weak int, origin string")
    assert rows(merge.relink(edges, defs), "edge_id", "def_id", "resolution") == [(1, 10, "direct"), (2, 14, "indirect"), (3, None, "external")]


def test_dense_ids_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    for n in (1, 5):
        got = merge.dense_ids(df.repartition(n), ["k"]).collect()
        assert all(r.id == r.k + 1 for r in got)


def test_digest_ignores_order_and_counts_repeats(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "a long, b string")
    d = lambda x: merge.relation_digest(x, ["a", "b"]).first()[0]
    assert d(df) == d(df.orderBy(F.desc("a")).repartition(3)) != d(df.distinct())


def test_written_facts_come_back(spark, facts, tmp_path):
    path = str(tmp_path / "db")
    export.write_facts(facts, path)
    export.write_facts(facts, path)
    back = read_facts(spark, path, list(facts))
    assert rows(back["functions"], "id") == rows(facts["functions"], "id")
    with pytest.raises(MissingFacts, match="lacks is_dep"):
        FactSet({"files": facts["files"].drop("is_dep")}).require("files")
    with pytest.raises(MissingFacts, match="no relation types"):
        facts["types"]
