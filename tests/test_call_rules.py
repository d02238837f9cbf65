"""Rules of call filters, node labels and sharing, each by cases worked out by hand."""

from factloom.operators import dataflow as D
from factloom.operators import graph as G
from factloom.operators import relational as R
from factloom.sources.facts import from_rows

FN = "id long, name string, file_id long, line_start int, line_end int, linkage string, signature string, is_defined int, is_dep int, is_weak int, target_id long"
SITE = "id long, caller_fn_id long, file_id long, line int, col int, callee_text string, is_direct int, expansion_file_id long, expansion_line int, expansion_col int"


def facts(spark):
    files = [(1, "/p/Caller.c", "", 0), (2, "/p/callee.c", "", 0), (3, "/p/macro.h", "", 0), (4, "/p/user.c", "", 0), (5, "/p/ext.c", "", 0)]
    fn = [(10, "a", 1, 1, 9, "external", "", 1, 0, 0, None), (11, "b", 2, 1, 9, "external", "", 1, 0, 0, None), (12, "ext", 5, 0, 0, "external", "", 0, 0, 0, None), (13, "lost", 99, 1, 2, "external", "", 1, 0, 0, None)]
    sites = [(100, 10, 3, 4, 5, "b", 1, 4, 7, 1), (101, 10, 4, 8, 1, "ext", 1, None, None, None)]
    edges = [(1, 100, 10, 11, "direct"), (2, 101, 10, 12, "external"), (3, None, 10, 11, "ipc"), (4, 101, 10, 13, "direct")]
    return from_rows(
        spark, files=("id long, path string, sha256 string, is_dep int", files), functions=(FN, fn), call_sites=(SITE, sites),
        call_edges=("id long, call_site_id long, caller_fn_id long, callee_fn_id long, resolution string", edges),
    )


def test_where_a_file_text_is_looked_for(spark):
    f = facts(spark)
    ids = lambda text: [r.id for r in R.calls(f, file=text).collect()]
    assert ids("MACRO") == [1]  # where the call is spelled
    assert ids("user.c") == [1, 2]  # where it is expanded, and where another is spelled
    assert ids("callee") == [1, 3]  # the callee's own file
    assert ids("caller") == [3]  # the caller's only for an edge without a site
    assert ids("ext.c") == []  # a callee without a place has no file of its own
    assert ids("/p/") == [1, 2, 3]  # a function without a file has no edges
    assert [r.id for r in R.calls(f).collect()] == [1, 2, 3]


def test_labels_and_details_of_nodes(spark):
    f = from_rows(
        spark,
        functions=(FN, [(10, "main", 1, 1, 9, "external", "", 1, 0, 0, None)]),
        variables=("id long, name string, kind string, fn_id long, file_id long, line int, col int, is_synthetic int", [(1, "x", "local", 10, 1, 5, 1, 0), (2, "g", "global", None, 1, 7, 1, 0)]),
        flow_nodes=("id long, kind string, label string, detail string, var_id long, fn_id long", [(1, "var", "", None, 1, None), (2, "var", None, "", 2, None), (3, "var", "", "", 9, None), (4, "var", "", "", None, None), (5, "loc", "", None, None, 10), (6, "var", "named", "kept", 1, None)]),
    )
    got = {r.id: (r.label, r.detail) for r in R.node_labels(f).collect()}
    assert got == {1: ("x", "local @5 in main"), 2: ("g", "global @7"), 3: ("var9", ""), 4: ("var4", ""), 5: ("", None), 6: ("named", "kept")}


def test_what_contexts_share(spark):
    rows = [
        (1, "var", "global", None), (2, "var", "file_static", None), (3, "var", "local", None), (4, "var", "param", None), (5, "var", None, None), (6, "constant", None, None), (7, "loc", None, "function"), (8, "loc", None, "string_lit"),
        (9, "loc", None, "local"), (10, "loc", "param", "field"), (11, "loc", "global", "field"), (12, "loc", None, "heap"), (13, "loc", "global", "field_summary"), (14, "call_target", None, None), (15, "terminator", None, None), (16, "odd", None, None), (17, "loc", None, None),
    ]
    got = {r.id: r.sharing for r in D.sharing(spark.createDataFrame(rows, "id long, kind string, var_kind string, loc_kind string")).collect()}
    want = {1: "shared", 2: "shared", 6: "constant", 7: "constant", 8: "constant", 11: "shared", 12: "shared", 13: "shared", 17: "shared"}
    assert got == {k: want.get(k, "private") for k, *_ in rows}


def test_chains_walk_only_towards_their_end(spark):
    edges = [(k, 0, k) for k in range(1, 40)] + [(100, 0, 50), (101, 50, 51), (102, 0, 51), (103, 50, 51), (104, 51, 60)]
    df = spark.createDataFrame(edges, "id long, a long, b long")
    assert [list(r.edges) for r in G.chains(df, 0, 51, 3)[0].collect()] == [[102], [100, 101], [100, 103]]
    assert [list(r.edges) for r in G.chains(df, 0, 51, 1)[0].collect()] == [[102]]
    paths, cut = G.chains(df, 0, 51, 3, limit=2)
    assert [list(r.edges) for r in paths.collect()] == [[100, 101], [100, 103]] and cut.first().truncated
    assert [list(r.nodes) for r in G.chains(df, 7, 7, 3)[0].collect()] == [[7]] and G.chains(df, 51, 0, 5)[0].count() == 0


def test_waves_and_components_of_long_paths_and_cycles(spark):
    path = [(k + 1, k) for k in range(12)]
    cycle = [(100, 101), (101, 102), (102, 100), (103, 100), (102, 104)]
    e = spark.createDataFrame(path + cycle + [(5, 5)], "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in [*range(13), 100, 101, 102, 103, 104, 999]], "id long")
    got = {r.id: r.wave for r in G.waves(e, nodes).collect()}
    assert got == {**{k: k for k in range(13)}, 100: None, 101: None, 102: None, 103: None, 104: 0, 999: 0}
    parts = {r.id: r.component for r in G.strong_components(e).collect()}
    assert parts == {**{k: k for k in range(13)}, 100: 100, 101: 100, 102: 100, 103: 103, 104: 104}
