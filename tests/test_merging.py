"""Merging whole fact sets, and the Python API over the result."""

import pytest

from factloom.api import Closed, Snapshot
from factloom.operators import export, merging
from factloom.sources.facts import COLUMNS, from_rows

FILES = "id long, path string, sha256 string, is_dep int"
FN = "id long, name string, file_id long, line_start int, line_end int, linkage string, signature string, is_defined int, is_dep int, is_weak int, target_id long"
SITE = "id long, caller_fn_id long, file_id long, line int, col int, callee_text string, is_direct int, expansion_file_id long, expansion_line int, expansion_col int"
EDGE = "id long, call_site_id long, caller_fn_id long, callee_fn_id long, resolution string"
DIAG = "id long, stage string, severity string, file_id long, line long, message string"
CTX = "id long, kind string, entry_fn_id long, call_site_id long, api string, multi_instance string, self_concurrent int"


def app(spark):
    return from_rows(
        spark, files=(FILES, [(1, "/p/app.c", "", 0), (2, "/p/common.h", "", 1)]),
        functions=(FN, [(10, "main", 1, 1, 9, "external", "()", 1, 0, 0, 1), (11, "helper", 1, 0, 0, "external", "()", 0, 0, 0, 1), (12, "lost", 1, 0, 0, "external", "()", 0, 0, 0, 1), (13, "inline_one", 2, 3, 4, "external", "()", 1, 1, 0, None)]),
        call_sites=(SITE, [(100, 10, 1, 2, 3, "helper", 1, None, None, None), (101, 10, 1, 3, 3, "lost", 1, None, None, None), (102, 10, 1, 4, 3, "inline_one", 1, None, None, None)]),
        call_edges=(EDGE, [(1, 100, 10, 11, "external"), (2, 101, 10, 12, "external"), (3, 102, 10, 13, "direct")]), diagnostics=(DIAG, [(1, "parse", "error", 1, 5, "bad")]),
        execution_contexts=(CTX, [(1, "thread", 10, 100, "spawn", "loop", 0)]),
    )


def lib(spark):
    return from_rows(
        spark, files=(FILES, [(7, "/p/lib.c", "", 0), (8, "/p/common.h", "", 0)]),
        functions=(FN, [(20, "helper", 7, 5, 8, "external", "()", 1, 0, 0, 2), (21, "inline_one", 8, 3, 4, "external", "()", 1, 0, 0, None), (22, "helper", 7, 20, 22, "external", "()", 1, 0, 1, 2)]),
        call_sites=(SITE, [(1, 20, 7, 6, 1, "inline_one", 1, None, None, None)]), call_edges=(EDGE, [(1, 1, 20, 21, "direct")]), diagnostics=(DIAG, [(1, "parse", "error", None, 0, "odd")]),
    )


@pytest.fixture(scope="module")
def merged(spark):
    return merging.merge_facts([app(spark), lib(spark), app(spark)])


def test_two_inputs_and_one_of_them_twice(merged):
    f = merged.facts
    assert {r.path: r.is_dep for r in f["files"].collect()} == {"/p/app.c": 0, "/p/common.h": 0, "/p/lib.c": 0}
    names = {r.id: r for r in f["functions"].collect()}
    assert sorted((r.name, r.is_defined) for r in names.values()) == [("helper", 0), ("helper", 1), ("helper", 1), ("inline_one", 1), ("lost", 0), ("main", 1)]
    assert len(f["call_sites"].collect()) == 4
    calls = sorted((names[e.caller_fn_id].name, names[e.callee_fn_id].name, names[e.callee_fn_id].line_start, e.resolution) for e in f["call_edges"].collect())
    assert calls == [("helper", "inline_one", 3, "direct"), ("main", "helper", 5, "direct"), ("main", "inline_one", 3, "direct"), ("main", "lost", 0, "external")]
    sites = {r.id for r in f["call_sites"].collect()}
    assert all(e.call_site_id in sites for e in f["call_edges"].collect()) and f["execution_contexts"].first().call_site_id in sites
    got = {(w.kind, w.severity, w.symbol) for w in merged.warnings.collect()}
    assert got == {("duplicate_input", "warning", None), ("weak_override", "info", "helper"), ("unresolved_external", "info", "lost"), ("missing_execution_contexts", "info", None)}
    said = {(d.stage, d.message) for d in f["diagnostics"].collect()}
    assert {("parse", "bad"), ("parse", "odd"), ("merge", "no definition: lost")} <= said and len(said) == 6
    for name, df in f.items():
        assert set(df.columns) >= set(COLUMNS[name].split()), name


def test_a_merge_of_one_input_keeps_its_shape(spark):
    f = merging.merge_facts([lib(spark)]).facts
    assert f["functions"].count() == 3 and f["call_edges"].count() == 1 and "execution_contexts" not in f
    with pytest.raises(ValueError, match="nothing"):
        merging.merge_facts([])


def test_snapshots_answer_and_close(spark, tmp_path):
    path = str(tmp_path / "facts")
    export.write_facts(app(spark), path)
    names = ["files", "functions", "call_sites", "call_edges"]
    with Snapshot.open(spark, path, names) as s:
        assert [f["id"] for f in s.find_functions("main")] == [10] and [f["id"] for f in s.find_functions(file="app.c", line=3)] == [10]
        assert {e["callee"] for e in s.call_edges(from_="main")} == {"helper", "lost", "inline_one"}
        graph = s.call_graph("main", depth=1)
        assert {n["id"] for n in graph["nodes"]} == {10, 11, 12, 13} and not graph["truncated"]
        assert [c["nodes"] for c in s.call_chains("main", "helper")["chains"]] == [[10, 11]]
        assert s.prepare_call_hierarchy("app.c", 2)[0]["name"] == "main"
        assert s.outgoing_calls(10) == [{"id": 11, "name": "helper", "places": [(2, 3)]}, {"id": 12, "name": "lost", "places": [(3, 3)]}, {"id": 13, "name": "inline_one", "places": [(4, 3)]}]
        assert [c["id"] for c in s.incoming_calls(13)] == [10]
        with pytest.raises(ValueError, match="a name"):
            s.find_functions()
    with pytest.raises(Closed):
        s.find_functions("main")
