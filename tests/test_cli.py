"""The command line's views of values and sequences, and its merge."""

import json

from factloom import cli
from factloom.operators import export
from factloom.sources.facts import from_rows
from tests.test_facts import EDGES, FILES, FLOW, FUNCTIONS, NODES, SITES, VARIABLES
from tests.test_merging import app, lib


def test_dataflow_slice_and_sequence(spark, tmp_path):
    path = str(tmp_path / "facts")
    cfg = {
        "cfg_edges": ("cfg_id long, src long, dst long", [(1, 0, 1), (1, 0, 2), (1, 1, 3), (1, 2, 3), (2, 0, 1)]),
        "cfg_events": ("cfg_id long, event long, block long, ordinal long, call_site_id long", [(1, 50, 0, 0, 100), (1, 51, 1, 0, 101), (1, 52, 2, 0, None), (1, 53, 3, 0, None), (2, 60, 0, 0, None)]),
    }
    export.write_facts(from_rows(spark, files=FILES, functions=FUNCTIONS, call_sites=SITES, call_edges=EDGES, variables=VARIABLES, flow_nodes=NODES, flow_edges=FLOW, **cfg), path)
    run = lambda *a: cli.main([path, *a], spark)
    text = run("dataflow", "g", "--depth", "2")
    assert "values out of g" in text and "-copy-> x" in text and "3 nodes" in text
    assert {n["label"] for n in json.loads(run("dataflow", "g", "--up", "--format", "json"))["nodes"]} == {"g", "x", "cell of g"}
    got = json.loads(run("slice", "g", "--format", "json"))
    assert {(n["label"], n["side"]) for n in got["nodes"]} == {("g", "both"), ("x", "down"), ("cell of g", "both")}
    assert run("slice", "g").startswith("slice of g\ncomes from and goes to:")
    text = run("sequence", "1")
    assert "50 guaranteed_before 53" in text and "51 exclusive 52" in text and "4 events" in text
    assert [e["event"] for e in json.loads(run("sequence", "1", "--first", "51", "--format", "json"))["events"]] == [51, 53]
    assert [e["event"] for e in json.loads(run("sequence", "1", "--first", "50", "--last", "52", "--format", "json"))["events"]] == [50, 52]


def test_merge_writes_a_folder(spark, tmp_path):
    for name, make in (("a", app), ("b", lib)):
        export.write_facts(make(spark), str(tmp_path / name))
    text = cli.main([str(tmp_path / "out"), "merge", str(tmp_path / "a"), str(tmp_path / "b")], spark)
    assert "functions\t6" in text and "info: no definition: lost" in text
    assert "direct" in cli.main([str(tmp_path / "out"), "calls", "--from", "main", "--to", "helper"], spark)
