"""Readers of trees and build metadata, models, renderers, the command line, and what an installation without the text operators offers."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

from factloom import cli
from factloom.operators import export, graph, models, relational, render
from factloom.sources import code
from tests.test_facts import EDGES, FILES, FUNCTIONS, SITES, from_rows, rows

ROOT = Path(__file__).resolve().parents[1]


def test_trees_and_includes(spark, tmp_path):
    for name, text in {"a/x.c": '#include "y.h"\n# include <z.h>\n#include "deep/w.h"\n#include <lost/v.h>\n', "a/y.h": "//", "inc/z.h": '#include "y.h"\n', "b/deep/w.h": "//", "b/lost.txt": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = code.source_files(spark, str(tmp_path))
    short = lambda p: p and p.replace(f"{tmp_path}/", "")
    assert {(short(r.path), r.is_header) for r in files.collect()} == {("a/x.c", False), ("a/y.h", True), ("inc/z.h", True), ("b/deep/w.h", True)}
    found = code.include_edges(files, [str(tmp_path / "inc")])
    got = {(short(r.src), r.spelled): short(r.dst) for r in found.collect()}
    assert got == {("a/x.c", "y.h"): "a/y.h", ("a/x.c", "z.h"): "inc/z.h", ("a/x.c", "deep/w.h"): "b/deep/w.h", ("a/x.c", "lost/v.h"): None, ("inc/z.h", "y.h"): "a/y.h"}
    assert [(r.spelled, r.includers, r.candidate) for r in code.missing_headers(found, files).collect()] == [("lost/v.h", 1, None)]


def test_build_metadata(spark, tmp_path):
    p = tmp_path / "compile_commands.json"
    p.write_text(json.dumps([{"directory": "/w", "file": "src/a.c", "command": "cc -Iinc -I ../up -DX=1 -D 'Y=a b' -include pre.h -std=c11 -c src/a.c"}, {"directory": "/w", "file": "/b.c", "arguments": ["cc", "-isystem", "/sys"]}]))
    got = {r.file: r for r in code.compile_commands(spark, str(p)).collect()}
    a = got["/w/src/a.c"]
    assert (list(a.includes), list(a.defines), list(a.forced), a.std) == (["/w/inc", "/up"], ["X=1", "Y=a b"], ["pre.h"], "c11") and list(got["/b.c"].includes) == ["/sys"]
    p = tmp_path / "link.json"
    p.write_text(json.dumps([{"output": "app", "sources": ["a.c"], "dependencies": ["lib"]}]))
    assert {tuple(r) for r in code.link_commands(spark, str(p)).collect()} == {("app", "a.c", None), ("app", None, "lib")}
    gn = 'executable("app") {\n  sources = [ "a.c" ]  # note\n  if (x) { sources += [ "b.c" ] }\n  deps = [ ":lib" ]\n}\n'
    assert code.gn_targets(gn) == [("executable", "app", ["a.c", "b.c"], [":lib"])]
    idl = "// no\ninterface OHOS.Sample.IFoo {\n  [oneway] void Ping([in] int a);\n  String Name();\n}\n"
    assert code.idl_interfaces(idl) == [("OHOS::Sample::IFoo", "OHOS::Sample::FooProxy", "OHOS::Sample::FooStub", ["Ping", "Name"])]
    texts = spark.createDataFrame([("x.gn", gn), ("y.gn", None)], "path string, text string")
    assert code.gn_target_rows(texts).count() == 1 and code.idl_rows(texts).count() == 0
    runs = spark.createDataFrame([(1, '{"solver": {"partial": true}}')], "id long, options_json string")
    assert code.run_option(runs, "solver.partial").first()[0] == "true"
    assert code.read_filter('{"patterns": ["(?P<n>a)"]}') == ["(?<n>a)"]


def test_models_override_and_constrain(spark):
    text = '[[function]]\nname = "memcpy"\neffects = []\n[[function]]\nname = "keep"\neffects = [{kind = "content_store", a = 0, b = 1}]\n'
    table = models.overridden(models.builtin_models(spark), models.read_models(spark, text))
    calls = spark.createDataFrame([(1, "memcpy"), (2, "std::strcpy"), (3, "x::pthread_create"), (4, "std::thread"), (5, "keep"), (6, "x::strcpy"), (7, "malloc")], "call_site_id long, callee string")
    got = models.matched(calls, table)
    assert {(r.call_site_id, r.effect) for r in got.collect()} == {(2, "mem_copy"), (3, "invoke"), (4, "invoke"), (5, "content_store"), (7, "return_heap")}
    actuals = spark.createDataFrame([(2, 0, 20), (2, 1, 21), (5, 0, 50), (5, 1, 51), (3, 2, 32)], "call_site_id long, arg_index int, node long")
    results, none = spark.createDataFrame([(7, 70)], "call_site_id long, node long"), spark.createDataFrame([], "call_site_id long")
    assert rows(models.constraints(got, actuals, results, none), "kind", "dst", "src") == [("addr_of", 70, -8), ("copy", 20, 21), ("store", 50, 51)]
    assert models.constraints(got, actuals, results, results.select("call_site_id")).where("kind = 'addr_of'").count() == 0
    points = spark.createDataFrame([(32, 801)], "node long, loc long")
    assert rows(models.callbacks(got, actuals, points), "call_site_id", "callee", "context") == [(3, 801, "thread")]


def test_context_evidence(spark):
    c = spark.createDataFrame([(1, 11, 100, 200), (2, 12, 101, 201), (3, 13, 200, 202), (4, 14, 105, 203)], "id long, call_site_id long, starter long, entry long")
    calls, loops = spark.createDataFrame([(101, 102), (102, 101), (200, 300)], "a long, b long"), spark.createDataFrame([(11,)], "call_site_id long")
    got = models.context_evidence(c, calls, loops, graph.strong_components(calls))
    assert {r.id: r.multi_instance for r in got.collect()} == {1: "loop", 2: "cycle", 3: "parent", 4: None}


def test_renderers_and_command_line(spark, tmp_path):
    facts = from_rows(spark, files=FILES, functions=FUNCTIONS, call_sites=SITES, call_edges=EDGES)
    export.write_facts(facts, str(tmp_path / "db"))
    run = lambda *a: cli.main([str(tmp_path / "db"), *a], spark)
    assert run("calls", "--from", "main").splitlines()[1].split("\t")[1:4] == ["main", "helper", "direct"]
    shown = run("callgraph", "main", "--depth", "2")
    assert "* main (main.c:10)" in shown and "  -direct-> helper (main.c:22)" in shown and "    -external-> proto [external]" in shown
    assert json.loads(run("callgraph", "proto", "--up", "--format", "json"))["truncated"] is False
    assert "u103" in run("callgraph", "helper", "--format", "dot") and 'n11["helper (main.c:22)"]' in run("callgraph", "helper", "--format", "mermaid")
    assert run("callchain", "main", "proto") == "main (main.c:10) -> helper (main.c:22) -> proto [external]"
    assert run("sql", "select count(*) k from call_edges").splitlines() == ["k", "2"]
    drawing = render.Drawing(graph.call_graph(facts, 10, 1), relational.function_labels(facts))
    assert drawing.truncated and '\\"' in drawing.graphviz('a"b') and "&quot;" in drawing.mermaid('a"b')


def test_the_rest_works_without_the_text_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') for n in q); print(len(q))"], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
