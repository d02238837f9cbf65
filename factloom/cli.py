"""Command line over a folder of facts: python -m factloom.cli FACTS calls|callgraph|callchain|dataflow|slice|sequence|diagnostics|sql|merge ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from factloom.operators import dataflow, graph, relational, render, sequence
from factloom.sources.facts import COLUMNS, read_facts


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factloom", description=__doc__)
    p.add_argument("facts", help="folder with one Parquet table a relation")
    sub = p.add_subparsers(dest="query", required=True)
    q = sub.add_parser("calls")
    for name in ("--from", "--to", "--file"):
        q.add_argument(name, dest=name.strip("-") + "_" * (name == "--from"))
    q.add_argument("--exclude-deps", action="store_true")
    q = sub.add_parser("callgraph")
    q.add_argument("function", help="name or FILE:LINE")
    q.add_argument("--depth", type=int, default=3)
    q.add_argument("--up", action="store_true")
    q.add_argument("--format", choices=("text", "json", "dot", "mermaid"), default="text")
    q = sub.add_parser("callchain")
    q.add_argument("start")
    q.add_argument("end")
    q.add_argument("--depth", type=int, default=6)
    q.add_argument("--limit", type=int)
    q = sub.add_parser("diagnostics")
    for name in ("--stage", "--severity", "--file"):
        q.add_argument(name)
    q = sub.add_parser("dataflow", help="what the value of a variable flows into, or from")
    q.add_argument("name")
    q.add_argument("--depth", type=int, default=3)
    q.add_argument("--up", action="store_true")
    q.add_argument("--format", choices=("text", "json", "dot", "mermaid"), default="text")
    q = sub.add_parser("slice", help="where the value of a variable comes from, and where that goes")
    q.add_argument("name")
    q.add_argument("--format", choices=("text", "json"), default="text")
    q = sub.add_parser("sequence", help="calls of a function body in order")
    q.add_argument("cfg", type=int, help="the graph's id")
    q.add_argument("--first", type=int)
    q.add_argument("--last", type=int)
    q.add_argument("--format", choices=("text", "json"), default="text")
    q = sub.add_parser("merge", help="merges folders of facts into FACTS")
    q.add_argument("inputs", nargs="+")
    sub.add_parser("sql").add_argument("text", help="SQL over the relations as views")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs one query; the text it prints is returned, too."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("factloom").getOrCreate()
    if a.query == "merge":
        return merge(spark, a.facts, a.inputs)
    flow = ["functions", "variables", "flow_nodes", "flow_edges"]
    names = {"diagnostics": ["files", "diagnostics"], "sql": None, "dataflow": flow, "slice": flow, "sequence": ["cfg_events", "cfg_edges"]}.get(a.query, ["files", "functions", "call_sites", "call_edges"])
    if names is None:
        names = relations_in(spark, a.facts)
    facts = read_facts(spark, a.facts, names, strict=a.query != "sql")
    if a.query == "calls":
        out = table(relational.calls(facts, a.from_, a.to, a.file, a.exclude_deps))
    elif a.query == "diagnostics":
        out = table(relational.diagnostics(facts, a.stage, a.severity, a.file))
    elif a.query == "sql":
        facts.views(spark)
        out = table(spark.sql(a.text))
    elif a.query == "dataflow":
        starts = relational.flow_nodes_of(facts, facts["variables"].where(F.col("name") == a.name))
        found = render.Drawing(graph.dataflow_graph(facts, starts, a.depth, not a.up), relational.node_labels(facts))
        title = f"values {'into' if a.up else 'out of'} {a.name}"
        out = {"text": lambda: found.text(title), "json": found.json, "dot": lambda: found.graphviz(title), "mermaid": lambda: found.mermaid(title)}[a.format]()
    elif a.query == "slice":
        starts = relational.flow_nodes_of(facts, facts["variables"].where(F.col("name") == a.name))
        out = render.slice_text(dataflow.value_slice(facts["flow_edges"], starts), relational.node_labels(facts), a.name, a.format)
    elif a.query == "sequence":
        events, edges = facts["cfg_events"].where(F.col("cfg_id") == a.cfg), facts["cfg_edges"].where(F.col("cfg_id") == a.cfg)
        relations = sequence.event_relations(events, edges)
        out = render.sequence_text(sequence.scope_events(events, relations, a.cfg, a.first, a.last), events, relations, a.format)
    elif a.query == "callgraph":
        found = render.Drawing(graph.call_graph(facts, relational.resolve_function(facts, a.function), a.depth, not a.up), relational.function_labels(facts))
        title = f"{'callers' if a.up else 'callees'} of {a.function}"
        out = {"text": lambda: found.text(title), "json": found.json, "dot": lambda: found.graphviz(title), "mermaid": lambda: found.mermaid(title)}[a.format]()
    else:
        edges = facts["call_edges"].select("id", F.col("caller_fn_id").alias("a"), F.col("callee_fn_id").alias("b"))
        chains, cut = graph.chains(edges, relational.resolve_function(facts, a.start), relational.resolve_function(facts, a.end), a.depth, a.limit)
        out = "\n".join(render.chain_lines(chains, relational.function_labels(facts)) + ["(more chains exist)"] * cut.first()[0])
    print(out)
    return out


def relations_in(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path) if s.isDirectory()]


def merge(spark: SparkSession, out: str, inputs: list[str]) -> str:
    """Merges folders of facts and writes the result; tells the relations' sizes and the warnings."""
    from factloom.operators.export import write_facts
    from factloom.operators.merging import merge_facts

    found = merge_facts([read_facts(spark, i, [n for n in relations_in(spark, i) if n in COLUMNS or n == "link_facts"], strict=False) for i in inputs])
    write_facts(found.facts, out)
    lines = [f"{name}\t{df.count()}" for name, df in sorted(found.facts.items())]
    lines += [f"{r.severity}: {r.message}" for r in found.warnings.orderBy("kind", "message").limit(10_000).collect()]
    text = "\n".join(lines)
    print(text)
    return text


def table(df, limit: int = 10_000) -> str:
    """Tab-separated lines of at most so many rows."""
    rows = df.limit(limit).collect()
    return "\n".join(["\t".join(df.columns), *("\t".join("" if v is None else str(v) for v in r) for r in rows)])


if __name__ == "__main__":
    main()
