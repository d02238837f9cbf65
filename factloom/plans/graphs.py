"""Queries over walks and fixpoints, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import graph as G
from factloom.operators import solver as S
from factloom.operators.merge import dense_ids
from factloom.plans.registry import facts_query

EDGES = ("files", "functions", "call_sites", "call_edges")
ROOT, DEPTH = 3, 3

_BFS = """WITH walk(id, depth) AS (SELECT CAST({root} AS BIGINT), 0 UNION SELECT e.{far}, w.depth + 1 FROM walk w JOIN call_edges e ON e.{near} = w.id WHERE w.depth < {depth}),
  nodes AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""
_DOWN, _UP = _BFS.format(root=ROOT, depth=DEPTH, near="caller_fn_id", far="callee_fn_id"), _BFS.format(root=ROOT, depth=DEPTH, near="callee_fn_id", far="caller_fn_id")
_LEAVES = """leaves AS (SELECT s.caller_fn_id, s.callee_text, s.file_id, s.line, s.col, -min(s.id) - 1 AS node FROM call_sites s
  WHERE s.id NOT IN (SELECT call_site_id FROM call_edges WHERE call_site_id IS NOT NULL) GROUP BY ALL)"""


@facts_query("q5_callgraph_down_nodes", f"{_DOWN}, {_LEAVES} SELECT id, depth FROM nodes UNION ALL SELECT l.node, n.depth + 1 FROM leaves l JOIN nodes n ON n.id = l.caller_fn_id AND n.depth < {DEPTH}", *EDGES, recursive=True)
def q5_nodes(f):
    return G.call_graph(f, ROOT, DEPTH).nodes


@facts_query(
    "q5_callgraph_down_edges",
    f"""{_DOWN}, {_LEAVES} SELECT DISTINCT e.caller_fn_id AS a, e.callee_fn_id AS b, e.resolution, e.call_site_id FROM call_edges e JOIN nodes n ON n.id = e.caller_fn_id AND n.depth < {DEPTH}
    UNION ALL SELECT l.caller_fn_id, l.node, 'unresolved', NULL FROM leaves l JOIN nodes n ON n.id = l.caller_fn_id AND n.depth < {DEPTH}""",
    *EDGES, recursive=True,
)
def q5_edges(f):
    return G.call_graph(f, ROOT, DEPTH).edges


@facts_query("q5_callgraph_up_nodes", f"{_UP} SELECT id, depth FROM nodes", *EDGES, recursive=True)
def q5_up(f):
    return G.call_graph(f, ROOT, DEPTH, down=False).nodes


@facts_query("q5_callgraph_truncated", f"{_DOWN} SELECT count(*) > 0 AS truncated FROM call_edges e JOIN nodes n ON n.id = e.caller_fn_id AND n.depth = {DEPTH} WHERE e.callee_fn_id NOT IN (SELECT id FROM nodes)", *EDGES, recursive=True)
def q5_truncated(f):
    return G.call_graph(f, ROOT, DEPTH).truncated


_PATHS = """WITH step(a, b, id) AS (SELECT caller_fn_id, callee_fn_id, id FROM call_edges),
  paths(at_, nodes, edges, keys) AS (
    SELECT CAST(3 AS BIGINT), [CAST(3 AS BIGINT)], CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) UNION ALL
    SELECT s.b, list_append(p.nodes, s.b), list_append(p.edges, s.id), p.keys || [s.b, s.id] FROM paths p JOIN step s ON s.a = p.at_
    WHERE len(p.edges) < {depth} AND (p.at_ <> {end} OR len(p.edges) = 0) AND (s.b = {end} OR NOT list_contains(p.nodes, s.b))),
  done AS (SELECT CAST(len(edges) AS BIGINT) AS length, nodes, edges, keys FROM paths WHERE at_ = {end})"""
END, STEPS = 300, 4


def _edges(f):
    return f["call_edges"].select("id", F.col("caller_fn_id").alias("a"), F.col("callee_fn_id").alias("b"))


@facts_query("q6_callchains", f"{_PATHS.format(end=END, depth=STEPS)} SELECT length, nodes, edges FROM done", *EDGES, recursive=True)
def q6(f):
    return G.chains(_edges(f), 3, END, STEPS)[0]


@facts_query("o5_callchain_order", f"{_PATHS.format(end=END, depth=STEPS)} SELECT length, nodes, edges, row_number() OVER (ORDER BY length, nodes, edges) AS rank FROM done", *EDGES, recursive=True)
def o5(f):
    """The order of the chains as a column."""
    return dense_ids(G.chains(_edges(f), 3, END, STEPS)[0], ["length", "nodes", "edges"], "rank")


@facts_query("o6_callchains_limited", f"{_PATHS.format(end=END, depth=STEPS)} SELECT length, nodes, edges FROM done ORDER BY keys LIMIT 20", *EDGES, recursive=True)
def o6(f):
    return G.chains(_edges(f), 3, END, STEPS, limit=20)[0]


@facts_query("q33_chain_graph", f"{_PATHS.format(end=END, depth=STEPS)} SELECT id, CAST(min(i) - 1 AS BIGINT) AS depth FROM (SELECT unnest(nodes) AS id, unnest(range(1, len(nodes) + 1)) AS i FROM done) GROUP BY id", *EDGES, recursive=True)
def q33(f):
    return G.chain_graph(G.chains(_edges(f), 3, END, STEPS)[0])


_FLOW = """WITH walk(id, depth) AS (SELECT id, 0 FROM flow_nodes WHERE label = 'v22' UNION SELECT e.dst_node, w.depth + 1 FROM walk w JOIN flow_edges e ON e.src_node = w.id WHERE w.depth < 4),
  nodes AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""


@facts_query("q10_dataflow_nodes", f"{_FLOW} SELECT id, depth FROM nodes", "flow_nodes", "flow_edges", recursive=True)
def q10(f):
    return G.dataflow_graph(f, f["flow_nodes"].where("label = 'v22'"), 4).nodes


@facts_query("q10_dataflow_edges", f"{_FLOW} SELECT e.src_node AS a, e.dst_node AS b, e.kind FROM flow_edges e JOIN nodes n ON n.id = e.src_node AND n.depth < 4", "flow_nodes", "flow_edges", recursive=True)
def q10_edges(f):
    return G.dataflow_graph(f, f["flow_nodes"].where("label = 'v22'"), 4).edges


@facts_query(
    "q32_filtered_callgraph",
    f"""{_DOWN}, kept AS (SELECT DISTINCT e.caller_fn_id AS a, e.callee_fn_id AS b, e.resolution, e.call_site_id FROM call_edges e JOIN nodes n ON n.id = e.caller_fn_id AND n.depth < {DEPTH}
      JOIN functions x ON x.id = e.caller_fn_id JOIN functions y ON y.id = e.callee_fn_id WHERE regexp_matches(x.name, '[02468]$') OR regexp_matches(y.name, '[02468]$')) SELECT * FROM kept""",
    *EDGES, recursive=True,
)
def q32(f):
    full = G.neighbourhood(f["call_edges"].select(F.col("caller_fn_id").alias("a"), F.col("callee_fn_id").alias("b"), "resolution", "call_site_id"), f["functions"].where(f"id = {ROOT}"), DEPTH)
    return G.filter_graph(full, f["functions"].select("id", "name"), f["functions"].where(f"id = {ROOT}").select("id"), ["[02468]$"]).edges


@facts_query("f34_reachable", "WITH r(id) AS (SELECT entry_fn_id FROM execution_contexts UNION SELECT e.callee_fn_id FROM r JOIN call_edges e ON e.caller_fn_id = r.id) SELECT id FROM r", *EDGES, "execution_contexts", recursive=True)
def f34(f):
    return G.reachable(_edges(f), f["execution_contexts"].select(F.col("entry_fn_id").alias("id")).distinct())


_SCC_EDGES = "SELECT src AS a, dst AS b FROM includes"


@facts_query(
    "f33_strong_components",
    f"""WITH e AS ({_SCC_EDGES}), n AS (SELECT a AS id FROM e UNION SELECT b FROM e), r(s, t) AS (SELECT id, id FROM n UNION SELECT r.s, e.b FROM r JOIN e ON e.a = r.t)
    SELECT x.s AS id, min(x.t) AS component FROM r x JOIN r y ON y.s = x.t AND y.t = x.s GROUP BY 1""",
    "includes", recursive=True,
)
def f33(f):
    return G.strong_components(f["includes"].select(F.col("src").alias("a"), F.col("dst").alias("b")))


_UP_CLASSES = "WITH r(s, t, d) AS (SELECT derived, base, 1 FROM inheritance UNION SELECT r.s, i.base, r.d + 1 FROM r JOIN inheritance i ON i.derived = r.t WHERE r.d < 40)"


@facts_query("f37_ancestors", f"{_UP_CLASSES} SELECT s AS class_id, t AS base, CAST(min(d) AS BIGINT) AS distance FROM r WHERE s <> t GROUP BY 1, 2", "inheritance", recursive=True)
def f37(f):
    return G.ancestors(f["inheritance"])


@facts_query(
    "f38_virtual_targets",
    f"""{_UP_CLASSES}, c AS (SELECT derived AS id FROM inheritance UNION SELECT base FROM inheritance), up AS (SELECT s, t, min(d) AS d FROM (SELECT * FROM r UNION ALL SELECT id, id, 0 FROM c) GROUP BY 1, 2),
    best AS (SELECT u.s, arg_min(m.fn_id, (u.d, m.fn_id)) AS fn_id FROM up u JOIN methods m ON m.class_id = u.t AND m.name = 'm1' GROUP BY 1) SELECT DISTINCT u.t AS class_id, b.fn_id FROM up u JOIN best b ON b.s = u.s""",
    "inheritance", "methods", recursive=True,
)
def f38(f):
    return G.virtual_targets(f, "m1")


@facts_query("f39_derives_from", "WITH r(id) AS (SELECT derived FROM inheritance WHERE base = 2 UNION SELECT i.derived FROM r JOIN inheritance i ON i.base = r.id) SELECT id FROM r", "inheritance", recursive=True)
def f39(f):
    return G.derives_from(f["inheritance"], 2)


@facts_query("q35_include_reach", "WITH r(id) AS (SELECT CAST(5 AS BIGINT) UNION SELECT i.dst FROM r JOIN includes i ON i.src = r.id) SELECT id FROM r", "includes", recursive=True)
def q35(f):
    return G.reachable(f["includes"].select(F.col("src").alias("a"), F.col("dst").alias("b")), f["files"].where("id = 5").select("id"))


@facts_query(
    "q35_index_waves",
    """WITH e AS (SELECT derived, base FROM inheritance WHERE derived <> base), n AS (SELECT derived AS id FROM inheritance UNION SELECT base FROM inheritance),
    w(id, d) AS (SELECT id, 0 FROM n UNION SELECT e.derived, w.d + 1 FROM w JOIN e ON e.base = w.id) SELECT id, CAST(max(d) AS BIGINT) AS wave FROM w GROUP BY id""",
    "inheritance", recursive=True,
)
def q35_waves(f):
    e = f["inheritance"].select(F.col("derived").alias("a"), F.col("base").alias("b"))
    return G.waves(e, e.select(F.col("a").alias("id")).union(e.select(F.col("b").alias("id"))))


@facts_query("q35_include_waves", "SELECT id, CAST(NULL AS BIGINT) AS wave FROM files", "files", "includes")
def q35_include_waves(f):
    """Every file hangs on a cycle of these includes, so none has a wave."""
    return G.waves(f["includes"].select(F.col("src").alias("a"), F.col("dst").alias("b")), f["files"])


@facts_query(
    "f2_f5_points_to",
    """WITH c AS (SELECT kind, dst_node AS dst, src_node AS src FROM flow_edges WHERE kind IN ('copy', 'load', 'store', 'addr_of')), f(t, x, o, z) USING KEY (t, x, o) AS (
      SELECT 'p', dst, src, 0 FROM c WHERE kind = 'addr_of' UNION
      (SELECT 'p', c.dst, f.o, 0 FROM f JOIN c ON c.kind = 'copy' AND c.src = f.x WHERE f.t = 'p'
       UNION SELECT 'p', c.dst, m.o, 0 FROM recurring.f p JOIN c ON c.kind = 'load' AND c.src = p.x JOIN recurring.f m ON m.t = 'm' AND m.x = p.o WHERE p.t = 'p'
       UNION SELECT 'm', p.o, v.o, 0 FROM recurring.f p JOIN c ON c.kind = 'store' AND c.dst = p.x JOIN recurring.f v ON v.t = 'p' AND v.x = c.src WHERE p.t = 'p'))
    SELECT t, x, o FROM f""",
    "flow_edges", recursive=True,
)
def f2(f):
    c = f["flow_edges"].where("kind in ('copy', 'load', 'store', 'addr_of')")
    return S.solve(c.select("kind", F.col("dst_node").alias("dst"), F.col("src_node").alias("src"), F.lit(None).cast("long").alias("field"))).facts
