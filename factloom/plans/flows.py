"""Queries over bodies, dataflow and contexts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import dataflow as D
from factloom.operators import sequence as Q
from factloom.plans.registry import facts_query
from factloom.sources.facts import ADAPTER

#: One graph a user, of all their events: function-sized, however many users there are. Control enters at the first event.
ADAPTER["cfg_edges"] = """select distinct user_id cfg_id, event_id % 7 src, (event_id * 3 + user_id) % 7 dst from {events}
    union select user_id, cast(0 as bigint), min(event_id) % 7 from {events} group by user_id"""
ADAPTER["cfg_events"] = "select user_id cfg_id, event_id event, event_id % 7 block, event_id % 4 ordinal from {events}"
ADAPTER["cfg_calls"] = "select event_id event, case when event_id % 3 = 0 then cast(null as bigint) else (event_id * 7) % (select max(user_id) + 10 from {events}) end callee from {events}"
CFG = ("cfg_edges", "cfg_events")

_REACH = """reach(cfg_id, a, b) AS (SELECT cfg_id, src, dst FROM cfg_edges UNION SELECT r.cfg_id, r.a, e.dst FROM reach r JOIN cfg_edges e ON e.cfg_id = r.cfg_id AND e.src = r.b),
  without(cfg_id, gone, b) AS (SELECT DISTINCT cfg_id, n, CAST(0 AS BIGINT) FROM cfg_edges, range(1, 7) t(n) UNION SELECT w.cfg_id, w.gone, e.dst FROM without w JOIN cfg_edges e ON e.cfg_id = w.cfg_id AND e.src = w.b WHERE e.dst <> w.gone),
  live AS (SELECT cfg_id, b FROM reach WHERE a = 0 UNION SELECT cfg_id, 0 FROM cfg_edges),
  dom AS (SELECT l.cfg_id, l.b, n AS d FROM live l, range(0, 7) t(n) WHERE l.b <> n AND (l.cfg_id, n) IN (SELECT (cfg_id, b) FROM live) AND (n = 0 OR (l.cfg_id, n, l.b) NOT IN (SELECT (cfg_id, gone, b) FROM without)))"""
_RELATE = """rel AS (SELECT x.cfg_id, x.event AS a, y.event AS b,
    CASE WHEN x.block = y.block THEN CASE WHEN f.a IS NOT NULL THEN 'may_both' WHEN x.ordinal < y.ordinal THEN 'sequenced_before' WHEN x.ordinal > y.ordinal THEN 'may_follow' ELSE 'unordered' END
      WHEN f.a IS NOT NULL AND g.a IS NOT NULL THEN 'may_both' WHEN f.a IS NOT NULL THEN CASE WHEN d.d IS NOT NULL THEN 'guaranteed_before' ELSE 'may_precede' END
      WHEN g.a IS NOT NULL THEN 'may_follow' ELSE 'exclusive' END AS relation
  FROM cfg_events x JOIN cfg_events y ON x.cfg_id = y.cfg_id AND x.event < y.event
  LEFT JOIN reach f ON f.cfg_id = x.cfg_id AND f.a = x.block AND f.b = y.block LEFT JOIN reach g ON g.cfg_id = x.cfg_id AND g.a = y.block AND g.b = x.block
  LEFT JOIN dom d ON d.cfg_id = x.cfg_id AND d.b = y.block AND d.d = x.block)"""


def _relations(f):
    return Q.event_relations(f["cfg_events"], f["cfg_edges"])


def _combined(f):
    return Q.combined(_relations(f).withColumn("k", F.col("a") % 80), ["cfg_id", "k"])


@facts_query("q25_event_relations", f"WITH {_REACH}, {_RELATE} SELECT * FROM rel", *CFG, recursive=True)
def q25(f):
    return _relations(f)


@facts_query("q26_dominators", f"WITH {_REACH} SELECT cfg_id, b AS block, d AS dominator FROM dom", *CFG, recursive=True)
def q26(f):
    return Q.dominator_pairs(f["cfg_edges"])


@facts_query(
    "q28_combined_relations",
    f"""WITH {_REACH}, {_RELATE}, s AS (SELECT cfg_id, a % 80 AS k, list(DISTINCT relation) AS r FROM rel GROUP BY 1, 2)
    SELECT cfg_id, k, CASE WHEN len(r) = 1 THEN r[1] WHEN list_contains(r, 'unknown') THEN 'unknown' WHEN len(list_filter(r, lambda x: x NOT IN ('sequenced_before', 'guaranteed_before'))) = 0 THEN 'guaranteed_before'
      WHEN list_has_any(r, ['sequenced_before', 'guaranteed_before', 'may_precede', 'may_both', 'unordered']) AND list_has_any(r, ['may_follow', 'may_both', 'unordered']) THEN 'may_both'
      WHEN list_has_any(r, ['sequenced_before', 'guaranteed_before', 'may_precede', 'may_both', 'unordered']) THEN 'may_precede' WHEN list_has_any(r, ['may_follow', 'may_both', 'unordered']) THEN 'may_follow' ELSE 'exclusive' END AS relation FROM s""",
    *CFG, recursive=True,
)
def q28(f):
    return _combined(f)


@facts_query("q31_unordered_runs", "SELECT cfg_id, block, ordinal, list(event ORDER BY event) AS events FROM cfg_events GROUP BY 1, 2, 3 HAVING count(*) > 1", *CFG)
def q31(f):
    return Q.unordered_runs(f["cfg_events"])


@facts_query(
    "q29_inlined_frames",
    """WITH body AS (SELECT DISTINCT cfg_id FROM cfg_events),
    fr(cfg_id, event, depth, boundary, above) AS (SELECT CAST(20 AS BIGINT), CAST(NULL AS BIGINT), 0, CAST(NULL AS VARCHAR), [CAST(20 AS BIGINT)] UNION ALL
      SELECT c.callee, e.event, f.depth + 1, CASE WHEN c.callee IS NULL THEN 'unknown_callee' WHEN list_contains(f.above, c.callee) THEN 'recursion' WHEN b.cfg_id IS NULL THEN 'omitted_body' END, list_append(f.above, c.callee)
      FROM fr f JOIN cfg_events e ON e.cfg_id = f.cfg_id JOIN cfg_calls c ON c.event = e.event LEFT JOIN body b ON b.cfg_id = c.callee WHERE f.boundary IS NULL AND f.depth < 3)
    SELECT cfg_id, event, depth, boundary FROM fr ORDER BY depth, event NULLS FIRST, cfg_id NULLS FIRST LIMIT 32""",
    "cfg_events", "cfg_calls", recursive=True,
)
def q29(f):
    return Q.inline(f["cfg_events"], f["cfg_calls"], 20, 3)


_HIDDEN = "h AS (SELECT id FROM flow_nodes WHERE kind = 'loc' OR id % 11 = 3)"


@facts_query(
    "q11_visible_neighbourhood",
    f"""WITH {_HIDDEN}, s AS (SELECT id FROM flow_nodes WHERE label = 'v22'),
    w(id, level) AS (SELECT id, 0 FROM s UNION SELECT e.dst_node, w.level + CASE WHEN w.id IN (SELECT id FROM h) OR w.id IN (SELECT id FROM s) THEN 0 ELSE 1 END FROM w JOIN flow_edges e ON e.src_node = w.id
      WHERE w.level + CASE WHEN w.id IN (SELECT id FROM h) OR w.id IN (SELECT id FROM s) THEN 0 ELSE 1 END <= 3) SELECT id, min(level) AS level FROM w GROUP BY id""",
    "flow_nodes", "flow_edges", recursive=True,
)
def q11(f):
    e = f["flow_edges"].select(F.col("src_node").alias("a"), F.col("dst_node").alias("b"))
    n = f["flow_nodes"]
    return D.visible_neighbourhood(e, n.where("label = 'v22'").select("id"), n.where("kind = 'loc' or id % 11 = 3").select("id"), 3)


@facts_query(
    "q12_collapsed_edges",
    f"""WITH {_HIDDEN}, w(a, b, op) AS (SELECT src_node, dst_node, kind FROM flow_edges WHERE src_node NOT IN (SELECT id FROM h) UNION
      SELECT w.a, e.dst_node, unnest([w.op, e.kind]) FROM w JOIN flow_edges e ON e.src_node = w.b WHERE w.b IN (SELECT id FROM h))
    SELECT a, b, string_agg(DISTINCT op, ',' ORDER BY op) AS operations FROM w WHERE b NOT IN (SELECT id FROM h) GROUP BY 1, 2""",
    "flow_nodes", "flow_edges", recursive=True,
)
def q12(f):
    e = f["flow_edges"].select(F.col("src_node").alias("a"), F.col("dst_node").alias("b"), F.col("kind").alias("operation"))
    return D.collapse_hidden(e, f["flow_nodes"].where("kind = 'loc' or id % 11 = 3").select("id"))


@facts_query(
    "q18_value_slice",
    """WITH e AS (SELECT DISTINCT src_node AS a, dst_node AS b FROM flow_edges WHERE kind IN ('copy', 'call_arg')), st AS (SELECT id FROM flow_nodes WHERE label = 'v22'), up(id) AS (SELECT id FROM st UNION SELECT e.a FROM up JOIN e ON e.b = up.id),
    src AS (SELECT id FROM up WHERE id NOT IN (SELECT b FROM e) UNION SELECT id FROM st), down(id) AS (SELECT id FROM src UNION SELECT e.b FROM down JOIN e ON e.a = down.id)
    SELECT coalesce(u.id, d.id) AS id, CASE WHEN u.id IS NULL THEN 'down' WHEN d.id IS NULL THEN 'up' ELSE 'both' END AS side FROM up u FULL JOIN down d ON u.id = d.id""",
    "flow_nodes", "flow_edges", recursive=True,
)
def q18(f):
    return D.value_slice(f["flow_edges"], f["flow_nodes"].where("label = 'v22'").select("id"))


@facts_query(
    "q20_memory_edges",
    "SELECT DISTINCT src_node, dst_node, 'mem_write' AS kind FROM flow_edges WHERE kind = 'store' UNION SELECT DISTINCT src_node, dst_node, 'mem_read' FROM flow_edges WHERE kind = 'load'",
    "flow_edges",
)
def q20(f):
    e = f["flow_edges"].where("kind in ('load', 'store')")
    return D.memory_edges(e.select("kind", F.col("src_node").alias("src"), F.col("dst_node").alias("dst"), F.when(F.col("kind") == "store", F.col("dst_node")).otherwise(F.col("src_node")).alias("cell")))


_CONTEXTS = """WITH e AS (SELECT src AS a, dst AS b FROM includes), c AS (SELECT id + 1 AS id, id * 4 % 25 AS entry, self_concurrent FROM execution_contexts),
  st(fn, context) AS (SELECT entry, id FROM c UNION SELECT e.b, st.context FROM st JOIN e ON e.a = st.fn),
  r(s, t) AS (SELECT id, id FROM files UNION SELECT r.s, e.b FROM r JOIN e ON e.a = r.t),
  roots AS (SELECT id FROM files f WHERE NOT EXISTS (SELECT * FROM r WHERE r.t = f.id AND r.s <> f.id AND NOT EXISTS (SELECT * FROM r q WHERE q.s = f.id AND q.t = r.s)) AND id NOT IN (SELECT entry FROM c)),
  ro(fn) AS (SELECT id FROM roots UNION SELECT e.b FROM ro JOIN e ON e.a = ro.fn), sets AS (SELECT fn, context FROM st UNION SELECT fn, 0 FROM ro)"""


def _sets(f, contexts):
    e = f["includes"].select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return D.context_sets(contexts.select("id", "entry"), e, f["files"])


def _crossing(f, contexts):
    nodes = f["variables"].select(F.col("id").alias("node"), F.col("file_id").alias("fn"))
    return D.cross_context(nodes, _sets(f, contexts), contexts.where("self_concurrent = 1").select("id"))


def _contexts(f):
    """Every context, its id one up: 0 is the context of the roots."""
    return f["execution_contexts"].select((F.col("id") + 1).alias("id"), (F.col("id") * 4 % 25).alias("entry"), "self_concurrent")


@facts_query("q21_context_sets", f"{_CONTEXTS} SELECT fn, context FROM sets", "files", "includes", "execution_contexts", recursive=True)
def q21(f):
    return _sets(f, _contexts(f))


@facts_query(
    "q22_cross_context",
    f"""{_CONTEXTS} SELECT v.id AS node, array_to_string(list_sort(list(DISTINCT s.context)), ',') AS contexts, count(DISTINCT s.context) > 1 OR max(CASE WHEN s.context IN (SELECT id FROM c WHERE self_concurrent = 1) THEN 1 END) IS NOT NULL AS crosses
    FROM variables v JOIN sets s ON s.fn = v.file_id GROUP BY 1""",
    "files", "includes", "execution_contexts", "variables", recursive=True,
)
def q22(f):
    return _crossing(f, _contexts(f))


ADAPTER["cfg_event_sites"] = "select event_id event, event_id * 8 + 1 + event_id % 7 call_site_id from {events}"
ADAPTER["cfg_functions"] = "select user_id cfg_id, user_id % 50 fn_id, min(event_id) % 25 tu_file_id, cast(floor(user_id / 50) as bigint) variant from {events} group by user_id"
ADAPTER["cfg_blocks"] = "select user_id cfg_id, event_id % 7 block, min(event_id) % 25 file_id from {events} group by user_id, event_id % 7"


@facts_query(
    "j9_event_targets",
    """SELECT DISTINCT v.cfg_id, v.event, e.callee_fn_id, f.name, e.resolution, f.is_defined, f.is_dep FROM cfg_events v JOIN cfg_event_sites s ON s.event = v.event
    JOIN call_edges e ON e.call_site_id = s.call_site_id JOIN functions f ON f.id = e.callee_fn_id""",
    "cfg_events", "cfg_event_sites", "call_edges", "functions",
)
def j9(f):
    return Q.event_targets(f["cfg_events"], f["cfg_event_sites"], f["call_edges"], f["functions"])


@facts_query(
    "j10_variants_in_file",
    """SELECT g.cfg_id, g.fn_id, g.variant FROM cfg_functions g LEFT JOIN files t ON t.id = g.tu_file_id WHERE contains(t.path, 'nation_1')
    OR EXISTS (SELECT 1 FROM cfg_blocks b JOIN files x ON x.id = b.file_id WHERE b.cfg_id = g.cfg_id AND contains(x.path, 'nation_1'))""",
    "cfg_functions", "cfg_blocks", "files",
)
def j10(f):
    return Q.variants_in(f["cfg_functions"], f["cfg_blocks"], f["files"], "NATION_1")


@facts_query(
    "q30_events_from",
    f"""WITH {_REACH}, {_RELATE}, r AS (SELECT * FROM rel WHERE cfg_id = 20), c AS (SELECT min(event) AS e FROM cfg_events WHERE cfg_id = 20)
    SELECT e AS event FROM c UNION SELECT b FROM r, c WHERE a = e AND relation IN ('sequenced_before', 'guaranteed_before', 'may_precede', 'may_both', 'unordered')
    UNION SELECT a FROM r, c WHERE b = e AND relation IN ('may_follow', 'may_both', 'unordered')""",
    *CFG, recursive=True,
)
def q30(f):
    first = f["cfg_events"].where("cfg_id = 20").agg(F.min("event")).first()[0]
    own = Q.event_relations(f["cfg_events"].where("cfg_id = 20"), f["cfg_edges"].where("cfg_id = 20"))
    return Q.scope_events(f["cfg_events"], own, 20, first=first)
