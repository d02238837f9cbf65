"""Queries over filters, joins, ranks and aggregates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import merge as M
from factloom.operators import relational as R
from factloom.plans.registry import facts_query

EDGES = ("files", "functions", "call_sites", "call_edges")
_CALLS = """SELECT e.id, a.name AS caller, b.name AS callee, e.resolution, coalesce(xf.path, sf.path) AS path,
    coalesce(s.expansion_line, s.line) AS line, coalesce(s.expansion_col, s.col) AS col
  FROM call_edges e JOIN functions a ON a.id = e.caller_fn_id JOIN functions b ON b.id = e.callee_fn_id
  JOIN files af ON af.id = a.file_id JOIN files bf ON bf.id = b.file_id LEFT JOIN call_sites s ON s.id = e.call_site_id
  LEFT JOIN files sf ON sf.id = s.file_id LEFT JOIN files xf ON xf.id = s.expansion_file_id"""


@facts_query("q1_calls", _CALLS, *EDGES)
def q1(f):
    return R.calls(f)


def _ranked(rows, *order):
    return M.dense_ids(rows, list(order), "rank")


@facts_query("o1_call_order", f"SELECT *, row_number() OVER (ORDER BY path IS NULL, path, line, id) AS rank FROM ({_CALLS})", *EDGES)
def o1(f):
    """The order of q1's rows as a column."""
    return _ranked(R.calls(f).withColumn("last", F.col("path").isNull()), "last", "path", "line", "id").drop("last")


@facts_query("q1_calls_between", f"{_CALLS} WHERE (a.name = 'f7' OR a.name LIKE '%::f7') AND a.is_dep = 0 AND b.is_dep = 0", *EDGES)
def q1_between(f):
    return R.calls(f, from_="f7", exclude_deps=True)


_FOLDED = "contains(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'nation_1')"


@facts_query(
    "p3_calls_in_file",
    f"{_CALLS} WHERE {_FOLDED.format('sf.path')} OR {_FOLDED.format('xf.path')} OR ({_FOLDED.format('bf.path')} AND b.line_start > 0) OR (e.call_site_id IS NULL AND {_FOLDED.format('af.path')})",
    *EDGES,
)
def p3(f):
    return R.calls(f, file="NATION_1")


@facts_query("p4_calls_to_name", f"{_CALLS} WHERE b.name = 'C::f11' OR b.name LIKE '%::C::f11'", *EDGES)
def p4(f):
    return R.calls(f, to="C::f11")


@facts_query("p11_display_filter", f"SELECT * FROM ({_CALLS}) WHERE regexp_matches(caller, '^ns::C::f1') OR regexp_matches(callee, '^ns::C::f1') OR regexp_matches(caller, 'f2[0-3]$') OR regexp_matches(callee, 'f2[0-3]$')", *EDGES)
def p11(f):
    return R.display_filter(R.calls(f), ["^ns::C::f1", "f2[0-3]$"])


_HOP = """SELECT e.id, e.{other} AS peer, CASE WHEN s.expansion_file_id = a.file_id THEN s.expansion_line WHEN s.file_id = a.file_id THEN s.line END AS line,
    CASE WHEN s.expansion_file_id = a.file_id THEN s.expansion_col WHEN s.file_id = a.file_id THEN s.col END AS col
  FROM call_edges e JOIN functions a ON a.id = e.caller_fn_id LEFT JOIN call_sites s ON s.id = e.call_site_id WHERE e.{own} = 17"""


@facts_query("q7_outgoing_calls", _HOP.format(own="caller_fn_id", other="callee_fn_id"), *EDGES)
def q7_out(f):
    return R.editor_calls(f, 17, incoming=False)


@facts_query("q7_incoming_calls", _HOP.format(own="callee_fn_id", other="caller_fn_id"), *EDGES)
def q7_in(f):
    return R.editor_calls(f, 17, incoming=True)


@facts_query("o7_editor_call_order", f"SELECT *, row_number() OVER (ORDER BY peer, line NULLS FIRST, col NULLS FIRST, id) AS rank FROM ({_HOP.format(own='caller_fn_id', other='callee_fn_id')})", *EDGES)
def o7(f):
    """The order of an editor's outgoing calls as a column."""
    return _ranked(R.editor_calls(f, 17, incoming=False), "peer", "line", "col", "id")


_DIAG = "SELECT d.id, d.stage, d.severity, f.path, d.line, d.message FROM diagnostics d LEFT JOIN files f ON f.id = d.file_id"


@facts_query("q2_diagnostics", _DIAG, "files", "diagnostics")
def q2(f):
    return R.diagnostics(f)


@facts_query("p2_diagnostics_in_file", f"{_DIAG} WHERE d.stage = 'link' AND contains(f.path, 'ion_2')", "files", "diagnostics")
def p2(f):
    return R.diagnostics(f, stage="link", file="ion_2")


_FN = "n.id, n.name, f.path, n.line_start, n.line_end, n.is_defined FROM functions n"


@facts_query("q3_functions_at", f"SELECT {_FN} JOIN files f ON f.id = n.file_id WHERE contains(lower(f.path), '/proj/') AND n.line_start <= 30 AND n.line_end >= 30 AND n.line_start > 0", "files", "functions")
def q3(f):
    return R.functions_at(f, "/Proj/", 30)


@facts_query("q4_functions_by_name", f"SELECT {_FN} LEFT JOIN files f ON f.id = n.file_id WHERE n.name = 'f20' OR n.name LIKE '%::f20'", "files", "functions")
def q4(f):
    return R.functions_by_name(f, "f20")


@facts_query("o2_function_at_line_rank", f"SELECT {_FN} JOIN files f ON f.id = n.file_id WHERE n.line_start <= 30 AND n.line_end >= 30 AND n.line_start > 0 ORDER BY n.is_defined DESC, n.line_end - n.line_start, n.name, n.id LIMIT 1", "files", "functions")
def o2(f):
    return R.functions_at(f, "", 30).limit(1)


@facts_query("o3_function_by_name_rank", f"SELECT {_FN} LEFT JOIN files f ON f.id = n.file_id WHERE n.name = 'f20' OR n.name LIKE '%::f20' ORDER BY n.is_defined DESC, n.line_end - n.line_start, n.name, n.id LIMIT 1", "files", "functions")
def o3(f):
    return R.functions_by_name(f, "f20").limit(1)


@facts_query("j12_nearest_functions", "SELECT n.id, n.name, f.path, least(abs(n.line_start - 77), abs(n.line_end - 77)) AS distance FROM functions n JOIN files f ON f.id = n.file_id WHERE n.line_start > 0 ORDER BY distance, n.name, n.id LIMIT 3", "files", "functions")
def j12(f):
    return R.nearest_functions(f, "", 77, 3)


@facts_query("j3_function_catalogue", "SELECT n.id, n.name, f.path, CASE WHEN n.target_id IS NOT NULL THEN 'target' || n.target_id END AS target FROM functions n JOIN files f ON f.id = n.file_id", "files", "functions")
def j3(f):
    return R.function_catalogue(f)


@facts_query(
    "q34_function_labels",
    "SELECT n.id, CASE WHEN n.is_defined = 0 THEN n.name || ' [external]' WHEN n.line_start > 0 THEN n.name || ' (' || split_part(f.path, '/', 3) || ':' || n.line_start || ')' ELSE n.name END AS label FROM functions n LEFT JOIN files f ON f.id = n.file_id",
    "files", "functions",
)
def q34(f):
    return R.function_labels(f)


@facts_query(
    "q8_symbols_at",
    """SELECT v.id, v.name, f.path, v.line, v.col, CASE WHEN v.line = 12 AND v.col <= 9 AND 9 < v.col + length(v.name) THEN 0 ELSE abs(v.line - 12) + 1 END AS "rank", abs(v.col - 9) AS off
    FROM variables v JOIN files f ON f.id = v.file_id WHERE v.is_synthetic = 0 AND v.line BETWEEN 10 AND 14 AND contains(f.path, 'nation_1')""",
    "files", "variables",
)
def q8(f):
    return R.symbols_at(f, "nation_1", 12, 9)


@facts_query("j5_parameter_twins", "SELECT a.id, b.id AS twin FROM variables a JOIN variables b ON a.fn_id = b.fn_id AND a.name = b.name AND a.id <> b.id WHERE a.kind = 'param' AND b.kind = 'param'", "variables")
def j5(f):
    return R.parameter_twins(f)


@facts_query("j6_touched_nodes", "SELECT src_node AS id FROM flow_edges UNION SELECT dst_node FROM flow_edges", "flow_edges")
def j6(f):
    return R.touched_nodes(f)


@facts_query(
    "q9_flow_starts",
    """WITH own AS (SELECT id FROM flow_nodes WHERE var_id IN (SELECT id FROM variables WHERE name = 'v22')),
    live AS (SELECT 1 FROM own WHERE id IN (SELECT src_node FROM flow_edges UNION SELECT dst_node FROM flow_edges)),
    twins AS (SELECT b.id FROM variables a JOIN variables b ON a.fn_id = b.fn_id AND a.name = b.name AND a.id <> b.id WHERE a.kind = 'param' AND b.kind = 'param' AND a.name = 'v22')
    SELECT id FROM own UNION SELECT id FROM flow_nodes WHERE var_id IN (SELECT id FROM twins) AND NOT EXISTS (SELECT * FROM live)""",
    "variables", "flow_nodes", "flow_edges",
)
def q9(f):
    return R.flow_nodes_of(f, f["variables"].where("name = 'v22'"))


@facts_query(
    "j7_node_labels",
    """SELECT n.id, n.kind, CASE WHEN n.kind = 'var' AND coalesce(n.label, '') = '' THEN coalesce(v.name, 'var' || coalesce(n.var_id, n.id)) ELSE n.label END AS label,
    CASE WHEN n.kind = 'var' AND coalesce(n.detail, '') = '' THEN CASE WHEN v.id IS NOT NULL THEN v.kind || ' @' || v.line || CASE WHEN f.name IS NOT NULL THEN ' in ' || f.name ELSE '' END ELSE '' END ELSE n.detail END AS detail
    FROM flow_nodes n LEFT JOIN variables v ON v.id = n.var_id LEFT JOIN functions f ON f.id = coalesce(n.fn_id, v.fn_id)""",
    "flow_nodes", "variables", "functions",
)
def j7(f):
    return R.node_labels(f)


@facts_query("j4_unresolved_sites", "SELECT id, caller_fn_id, callee_text FROM call_sites WHERE id NOT IN (SELECT call_site_id FROM call_edges WHERE call_site_id IS NOT NULL)", *EDGES)
def j4(f):
    return R.unresolved_sites(f).select("id", "caller_fn_id", "callee_text")


@facts_query(
    "a7_unresolved_leaves",
    """SELECT s.caller_fn_id, s.callee_text, f.path, s.line, s.col, -min(s.id) - 1 AS node FROM call_sites s LEFT JOIN files f ON f.id = s.file_id
    WHERE s.id NOT IN (SELECT call_site_id FROM call_edges WHERE call_site_id IS NOT NULL) GROUP BY ALL""",
    *EDGES,
)
def a7(f):
    return R.unresolved_leaves(f)


@facts_query(
    "w1_innermost_definition",
    """WITH places AS (SELECT DISTINCT file_id, line FROM call_sites),
    held AS (SELECT p.file_id, p.line, n.id, n.line_start a, n.line_end b FROM places p JOIN functions n ON n.file_id = p.file_id AND p.line BETWEEN n.line_start AND n.line_end AND n.line_start > 0),
    best AS (SELECT h.file_id, h.line, h.id FROM held h WHERE
      (SELECT count(*) FROM held o WHERE o.file_id = h.file_id AND o.line = h.line) = 1
      OR (h.line > h.a AND h.line < h.b AND NOT EXISTS (SELECT * FROM held o WHERE o.file_id = h.file_id AND o.line = h.line AND o.id <> h.id AND NOT (o.a <= h.a AND o.b >= h.b AND (o.a, o.b) <> (h.a, h.b)))))
    SELECT p.file_id, p.line, b.id AS owner FROM places p LEFT JOIN best b ON b.file_id = p.file_id AND b.line = p.line""",
    "call_sites", "functions",
)
def w1(f):
    return R.innermost(f["functions"].where("line_start > 0"), f["call_sites"])


@facts_query("a2_unique_owner", "SELECT file_id, line_start, CASE WHEN count(DISTINCT id) = 1 THEN min(name) END AS owner FROM functions GROUP BY 1, 2", "functions")
def a2(f):
    return R.unique_or_null(f["functions"], ["file_id", "line_start"], "id", "name", "owner")


@facts_query("a3_next_id", "SELECT coalesce(max(id), 0) + 1 AS next_id FROM call_edges", *EDGES)
def a3(f):
    return R.next_id(f["call_edges"])


@facts_query("a4_distinct_callees", "SELECT DISTINCT s.id AS call_site_id, e.callee_fn_id FROM call_sites s JOIN call_edges e ON e.call_site_id = s.id WHERE s.is_direct = 0", *EDGES)
def a4(f):
    return R.indirect_return_callees(f)


@facts_query("a5_resolution_counts", "SELECT CASE resolution WHEN 'ambiguous' THEN 'direct' ELSE resolution END AS resolution, count(*) AS edges FROM call_edges GROUP BY 1", *EDGES)
def a5(f):
    return R.resolution_counts(f)


@facts_query(
    "a8_unified_contexts",
    """SELECT kind, api, max(self_concurrent) AS self_concurrent,
    arg_max(multi_instance, CASE multi_instance WHEN 'loop' THEN 4 WHEN 'cycle' THEN 3 WHEN 'parent' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END) AS multi_instance FROM execution_contexts GROUP BY 1, 2""",
    "execution_contexts",
)
def a8(f):
    return R.unify_contexts(f["execution_contexts"], ["kind", "api"])


@facts_query("a9_unresolved_externals", "SELECT b.name, count(*) AS calls FROM call_edges e JOIN functions b ON b.id = e.callee_fn_id WHERE e.resolution = 'external' GROUP BY 1 ORDER BY calls DESC, name LIMIT 10", *EDGES)
def a9(f):
    return R.unresolved_externals(f, 10)


@facts_query("a10_totals", "SELECT 'files' AS relation, count(*) AS rows FROM files UNION ALL SELECT 'functions', count(*) FROM functions UNION ALL SELECT 'call_sites', count(*) FROM call_sites UNION ALL SELECT 'call_edges', count(*) FROM call_edges", *EDGES)
def a10(f):
    return R.totals(f, list(EDGES))


@facts_query("a14_message_lists", "SELECT stage, string_agg(message, ',' ORDER BY message) AS messages FROM (SELECT DISTINCT stage, message FROM diagnostics) GROUP BY 1", "files", "diagnostics")
def a14(f):
    return f["diagnostics"].groupBy("stage").agg(F.array_join(F.sort_array(F.collect_set("message")), ",").alias("messages"))


@facts_query("a15_out_degree_sizes", "SELECT count(*) AS n, min(k) AS least, quantile_disc(k, 0.5) AS middle, max(k) AS most FROM (SELECT caller_fn_id, count(*) AS k FROM call_edges GROUP BY 1)", *EDGES)
def a15(f):
    return R.size_statistics(f["call_edges"].groupBy("caller_fn_id").agg(F.count("*").alias("k")), "k")


@facts_query("u1_sites_at", "SELECT s.id FROM call_sites s JOIN files f ON f.id = s.file_id WHERE contains(f.path, 'i') AND s.line = 8 UNION SELECT s.id FROM call_sites s JOIN files f ON f.id = s.expansion_file_id WHERE contains(f.path, 'i') AND s.expansion_line = 8", *EDGES)
def u1(f):
    return R.sites_at(f, "i", 8)


@facts_query("u2_flow_and_origins", "SELECT src_node, dst_node, kind FROM flow_edges UNION ALL SELECT src_node, dst_node, kind FROM flow_origins", "flow_edges", "flow_origins")
def u2(f):
    return f["flow_edges"].unionByName(f["flow_origins"].select("src_node", "dst_node", "kind"))


@facts_query("u4_bag_difference", "SELECT *, 'left' AS side FROM (SELECT src_node, dst_node, kind FROM flow_origins EXCEPT ALL SELECT src_node, dst_node, kind FROM flow_edges) UNION ALL SELECT *, 'right' FROM (SELECT src_node, dst_node, kind FROM flow_edges EXCEPT ALL SELECT src_node, dst_node, kind FROM flow_origins)", "flow_edges", "flow_origins")
def u4(f):
    return R.bag_difference(f["flow_origins"].select("src_node", "dst_node", "kind"), f["flow_edges"])


@facts_query("j8_edges_with_origins", "SELECT e.src_node, e.dst_node, e.kind, o.file_id, o.line FROM flow_edges e LEFT JOIN flow_origins o ON (o.src_node, o.dst_node, o.kind) = (e.src_node, e.dst_node, e.kind)", "flow_edges", "flow_origins")
def j8(f):
    return R.edges_with_origins(f)


@facts_query(
    "q15_operation_names",
    "SELECT src_node, dst_node, kind, CASE kind WHEN 'copy' THEN 'assign' WHEN 'addr_of' THEN 'take address' WHEN 'load' THEN 'read' WHEN 'store' THEN 'write' WHEN 'gep' THEN 'select field' WHEN 'call_arg' THEN 'pass' ELSE kind END AS operation FROM flow_edges",
    "flow_edges",
)
def q15(f):
    return R.operation_names(f["flow_edges"])
