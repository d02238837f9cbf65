"""Queries over positions, targets, bindings and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import dataflow as D
from factloom.operators import merge as M
from factloom.operators import relational as R
from factloom.operators import sequence as Q
from factloom.plans.registry import facts_query


@facts_query(
    "q23_sharing",
    """SELECT n.id, CASE WHEN n.kind = 'var' AND v.kind IN ('global', 'file_static', 'fn_static') THEN 'shared' WHEN n.kind = 'constant' THEN 'constant'
      WHEN n.kind = 'loc' AND n.detail IN ('function', 'string_lit') THEN 'constant' WHEN n.kind = 'loc' AND (n.detail = 'local' OR n.detail = 'field' AND v.kind IN ('local', 'param')) THEN 'private'
      WHEN n.kind = 'loc' THEN 'shared' ELSE 'private' END AS sharing FROM (SELECT id, CASE WHEN id % 31 = 6 THEN 'constant' ELSE kind END AS kind, detail, coalesce(var_id, CASE WHEN kind = 'loc' THEN id % 1500 END) AS var_id FROM flow_nodes) n
    LEFT JOIN variables v ON v.id = n.var_id""",
    "flow_nodes", "variables",
)
def q23(f):
    v = f["variables"].select(F.col("id").alias("var_id"), F.col("kind").alias("var_kind"))
    n = f["flow_nodes"].select("id", F.when(F.col("id") % 31 == 6, "constant").otherwise(F.col("kind")).alias("kind"), F.col("detail").alias("loc_kind"), F.coalesce("var_id", F.when(F.col("kind") == "loc", F.col("id") % 1500)).alias("var_id"))
    return D.sharing(n.join(v, "var_id", "left"))


@facts_query("q14_assignment_targets", "SELECT id, CASE WHEN id % 4 = 0 THEN 'x[' || id || ']' WHEN id % 4 = 1 THEN 'p->q' WHEN id % 4 = 2 THEN 'n' END AS target FROM functions", "functions")
def q14(f):
    i = F.col("id")
    text = F.when(i % 4 == 0, F.concat(F.lit("x["), i, F.lit("] = f(\"a = b\");"))).when(i % 4 == 1, F.lit("p->q /* = */ += 2;")).when(i % 4 == 2, F.lit("n <<= 1")).otherwise(F.lit("if (a == b) g();"))
    return f["functions"].select("id", D.assignment_target(text).alias("target"))


@facts_query(
    "q17_slice_starts",
    """WITH h AS (SELECT id, 9 - col AS off, 'variable' AS meaning, 0 AS r FROM variables WHERE file_id = 3 AND line = 12 AND col <= 9 AND 9 < col + length(name)
      UNION ALL SELECT id, 9 - col, 'call', 1 FROM call_sites WHERE file_id = 3 AND line = 12 AND col <= 9 AND 9 < col + length(callee_text))
    SELECT id, CAST(min(off) AS BIGINT) AS off, arg_min(meaning, (off, r)) AS meaning FROM h GROUP BY id""",
    "variables", "call_sites",
)
def q17(f):
    at = lambda df, text: df.select("id", "file_id", "line", "col", F.length(text).alias("width"))
    return D.slice_start({"variable": at(f["variables"], "name"), "call": at(f["call_sites"], "callee_text")}, 3, 12, 9)


@facts_query(
    "q24_events_at",
    "SELECT id * 3 AS event, id AS call_site_id FROM call_sites WHERE (file_id = 5 AND line = 8) OR (expansion_file_id = 5 AND expansion_line = 8)",
    "call_sites",
)
def q24(f):
    s = f["call_sites"]
    return Q.events_at(s.select((F.col("id") * 3).alias("event"), F.col("id").alias("call_site_id")), s, 5, 8).select("event", "call_site_id")


@facts_query("m4_unified_targets", "SELECT 't' || target_id AS name, linkage AS kind, string_agg(DISTINCT path, ',' ORDER BY path) AS sources FROM m_functions WHERE target_id IS NOT NULL GROUP BY 1, 2", "files", "functions", "m_functions")
def m4(f):
    rows = f["m_functions"].where("target_id is not null")
    return M.unify_targets(rows.select("db_idx", F.concat(F.lit("t"), "target_id").alias("name"), F.col("linkage").alias("kind"), F.col("path").alias("source")))


def _rebound(f, bound, callers):
    return M.rebind_ipc(f["call_edges"], bound.select((F.col("id") % callers).alias("caller_fn_id"), F.col("id").alias("bound")))


@facts_query("m15_rebound_ipc_edges", "SELECT DISTINCT e.id, coalesce(f.id, e.caller_fn_id) AS caller_fn_id, e.callee_fn_id FROM call_edges e LEFT JOIN functions f ON f.id % (SELECT count(*) FROM supplier) = e.caller_fn_id WHERE e.resolution = 'ipc'", "call_edges", "functions")
def m15(f):
    return _rebound(f, f["functions"], f["execution_contexts"].count())


@facts_query(
    "m16_merged_diagnostics",
    """SELECT DISTINCT d.stage, d.severity, f.path, d.line, d.message FROM diagnostics d LEFT JOIN files f ON f.id = d.file_id
    UNION SELECT 'merge', 'warning', NULL, 0, 'several strong definitions: ' || name FROM functions WHERE id % 90 = 0 UNION SELECT 'merge', 'warning', NULL, 0, 'no definition: ' || name FROM functions WHERE id % 80 = 0""",
    "files", "functions", "diagnostics",
)
def m16(f):
    return M.merged_diagnostics(R.diagnostics(f), f["functions"].where("id % 90 = 0"), f["functions"].where("id % 80 = 0"))


@facts_query("m18_strong_bodies", "SELECT id, name FROM functions QUALIFY is_weak = min(is_weak) OVER (PARTITION BY name, target_id)", "functions")
def m18(f):
    return M.suppress_weak(f["functions"]).select("id", "name")


@facts_query("x2_sites_without_noise", "SELECT id FROM call_sites WHERE NOT regexp_matches(callee_text, '^f1') AND NOT regexp_matches(callee_text, '7$')", "call_sites")
def x2(f):
    return R.without_noise(f["call_sites"], ["^f1", "7$"]).select("id")


@facts_query("x12_coverage", "SELECT f.path, count(*) AS arms, CAST(sum(s.is_direct) AS BIGINT) AS taken, CAST(floor(100 * sum(s.is_direct) / count(*)) AS BIGINT) AS percent FROM call_sites s JOIN files f ON f.id = s.file_id GROUP BY 1", "call_sites", "files")
def x12(f):
    return R.coverage(f["call_sites"].join(f["files"].select(F.col("id").alias("file_id"), "path"), "file_id").withColumnRenamed("is_direct", "taken"))
