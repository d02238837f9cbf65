"""Queries over models, names and text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import scalar
from factloom.operators import models as M
from factloom.plans.registry import facts_query


@facts_query("s212_name_parts", "SELECT id, CASE WHEN contains(name, '::') THEN regexp_extract(name, '^(.*)::[^:]+$', 1) ELSE '' END AS scope, list_last(string_split(name, '::')) AS last, name || '(' || signature || ' *, int)' AS shown FROM functions", "functions")
def name_parts(f):
    n = f["functions"]
    return n.select("id", scalar.qualifier(F.col("name")).alias("scope"), scalar.last_part(F.col("name")).alias("last"), scalar.signature(F.col("name"), F.array(F.concat("signature", F.lit("[4]")), F.lit("int"))).alias("shown"))


_MODELS = "m(name, effect, a, b) AS (VALUES ('f3', 'mem_copy', 0, 1), ('f7', 'invoke', 0, NULL), ('ns::C::f8', 'invoke', 1, NULL), ('f9', 'clears', 0, NULL))"


@facts_query(
    "f24_matched_models",
    f"""WITH {_MODELS}, c AS (SELECT e.id AS call_site_id, n.name AS callee FROM call_edges e JOIN functions n ON n.id = e.callee_fn_id),
    t AS (SELECT c.*, m.effect, m.a, m.b, CASE WHEN m.name = c.callee THEN 0 ELSE 4 END AS rule FROM c JOIN m ON m.name = c.callee OR (m.effect = 'invoke' AND m.name = list_last(string_split(c.callee, '::'))))
    SELECT DISTINCT call_site_id, callee, effect, a, b FROM t QUALIFY rule = min(rule) OVER (PARTITION BY call_site_id, effect)""",
    "call_edges", "functions",
)
def f24(f):
    spark = f["functions"].sparkSession
    models = spark.createDataFrame([("f3", "mem_copy", 0, 1, None), ("f7", "invoke", 0, None, None), ("ns::C::f8", "invoke", 1, None, None), ("f9", "clears", 0, None, None)], M.SCHEMA)
    calls = f["call_edges"].join(f["functions"].select(F.col("id").alias("callee_fn_id"), F.col("name").alias("callee")), "callee_fn_id").select(F.col("id").alias("call_site_id"), "callee")
    return M.matched(calls, models).drop("context")


@facts_query(
    "f31_ipc_bridges",
    """WITH n AS (SELECT id, is_defined, CASE id % 3 WHEN 0 THEN 'A' || id % 7 || 'Proxy' WHEN 1 THEN 'A' || id % 7 || 'Stub' ELSE 'A' || id % 7 || 'Client' END AS cls, CASE WHEN id % 3 = 1 AND id % 2 = 0 THEN 'OnM' || id % 5 ELSE 'M' || id % 5 END AS method FROM functions)
    SELECT DISTINCT p.id AS proxy_fn, s.id AS handler_fn FROM n p JOIN n s ON s.is_defined = 1 AND s.cls = regexp_replace(p.cls, '(Proxy|Client)$', 'Stub') AND regexp_replace(s.method, '^On', '') = p.method
    WHERE p.id % 4 = 0 AND NOT p.cls LIKE '%Stub'""",
    "functions",
)
def f31(f):
    n = f["functions"]
    cls = F.concat(F.lit("A"), F.col("id") % 7, F.when(F.col("id") % 3 == 0, "Proxy").when(F.col("id") % 3 == 1, "Stub").otherwise("Client"))
    method = F.concat(F.when((F.col("id") % 3 == 1) & (F.col("id") % 2 == 0), "OnM").otherwise("M"), F.col("id") % 5)
    return M.ipc_bridges(n.select("id", F.concat(cls, F.lit("::"), method).alias("name"), "is_defined"), n.where("id % 4 = 0").select("id"))


@facts_query("q36_sql_over_views", "SELECT a.name AS caller, count(*) AS calls FROM call_edges e JOIN functions a ON a.id = e.caller_fn_id WHERE e.resolution = 'direct' GROUP BY 1", "call_edges", "functions")
def q36(f):
    spark = f["functions"].sparkSession
    return spark.sql("SELECT a.name AS caller, count(*) AS calls FROM {call_edges} e JOIN {functions} a ON a.id = e.caller_fn_id WHERE e.resolution = 'direct' GROUP BY 1", call_edges=f["call_edges"], functions=f["functions"])
