"""Several fact sets into one in a single call (M1): unified files, functions, sites and contexts, relinked calls, diagnostics and a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import merge as M
from factloom.operators.loop import cut
from factloom.sources.facts import FactSet

#: Warnings of a merge with their severities.
SEVERITY = {
    "multiple_definitions": "warning", "unresolved_external": "info", "weak_override": "info", "duplicate_input": "warning",
    "missing_execution_contexts": "info", "missing_sequencing": "info", "missing_linking_facts": "info",
}
#: Relations of which an older input may have none, and the warning that says so.
OPTIONAL = {"execution_contexts": "missing_execution_contexts", "cfg_events": "missing_sequencing", "link_facts": "missing_linking_facts"}
_WARNING = "kind string, symbol string, message string"


@dataclass
class Merged:
    """facts, and warnings (kind, severity, symbol, message)."""

    facts: FactSet
    warnings: DataFrame


def input_digest(facts: FactSet) -> str:
    """One text for an input's content: equal for equal relations, whatever their order."""
    parts = []
    for name in sorted(facts):
        df = facts[name]
        parts.append(f"{name}:{M.relation_digest(df, sorted(df.columns)).first()[0]}")
    return "|".join(parts)


def merge_facts(inputs: list[FactSet]) -> Merged:
    """Merges inputs; equal ones count once. Ids are new, dense, and don't hang on the order of rows.

    Needed relations: files, functions, call_sites, call_edges, diagnostics; others are optional. External edges are bound to
    definitions of any input, by name, signature, image and strength (merge.relink).
    """
    if not inputs:
        raise ValueError("nothing to merge")
    spark = next(iter(inputs[0].values())).sparkSession
    seen: dict[str, int] = {}
    said, kept = [], []
    for n, facts in enumerate(inputs):  # one row an input comes to the driver
        first = seen.setdefault(input_digest(facts), n)
        if first == n:
            kept.append((n, facts))
        else:
            said.append(("duplicate_input", None, f"input {n} is input {first} again"))
    for name, kind in OPTIONAL.items():
        have = [n for n, f in kept if name in f]
        if have:
            said += [(kind, None, f"input {n} has no {name}") for n, f in kept if name not in f]

    def every(name: str) -> DataFrame | None:
        rows = [f[name].withColumn("db_idx", F.lit(n)) for n, f in kept if name in f]
        out = rows[0] if rows else None
        for r in rows[1:]:
            out = out.unionByName(r, allowMissingColumns=True)
        return out

    files = every("files")
    unified_files = cut(M.unify_files(files))
    file_of = cut(M.file_map(files, unified_files))
    at_file = lambda df, column, out: df.join(file_of.select("db_idx", F.col("old_id").alias(column), F.col("id").alias(out)), ["db_idx", column], "left")

    functions = M.function_identity(every("functions").join(files.select("db_idx", F.col("id").alias("file_id"), "path"), ["db_idx", "file_id"], "left"))
    functions = cut(functions)
    unified = cut(M.dense_ids(M.unify_functions(functions), ["identity"]))
    ends = functions.groupBy("identity").agg(F.max("line_end").alias("line_end"))
    new_functions = unified.join(ends, "identity").join(unified_files.select(F.col("id").alias("file_id"), "path"), "path", "left")
    function_of = cut(functions.join(unified.select("identity", F.col("id").alias("new_id")), "identity").select("db_idx", F.col("id").alias("old_id"), "new_id"))
    at_function = lambda df, column, out: df.join(function_of.select("db_idx", F.col("old_id").alias(column), F.col("new_id").alias(out)), ["db_idx", column], "left")

    place = ["caller", "file", "line", "col", "x_file", "expansion_line", "expansion_col", "callee_text", "is_direct"]
    sites = at_file(at_file(at_function(every("call_sites"), "caller_fn_id", "caller"), "file_id", "file"), "expansion_file_id", "x_file")
    from pyspark.sql import Window as W

    sites = cut(sites.withColumn("repeat", F.row_number().over(W.partitionBy("db_idx", *place).orderBy("id"))))
    keyed = M.dense_ids(sites.select(*place, "repeat").distinct(), [*place, "repeat"], "new_id")
    keyed = cut(keyed)
    same = [sites[c].eqNullSafe(keyed[c]) for c in (*place, "repeat")]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    site_of = cut(sites.join(keyed, condition).select(sites["db_idx"], sites["id"].alias("old_id"), keyed["new_id"]))
    new_sites = keyed.select(F.col("new_id").alias("id"), F.col("caller").alias("caller_fn_id"), F.col("file").alias("file_id"), "line", "col", "callee_text", "is_direct", F.col("x_file").alias("expansion_file_id"), "expansion_line", "expansion_col")

    def at_site(df: DataFrame) -> DataFrame:
        moved = df.join(site_of.select("db_idx", F.col("old_id").alias("call_site_id"), F.col("new_id").alias("site")), ["db_idx", "call_site_id"], "left")
        return moved.drop("call_site_id").withColumnRenamed("site", "call_site_id")

    edges = at_site(at_function(at_function(every("call_edges"), "caller_fn_id", "caller"), "callee_fn_id", "callee"))
    edges = cut(edges.select("call_site_id", F.col("caller").alias("caller_fn_id"), F.col("callee").alias("callee_fn_id"), "resolution").distinct().withColumn("edge_id", F.monotonically_increasing_id()))
    named = unified.select(F.col("id").alias("callee_fn_id"), "name", "signature")
    images = unified.select(F.col("id").alias("caller_fn_id"), "target_id")
    outside = edges.where("resolution = 'external'").join(named, "callee_fn_id").join(images, "caller_fn_id").select("edge_id", "name", "signature", "target_id", "resolution")
    definitions = unified.where("is_defined = 1 and linkage = 'external'").select(F.col("id").alias("def_id"), "name", "signature", "target_id", "is_weak", F.concat_ws(":", "path", "line_start").alias("origin"))
    bound = cut(M.relink(outside, definitions))
    relinked = edges.join(bound.withColumnRenamed("resolution", "found"), "edge_id", "left")
    relinked = relinked.select("call_site_id", "caller_fn_id", F.coalesce("def_id", "callee_fn_id").alias("callee_fn_id"), F.coalesce("found", "resolution").alias("resolution")).distinct()
    new_edges = M.dense_ids(relinked, ["caller_fn_id", "call_site_id", "callee_fn_id", "resolution"])

    warn = lambda df, kind, text: df.select(F.lit(kind).alias("kind"), F.col("name").alias("symbol"), F.concat(F.lit(text), F.col("name")).alias("message")).distinct()
    strong_and_weak = functions.where("is_defined = 1 and linkage = 'external'").groupBy("name").agg(F.min("is_weak").alias("low"), F.max("is_weak").alias("high")).where("low = 0 and high = 1")
    lost = relinked.where("resolution = 'external'").join(named, "callee_fn_id")
    warnings = spark.createDataFrame(said, _WARNING).unionByName(warn(M.conflicts(functions), "multiple_definitions", "several strong definitions: "))
    warnings = warnings.unionByName(warn(strong_and_weak, "weak_override", "a strong definition replaces a weak one: ")).unionByName(warn(lost, "unresolved_external", "no definition: "))
    table = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    warnings = cut(warnings.select("kind", F.element_at(table, F.col("kind")).alias("severity"), "symbol", "message"))

    own = at_file(every("diagnostics"), "file_id", "file").select("stage", "severity", F.col("file").alias("file_id"), F.col("line").cast("long").alias("line"), "message").distinct()
    merge_stage = warnings.select(F.lit("merge").alias("stage"), "severity", F.lit(None).cast("long").alias("file_id"), F.lit(0).cast("long").alias("line"), "message")
    diagnostics = M.dense_ids(own.unionByName(merge_stage).distinct(), ["stage", "severity", "file_id", "line", "message"])

    hashes = files.groupBy("path").agg(F.when(F.countDistinct("sha256") == 1, F.min("sha256")).otherwise("").alias("sha256"))  # of differing copies none
    out = {"files": unified_files.join(hashes, "path").select("id", "path", "sha256", "is_dep"), "functions": new_functions.drop("identity", "path"), "call_sites": new_sites, "call_edges": new_edges, "diagnostics": diagnostics}
    contexts = every("execution_contexts")
    if contexts is not None:
        from factloom.operators.relational import unify_contexts

        moved = at_site(at_function(contexts, "entry_fn_id", "entry")).drop("entry_fn_id").withColumnRenamed("entry", "entry_fn_id")
        unified_contexts = unify_contexts(moved, ["kind", "entry_fn_id", "call_site_id", "api"])
        out["execution_contexts"] = M.dense_ids(unified_contexts, ["kind", "entry_fn_id", "call_site_id", "api"])
    return Merged(FactSet({k: cut(v) for k, v in out.items()}), warnings)
