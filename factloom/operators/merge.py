"""Merging fact sets of many runs into one: unified rows, relinked symbols, stable ids.

Inputs are relations with a column db_idx beside their own ids. Every remap is an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.operators.blocks import block_join
from factloom.operators.loop import cut


def dense_ids(df: DataFrame, order: list[str], out: str = "id", first: int = 1) -> DataFrame:
    """Numbers rows from first in a total order, without sending them all through one task.

    Rows are dealt by range and sorted in their partitions; a partition's numbers begin behind all earlier ones.
    """
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__p": F.spark_partition_id(), "__n": F.monotonically_increasing_id()}))
    low = F.col("__n").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy("__p").agg(F.count("*").alias("k"))  # one row a partition
    starts = sizes.select("__p", (F.sum("k").over(W.orderBy("__p")) - F.col("k")).alias("__s"))
    return rows.join(F.broadcast(starts), "__p").withColumn(out, F.col("__s") + low + first).drop("__p", "__n", "__s")


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row, each value with its length before it, nulls marked."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def relation_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row, digest: of all rows as a bag, whatever their order. Row digests meet by their first two letters."""
    rows = df.select(row_digest(columns).alias("h"))
    parts = rows.groupBy(F.substring("h", 1, 2).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("d"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))


def distinct_inputs(digests: DataFrame) -> DataFrame:
    """Of inputs (db_idx, digest) with one content the first (M2)."""
    return digests.groupBy("digest").agg(F.min("db_idx").alias("db_idx"))


def unify_files(files: DataFrame) -> DataFrame:
    """Rows path, is_dep (0 if it is one's own anywhere) with new dense ids by path (M3)."""
    return dense_ids(files.groupBy("path").agg(F.min("is_dep").alias("is_dep")), ["path"]).select("id", "path", "is_dep")


def file_map(files: DataFrame, unified: DataFrame) -> DataFrame:
    """db_idx, old_id -> id."""
    return files.select("db_idx", F.col("id").alias("old_id"), "path").join(unified.select("id", "path"), "path").select("db_idx", "old_id", "id")


def function_identity(f: DataFrame) -> DataFrame:
    """Functions (db_idx, id, path, ...) with the key under which inputs share them (M5).

    Definitions: target, file, line, name, signature; declarations the same without the target; internal ones and
    those without a place stay their input's own.
    """
    text = lambda *cs: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in cs])
    own = (F.col("linkage") == "internal") | (F.col("line_start") <= 0)
    key = (
        F.when(own, F.concat(F.lit("own|"), text("db_idx", "id")))
        .when(F.col("is_defined") == 1, F.concat(F.lit("def|"), text("target_id", "path", "line_start", "name", "signature")))
        .otherwise(F.concat(F.lit("decl|"), text("path", "line_start", "name", "signature")))
    )
    return f.withColumn("identity", key)


def unify_functions(f: DataFrame) -> DataFrame:
    """One row for each identity; targets that differ become null (M5)."""
    return function_identity(f).groupBy("identity").agg(
        F.min("name").alias("name"), F.min("signature").alias("signature"), F.min("path").alias("path"), F.min("line_start").alias("line_start"), F.max("is_defined").alias("is_defined"),
        F.min("is_dep").alias("is_dep"), F.min("is_weak").alias("is_weak"), F.min("linkage").alias("linkage"), F.when(F.countDistinct("target_id") == 1, F.min("target_id")).alias("target_id"),
    )


def unify_sites(sites: DataFrame) -> DataFrame:
    """Call sites alike in caller, place and text, the k-th of an input with the k-th of another."""
    key = ["caller", "path", "line", "col", "callee_text"]
    nth = W.partitionBy("db_idx", *key).orderBy("id")
    return sites.withColumn("repeat", F.row_number().over(nth)).groupBy(*key, "repeat").agg(F.count("*").alias("inputs"), F.max("is_direct").alias("is_direct"))


def relink(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """External edges bound to definitions of other inputs.

    edges: edge_id, name, signature, target_id, resolution. definitions: def_id, name, signature, target_id, is_weak,
    origin. By name; those of the same signature if there are any, else all of the name; then those of the caller's
    own image if there are any; then strong ones over weak. One origin makes an edge direct (indirect and ipc ones
    keep their kind), several make it ambiguous; without a definition it stays as it is, with a null def_id.
    """
    ask = ["name", "signature", "target_id", "resolution"]
    asked = edges.groupBy("edge_id").agg(F.sort_array(F.collect_set(F.struct(*ask))).alias("asks"))
    classes = cut(asked.select("asks").distinct().select("asks", F.explode("asks").alias("ask")))
    d = cut(definitions.select("def_id", "name", F.struct(F.col("signature"), F.col("target_id"), F.col("is_weak")).alias("like"), "origin").where("name is not null"))
    kinds = d.groupBy("name", "like").agg(F.min("origin").alias("first"), F.max("origin").alias("last"))
    rows = classes.withColumn("name", F.col("ask.name")).join(kinds, "name", "left")
    good = lambda c, points: F.when(c, points).otherwise(0)
    rank = good(F.col("like.signature") == F.col("ask.signature"), 4) + good(F.col("like.target_id") == F.col("ask.target_id"), 2) + good(F.col("like.is_weak") == 0, 1)
    best = rows.withColumn("rank", rank).join(rows.groupBy("asks").agg(F.max(rank).alias("most")), "asks").where("rank = most")
    several = best.groupBy("asks").agg((F.min("first") < F.max("last")).alias("several"))
    asked_kind = F.col("ask.resolution")
    kind = F.when(F.col("like").isNull() | asked_kind.isin("indirect", "ipc"), asked_kind).when(F.col("several"), "ambiguous").otherwise("direct")
    bound = cut(best.join(several, "asks").select("asks", "name", "like", kind.alias("resolution")).distinct())
    found = bound.where("like is not null").join(d.select("name", "like", "def_id"), ["name", "like"]).select("asks", "def_id", "resolution").distinct()
    free = bound.where("like is null").select("asks", F.lit(None).cast(d.schema["def_id"].dataType).alias("def_id"), "resolution").distinct()
    linked = block_join(asked, found, "asks", "edge_id", "def_id", ["resolution"])
    return linked.unionByName(asked.join(free, "asks").select("edge_id", "def_id", "resolution"))


def conflicts(functions: DataFrame) -> DataFrame:
    """Names with strong definitions of several origins in more than one input."""
    strong = functions.where("is_defined = 1 and is_weak = 0 and linkage = 'external'")
    origin = F.concat_ws(":", "path", "line_start")
    rows = strong.groupBy("name", "signature").agg(F.countDistinct(origin).alias("origins"), F.countDistinct("db_idx").alias("inputs"), F.array_join(F.sort_array(F.collect_set(origin)), ",").alias("places"))
    return rows.where("origins > 1 and inputs > 1")


def stable_id(*parts: str) -> Column:
    """63 bits of the SHA-256 over the parts, each with its length before it."""
    text = F.concat(*[F.concat(F.length(F.col(p).cast("string")), F.lit(":"), F.col(p).cast("string")) for p in parts])
    digest = F.sha2(text, 256)
    top = F.conv(F.substring(digest, 1, 1), 16, 10).cast("int") % 8
    return F.conv(F.concat(F.conv(top.cast("string"), 10, 16), F.substring(digest, 2, 15)), 16, 10).cast("long")


def with_stable_ids(edges: DataFrame, *parts: str) -> DataFrame:
    """Edges with stable ids; raises when two different edges share one."""
    rows = cut(edges.withColumn("stable_id", stable_id(*parts)))
    if not rows.groupBy("stable_id").agg(F.countDistinct(*parts).alias("k")).where("k > 1").isEmpty():
        raise ValueError("two edges have one stable id")
    return rows


def carry_contexts(contexts: DataFrame, moved: DataFrame) -> DataFrame:
    """Contexts of all inputs, their entries where relinking moved them, unified (M13). moved: db_idx, entry_fn_id, new_entry."""
    from factloom.operators.relational import unify_contexts

    rows = contexts.join(moved, ["db_idx", "entry_fn_id"], "left").withColumn("entry", F.coalesce("new_entry", "entry_fn_id"))
    return unify_contexts(rows, ["kind", "entry", "api"])


def distinct_bodies(blocks: DataFrame, edges: DataFrame, owner: DataFrame) -> DataFrame:
    """Of graphs alike in structure one for each function, numbered (M14). owner: cfg_id, fn; the others as in COLUMNS."""
    b = blocks.groupBy("cfg_id").agg(F.sort_array(F.collect_list(F.struct("block", "kind"))).alias("b"))
    e = edges.groupBy("cfg_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("e"))
    shape = F.sha2(F.to_json(F.struct("b", "e")), 256)
    rows = owner.join(b, "cfg_id", "left").join(e, "cfg_id", "left").select("fn", "cfg_id", shape.alias("shape"))
    kept = rows.groupBy("fn", "shape").agg(F.min("cfg_id").alias("cfg_id"))
    return kept.withColumn("variant", F.row_number().over(W.partitionBy("fn").orderBy("cfg_id")) - 1).select("fn", "cfg_id", "variant")


def broken_references(facts, keys: list[tuple[str, str, str]]) -> DataFrame:
    """Rows relation, column, value of references without a row to refer to (K16). keys: relation, column, referred relation."""
    out = None
    for relation, column, to in keys:
        held = facts[to].select(F.col("id").alias(column))
        lost = facts[relation].where(F.col(column).isNotNull()).select(column).distinct().join(held, column, "left_anti")
        rows = lost.select(F.lit(relation).alias("relation"), F.lit(column).alias("reference"), F.col(column).cast("long").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def unify_targets(targets: DataFrame) -> DataFrame:
    """Link targets of all inputs by name and kind, with the union of their sources (M4). targets: db_idx, name, kind, source."""
    return targets.groupBy("name", "kind").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def rebind_ipc(edges: DataFrame, bindings: DataFrame) -> DataFrame:
    """IPC edges once for each function that a caller became (M15). bindings: caller_fn_id, bound."""
    rows = edges.where("resolution = 'ipc'").join(bindings, "caller_fn_id", "left")
    return rows.select("id", F.coalesce("bound", "caller_fn_id").alias("caller_fn_id"), "callee_fn_id").distinct()


def merged_diagnostics(diagnostics: DataFrame, conflicts_found: DataFrame, unresolved: DataFrame) -> DataFrame:
    """All inputs' diagnostics, each once, and the merge's own warnings."""
    own = diagnostics.select("stage", "severity", "path", "line", "message").distinct()
    nowhere = lambda df, text: df.select(F.lit("merge").alias("stage"), F.lit("warning").alias("severity"), F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("line"), F.concat(F.lit(text), F.col("name")).alias("message")).distinct()
    return own.unionByName(nowhere(conflicts_found, "several strong definitions: ")).unionByName(nowhere(unresolved, "no definition: "))


def suppress_weak(bodies: DataFrame) -> DataFrame:
    """Bodies of a name within a target without the weak ones that a strong one replaces (M18). bodies: name, target_id, is_weak."""
    strong = F.min("is_weak").over(W.partitionBy("name", "target_id"))
    return bodies.withColumn("__least", strong).where("is_weak = __least or __least is null").drop("__least")
