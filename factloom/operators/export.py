"""Writers of fact sets: which rows are kept, how edges are ordered, and an all-or-nothing publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.operators.merge import dense_ids
from factloom.sources.facts import FactSet


def kept_sites(sites: DataFrame, edges: DataFrame, arg_flow: DataFrame, event_sites: DataFrame) -> DataFrame:
    """Sites with an edge, an argument flow or an event, and all indirect ones (K3)."""
    named = edges.select("call_site_id").unionByName(arg_flow.select("call_site_id")).unionByName(event_sites.select("call_site_id")).where("call_site_id is not null").distinct()
    rows = sites.join(named.select(F.col("call_site_id").alias("id"), F.lit(1).alias("__named")), "id", "left")
    return rows.where("__named = 1 or is_direct = 0").drop("__named")


def referenced_variables(variables: DataFrame, nodes: DataFrame, arg_flow: DataFrame) -> DataFrame:
    """Variables that a node or an argument flow names (K4)."""
    used = nodes.select(F.col("var_id").alias("id")).unionByName(arg_flow.select(F.col("actual_var").alias("id"))).unionByName(arg_flow.select(F.col("formal_var").alias("id")))
    return variables.join(used.where("id is not null").distinct(), "id", "left_semi")


def flow_graph(constraints: DataFrame, points_to: DataFrame, call_args: DataFrame, terminators: DataFrame) -> DataFrame:
    """Edges id, src_node, dst_node, kind in order, without repeats.

    Constraints keep their kinds; points-to pairs are derived edges; a call argument is an edge only where no copy,
    load or gep joins the pair already; terminators end a value. All but constraints have src_node, dst_node.
    """
    real = constraints.select("src_node", "dst_node", "kind")
    joined = constraints.where("kind in ('copy', 'load', 'gep')").select("src_node", "dst_node").distinct()
    args = call_args.select("src_node", "dst_node").join(joined, ["src_node", "dst_node"], "left_anti")
    rows = real
    for df, kind in ((points_to, "points_to"), (args, "call_arg"), (terminators, "terminates")):
        rows = rows.unionByName(df.select("src_node", "dst_node", F.lit(kind).alias("kind")))
    return dense_ids(rows.distinct(), ["src_node", "dst_node", "kind"]).select("id", "src_node", "dst_node", "kind")


def memory_access(rows: DataFrame, by: list[str]) -> DataFrame:
    """Access rows; a null cell goes where the statement has a real one (K6)."""
    real = F.max(F.col("cell").isNotNull().cast("int")).over(W.partitionBy(*by))
    return rows.withColumn("__real", real).where("cell is not null or __real = 0").drop("__real").distinct()


def write_facts(facts: FactSet, path: str) -> None:
    """Writes every relation below path.staging, then puts the folder in place by renames (K1, K2, K9).

    Old facts are moved aside, not deleted, before the new ones take their place, and come back if that fails; a writer
    that died between the two leaves them at path.old, where read_facts finds them. Readers never see some of both.
    """
    spark = next(iter(facts.values())).sparkSession
    path = path.rstrip("/")
    fs, (at, to, old) = _file_system(spark, f"{path}.staging", path, f"{path}.old")
    if fs.exists(old) and not fs.exists(to):
        fs.rename(old, to)
    fs.delete(at, True)
    for name, df in facts.items():
        df.write.parquet(f"{path}.staging/{name}")
    fs.delete(old, True)
    held = fs.exists(to)
    if held and not fs.rename(to, old):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(at, to):
        if held:
            fs.rename(old, to)
        raise OSError(f"can't publish {path}")
    fs.delete(old, True)


def _file_system(spark: SparkSession, *paths: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    found = [hadoop.Path(p) for p in paths]
    return found[0].getFileSystem(spark._jsc.hadoopConfiguration()), found
