"""The runtime of iterative operators: rounds over deltas, with lineage cut by files in a shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has at most so many rows.
BROADCAST_ROWS = 500_000
#: Deltas that a growing table is read from at most.
COMPACT_EVERY = 8
#: Rows that one partition of an intermediate table should hold.
ROWS_A_PART = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of this machine, but only under a local master."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "/tmp/checkpoints/factloom"
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of the path, the path) in the JVM."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def scratch(spark: SparkSession) -> str:
    """A path for a new intermediate table, in a folder of this application's that goes when it ends."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    files, place = _file_system(spark, folder)
    if not files.exists(place):
        files.mkdirs(place)
        files.deleteOnExit(place)
    return f"{folder}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written and reread: later plans start at its files, and a lost executor loses nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that cut() made and that no plan will read again."""
    path = df.__dict__.pop("_scratch", None)
    if path:
        files, place = _file_system(df.sparkSession, path)
        files.delete(place, True)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """cut() and the number of rows, observed while they are written: no second job counts them."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def compact(df: DataFrame, rows: int) -> DataFrame:
    """As few partitions as the rows need, so that unions of many rounds don't pile up small ones."""
    return df.coalesce(max(1, -(-rows // ROWS_A_PART)))


def unknown(found: DataFrame, known: DataFrame, total: int, keys: list[str], few: bool) -> DataFrame:
    """found without rows that known (total rows) has by keys. few: found is thought small, so known is searched for its rows and not shuffled."""
    if total <= BROADCAST_ROWS or not few:
        return found.join(hinted(known.select(*keys), total), keys, "left_anti")
    found, n = cut_counted(found)
    if n > BROADCAST_ROWS:
        return found.join(known.select(*keys), keys, "left_anti")
    held = known.select(*keys).join(F.broadcast(found.select(*keys)), keys, "left_semi")
    return found.join(F.broadcast(held), keys, "left_anti")


def grow(start: DataFrame, step: Callable[[DataFrame, DataFrame, int], DataFrame], keys: list[str], limit: int | None = None) -> tuple[DataFrame, int]:
    """Semi-naive closure: step(delta, known, round) proposes rows, new ones by keys become the next delta.

    Returns all rows and the number of rounds. limit bounds the rounds. Deltas are kept as they are and put together
    every COMPACT_EVERY rounds; what they were made of is deleted then.
    """
    return grow_behind(start, step, keys, limit)[:2]


def grow_behind(start: DataFrame, step: Callable[[DataFrame, DataFrame, int], DataFrame], keys: list[str], limit: int | None = None, before: tuple[DataFrame, int] | None = None) -> tuple[DataFrame, int, int]:
    """grow() and the number of rows; before: rows that are known already, and how many. They are neither proposed again nor returned."""
    first = start.dropDuplicates(keys)
    known, total = cut_counted(unknown(first, *before, keys, False) if before else first)
    delta, rounds, parts = known, 0, [known]
    new = total
    while new and (limit is None or rounds < limit):
        rounds += 1
        found = step(hinted(delta, new), known, rounds).dropDuplicates(keys)
        held = known.select(*keys).unionByName(before[0].select(*keys)) if before else known
        delta, new = cut_counted(unknown(found, held, total + (before[1] if before else 0), keys, new * 4 <= BROADCAST_ROWS))
        total += new
        if new:
            parts.append(delta)
            known = known.unionByName(delta)
            if len(parts) > COMPACT_EVERY:
                known, old = cut(compact(known, total)), parts
                parts = [known]
                for part in old:
                    if part is not delta:
                        discard(part)
    return known, rounds, total
