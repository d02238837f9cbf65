"""Shared plumbing of the text operators: Arrow mapping, hashing, checkpoint folders."""

from __future__ import annotations

import ctypes
import gc
import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.loop import cut, cut_counted, discard, scratch  # noqa: F401  used by the operators

#: Bytes that one Arrow batch sent to a Python worker may hold; long texts make batches short.
BATCH_BYTES = 4 << 20

#: Lower-cases A-Z and leaves every other byte alone.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes, so that a batch of very long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


_owner = ""


def claim(module: str) -> None:
    """Called where a Python worker takes up an operator's work: what the other operators remember there is dropped.

    Workers serve stage after stage. Each module's forget() drops its memos; freed memory goes back to the system.
    """
    global _owner
    if module == _owner:
        return
    _owner = module
    for name, other in list(sys.modules.items()):
        if name.startswith(f"{__package__}.") and name != module and hasattr(other, "forget"):
            other.forget()
    trim()


def trim() -> None:
    """Collects garbage and gives freed memory back to the system."""
    gc.collect()
    give_back()


def give_back() -> None:
    """Gives freed memory back to the system, where the platform can. Cheap: called at the end of a task, so that idle workers are small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def relieve_driver(spark: SparkSession) -> str:
    """The driver's garbage is collected and freed memory goes back to the system, in Python and in its JVM; the JVM's answer, if any.

    Called between the steps of an operator of many jobs: their plans, broadcasts and native buffers would pile up otherwise.
    """
    trim()
    jvm = spark._jvm
    jvm.System.gc()

    def array(kind, *values):
        out = spark.sparkContext._gateway.new_array(kind, len(values))
        for k, v in enumerate(values):
            out[k] = v
        return out

    try:  # by reflection: the server's own class is closed to callers
        named, objects, strings = jvm.java.lang.Class.forName, array(jvm.Object), array(jvm.String)
        kinds = array(jvm.java.lang.Class, *map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        invoke = named("javax.management.MBeanServer").getMethod("invoke", kinds)
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return str(invoke.invoke(server, array(jvm.Object, commands, "systemTrimNativeHeap", objects, strings)))
    except Py4JError:  # a JVM without that command
        return ""


def map_rows(df: DataFrame, columns: list[str], schema: str, fn: Callable[..., list]) -> DataFrame:
    """Runs fn(list per column) -> list per output column over Arrow batches of the named columns."""
    bound_batches(df.sparkSession)
    fields = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    owner = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        for batch in batches:
            if batch.num_rows:
                out = fn(*(c.to_pylist() for c in batch.columns))
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, arrow, strict=True)], schema=arrow)
                del out
        give_back()

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, fields)


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def fold(key: object, modulus: int) -> int:
    """crc32 of the key's decimal text, by which rows are held out."""
    return zlib.crc32(str(key).encode()) % modulus


#: Writes a table below the shared folder and reads it back: lineage ends there, and lost executors lose nothing.
materialize = cut


def input_parts(df: DataFrame) -> int:
    """Partitions of the scan below df: a size-following number that costs no job."""
    return max(1, df.rdd.getNumPartitions())


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 on uint64 arrays; spreads any difference over all bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound that keeps a worker's memory flat."""

    LIMIT = 120_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT and len(word) < 64:
            self[word] = value
        return value


def word_hashes(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive 64-bit hash of every n consecutive word hashes (whole sequence when shorter)."""
    if not len(words):
        return words
    n = min(n, len(words))
    m = len(words) - n + 1
    out = np.full(m, n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + m])
    return out
