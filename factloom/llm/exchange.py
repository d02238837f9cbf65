"""Counts over a whole corpus without moving its rows: batches ask, buckets of keys add up, batches are told.

A batch (a bounded piece of the input) sends each of its distinct keys once with its own count, packed
by bucket of the key. A bucket adds the counts of all batches and answers only where the total differs
from the batch's own count. So a key that fills the corpus costs one entry a batch, no task sees more
of a key than that, and nothing grows with a hot key.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

REQUEST = "batch long, bucket int, keys binary, counts binary"
ANSWER = "batch long, bucket int, state binary, at binary, totals binary"


def pack_sorted(v: np.ndarray) -> bytes:
    """Ascending uint64 keys as differences in as few bytes as the largest needs, byte by byte in planes."""
    if not len(v):
        return b""
    d = np.diff(v)
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    planes = d.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + v[:1].tobytes() + planes.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=9).reshape(width, -1)
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, :width] = planes.T
    first = np.frombuffer(data, np.uint64, 1, 1)
    return np.cumsum(np.concatenate([first, d.reshape(-1).view(np.uint64)]), dtype=np.uint64)


def pack_counts(v: np.ndarray) -> bytes:
    """Non-negative integers in the smallest width that holds them all; nothing if all are 1."""
    if not len(v) or (v == 1).all():
        return b""
    kind = next(k for k in "1248" if int(v.max()) < 1 << 8 * int(k))
    return kind.encode() + v.astype(f"<u{kind}").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    if not data:
        return np.ones(n, np.int64)
    return np.frombuffer(data, f"<u{data[:1].decode()}", offset=1).astype(np.int64)


def bucket_parts(keys: np.ndarray, bits: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The buckets (upper bits of keys of that width) that ascending keys fall into, and where each begins, with the end."""
    bucket = (keys >> np.uint64(width - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[first].astype(np.int32), np.append(first, len(keys)).astype(np.uint32)


def requests(batch: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple]:
    """Rows of REQUEST for a batch's ascending distinct keys: as many as it has buckets, never more than keys."""
    buckets, bounds = bucket_parts(keys, bits)
    return [(batch, b, pack_sorted(keys[i:j]), pack_counts(counts[i:j])) for b, i, j in zip(buckets.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def bucket_bits(parts: int) -> int:
    """Buckets follow the number of input partitions: some for each, 64 at least, so that a bucket's size doesn't grow."""
    return min(24, max(6, (4 * parts - 1).bit_length()))


def answer_schema() -> pa.Schema:
    return pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("state", pa.binary()), ("at", pa.binary()), ("totals", pa.binary())])


def total_counts(asked: DataFrame) -> DataFrame:
    """Rows of ANSWER (state null) for rows of REQUEST; answers where the total differs from the own count."""
    schema = answer_schema()

    def add(table: pa.Table) -> pa.Table:
        batches, buckets = table["batch"].to_pylist(), table["bucket"].to_pylist()
        keys = [unpack_sorted(k) for k in table["keys"].to_pylist()]
        counts = [unpack_counts(c, len(k)) for c, k in zip(table["counts"].to_pylist(), keys, strict=True)]
        every = np.concatenate(keys)
        distinct, inverse = np.unique(every, return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)[inverse]
        out, at = [], 0
        for n, b, k, c in zip(batches, buckets, keys, counts, strict=True):
            own = total[at : at + len(k)]
            at += len(k)
            differ = np.flatnonzero(own != c)
            if len(differ):
                out.append((n, b, None, pack_sorted(differ.astype(np.uint64)), pack_counts(own[differ])))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], type=f.type) for i, f in enumerate(schema)], schema=schema)

    return asked.groupBy("bucket").applyInArrow(add, ANSWER)


def settled(own: np.ndarray, parts: tuple[np.ndarray, np.ndarray], table: pa.Table) -> np.ndarray:
    """A batch's own counts with the answers put in; parts as bucket_parts gave them."""
    total = own.astype(np.int64, copy=True)
    buckets, bounds = parts
    for b, at, totals in zip(table["bucket"].to_pylist(), table["at"].to_pylist(), table["totals"].to_pylist(), strict=True):
        if at is not None:
            places = unpack_sorted(at).astype(np.int64)
            total[int(bounds[np.searchsorted(buckets, b)]) + places] = unpack_counts(totals, len(places))
    return total


def frozen(**arrays) -> bytes:
    return pickle.dumps(arrays, protocol=5)


def thawed(data: bytes) -> dict:
    return pickle.loads(data)


def state_of(table: pa.Table) -> dict:
    return thawed(next(s for s in table["state"].to_pylist() if s is not None))
