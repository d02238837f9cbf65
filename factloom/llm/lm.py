"""LM scoring (6): a bigram model by deleted interpolation.

P(w | h) = a(b) c(h,w)/c(h) + u(b) c(w)/N + z(b) / (V + 1), where b is the bucket of the context's
frequency c(h) (powers of two). The mixture weights of each bucket are learned by expectation
maximisation on held-out counts: every training token is scored by the counts without itself
(c - 1), the leave-one-out form of held-out data, over all training tokens.

Counts cover all training documents. Batches of texts ask for the counts of their distinct words and
bigrams (exchange.py), so nothing but totals travels back and a hot word costs one entry a batch. EM
runs on a histogram of all training tokens by (bucket, both estimates' logarithms), with a fixed number of
cells, whose size doesn't follow the corpus. A cell stands for its tokens by their mean estimates, which
lie within a factor of 2^(1/SCALE), some 1.19, of each of theirs; weights come out alike to a few hundredths.

Null and empty texts are one end token; texts of any length are scored whole; without training rows the
model is uniform; repeated rows each count and get their row; null ids are trained on by crc32 of
"None"; other columns are ignored, whatever their names. Bigram keys are 56 bits of a hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, WordHashes, bound_batches, claim, fold, input_parts, load, materialize, mix64, text_bytes, word_hashes
from .exchange import bucket_bits, bucket_parts, frozen, pack_counts, pack_sorted, thawed, unpack_counts, unpack_sorted

OWNER = __name__
#: Bytes of text in a batch.
BATCH_BYTES = 8 << 20
START, END = b" start", b" end"  # no word holds a space
PAIR_BITS = 56
CELLS, SCALE = 120, 4  # histogram cells of a probability's logarithm, cells by factor of two
ROUNDS = 40
#: Start of EM, and the weights where a bucket has no data: bigram, unigram, uniform.
PRIOR = (0.3, 0.6, 0.1)
_words = WordHashes()


def forget() -> None:
    _words.clear()


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the text's words and of the end."""
    words = text_bytes(text).translate(ASCII_LOWER).split()
    words.append(END)
    return word_hashes(words, _words)


def pair_keys(words: np.ndarray) -> np.ndarray:
    """56-bit keys of (previous word, word); the first word's context is the start."""
    before = np.concatenate([np.array([_words[START]], np.uint64), words[:-1]])
    with np.errstate(over="ignore"):
        return mix64(before * np.uint64(0x9E3779B97F4A7C15) + words) >> np.uint64(64 - PAIR_BITS)


class Batch:
    """Distinct words and bigrams of some texts, with their training counts."""

    def __init__(self, keys: list, texts: list):
        self.keys, self.held = keys, np.array([fold(k, 5) == 1 for k in keys])
        docs = [tokens(t) for t in texts]
        self.lengths = np.array([len(d) for d in docs])
        learn = np.repeat(~self.held, self.lengths)
        self.words, self.word = np.unique(np.concatenate(docs), return_inverse=True)
        self.pairs, self.pair = np.unique(np.concatenate([pair_keys(d) for d in docs]), return_inverse=True)
        self.word_counts = np.bincount(self.word[learn], minlength=len(self.words))
        self.pair_counts = np.bincount(self.pair[learn], minlength=len(self.pairs))

    def parts(self, bits: int):
        """(ascending keys, counts, their buckets, bounds of these) of words and of bigrams, which have the upper buckets."""
        for base, keys, counts, width in ((0, self.words, self.word_counts, 64), (1 << bits, self.pairs, self.pair_counts, PAIR_BITS)):
            buckets, bounds = bucket_parts(keys, bits, width)
            yield keys, counts, (base + buckets).tolist(), bounds.tolist()


def _ask(bits: int):
    def run(table: pa.Table) -> pa.Table:
        claim(OWNER)
        batch = Batch(table["doc_id"].to_pylist(), table["text"].to_pylist())
        number, out = table["batch"][0].as_py(), []
        for keys, counts, buckets, bounds in batch.parts(bits):
            out += [(number, b, pack_sorted(keys[i:j]), pack_counts(counts[i:j])) for b, i, j in zip(buckets, bounds[:-1], bounds[1:], strict=True)]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array([r[i] for r in out], type=t) for i, t in enumerate(kinds)], names=["batch", "bucket", "keys", "counts"])

    return run


def _add(bits: int):
    def run(table: pa.Table) -> pa.Table:
        """Totals of a bucket's keys, told where they differ; for words also how many are known, and their tokens."""
        batches, bucket = table["batch"].to_pylist(), table["bucket"][0].as_py()
        keys = [unpack_sorted(k) for k in table["keys"].to_pylist()]
        counts = [unpack_counts(c, len(k)) for c, k in zip(table["counts"].to_pylist(), keys, strict=True)]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
        out, at = [], 0
        if bucket < 1 << bits:
            out.append((-1, bucket, None, None, int((total > 0).sum()), int(total.sum())))
        total = total[inverse]
        for n, k, c in zip(batches, keys, counts, strict=True):
            own = total[at : at + len(k)]
            at += len(k)
            differ = np.flatnonzero(own != c)
            if len(differ):
                out.append((n, bucket, pack_sorted(differ.astype(np.uint64)), pack_counts(own[differ]), None, None))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array([r[i] for r in out], type=t) for i, t in enumerate(kinds)], names=["batch", "bucket", "at", "totals", "known", "tokens"])

    return run


def _tell(bits: int):
    schema = pa.schema([("known", pa.int64()), ("tokens", pa.int64()), ("counts", pa.binary())])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """A batch's counts by token; the buckets' sums pass through."""
        claim(OWNER)
        if not docs.num_rows:
            return pa.Table.from_arrays([answers["known"], answers["tokens"], pa.nulls(answers.num_rows, pa.binary())], schema=schema)
        batch = Batch(docs["doc_id"].to_pylist(), docs["text"].to_pylist())
        told = {b: (at, totals) for b, at, totals in zip(*(answers[c].to_pylist() for c in ("bucket", "at", "totals")), strict=True)}
        full = []
        for _, counts, buckets, bounds in batch.parts(bits):
            total = counts.astype(np.int64)
            for b, begin in zip(buckets, bounds[:-1], strict=True):
                if b in told:
                    at, totals = told[b]
                    places = unpack_sorted(at).astype(np.int64)
                    total[begin + places] = unpack_counts(totals, len(places))
            full.append(total)
        data = frozen(keys=batch.keys, held=batch.held, lengths=batch.lengths, words=_planes(full[0][batch.word]), pairs=_planes(full[1][batch.pair]))
        return pa.Table.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([zstandard.compress(data, 1)], pa.binary())], schema=schema)

    return run


def _planes(v: np.ndarray) -> tuple:
    """Counts by byte planes: the upper ones are nearly empty and compress away."""
    kind = next(k for k in "1248" if not len(v) or int(v.max()) < 1 << 8 * int(k))
    return kind, v.astype(f"<u{kind}").view(np.uint8).reshape(-1, int(kind)).T.tobytes()


def _whole(planes: tuple) -> np.ndarray:
    kind, data = planes
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(int(kind), -1).T).view(f"<u{kind}").ravel().astype(np.int64)


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int, int]:
    """Batches with the training counts of all their tokens (written to the shared folder), V and N."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bucket_bits(input_parts(rows))
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // BATCH_BYTES)))).cast("long"))
    asked = dealt.groupBy("batch").applyInArrow(_ask(bits), "batch long, bucket int, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(_add(bits), "batch long, bucket int, at binary, totals binary, known long, tokens long")
    out = materialize(dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_tell(bits), "known long, tokens long, counts binary"))
    sums = out.agg(F.sum("known"), F.sum("tokens")).first()
    return out.where("counts is not null").select("counts"), sums[0] or 0, sums[1] or 0


def contexts(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Counts of each token's context: of the word before it, or of the starts (as many as ends) at the front."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    ends = np.cumsum(lengths)
    out[ends - lengths] = words[ends - 1]
    return out


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the logarithm's whole part."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)


def ratio(a: np.ndarray, b) -> np.ndarray:
    b = np.asarray(b, float)
    return np.divide(a, b, out=np.zeros(len(a)), where=np.broadcast_to(b, a.shape) > 0)


def _cell(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.clip(np.floor(-SCALE * np.log2(np.where(p > 0, p, 1))), 0, CELLS - 1), 0).astype(np.int64)


def held_out_histogram(counts: DataFrame, n: int) -> list:
    """Cells (bucket, bigram cell, unigram cell) of all training tokens without themselves: number, sums of both estimates."""
    schema = pa.schema([("cell", pa.int64()), ("k", pa.int64()), ("p2", pa.float64()), ("p1", pa.float64())])

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                s = thawed(zstandard.decompress(data))
                words, pairs = _whole(s["words"]), _whole(s["pairs"])
                learn = np.repeat(~s["held"], s["lengths"])
                context = contexts(words, s["lengths"])[learn] - 1
                p2, p1 = ratio(pairs[learn] - 1, context), ratio(words[learn] - 1, n - 1)
                cell = (bucket_of(context) * (CELLS + 1) + _cell(p2)) * (CELLS + 1) + _cell(p1)
                every, inverse, k = np.unique(cell, return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(k), pa.array(np.bincount(inverse, p2, len(every))), pa.array(np.bincount(inverse, p1, len(every)))], schema=schema)

    cells = counts.mapInArrow(run, "cell long, k long, p2 double, p1 double").groupBy("cell").agg(F.sum("k").alias("k"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1"))
    return cells.orderBy("cell").collect()  # at most 64 * (CELLS + 1)^2 rows, whatever the corpus


def learn_weights(cells: list, v: int) -> np.ndarray:
    """Weights [bucket, (bigram, unigram, uniform)] by EM on the cells; buckets without data take the next lower one's."""
    weights = np.tile(np.array(PRIOR), (65, 1))
    weights[0] = (0, 0.9, 0.1)
    if cells:
        cell, k = np.array([r.cell for r in cells]), np.array([r.k for r in cells], float)
        p = np.stack([np.array([r.p2 for r in cells]) / k, np.array([r.p1 for r in cells]) / k, np.full(len(k), 1 / (v + 1))], axis=1)
        bucket = cell // (CELLS + 1) ** 2
        for _ in range(ROUNDS):
            share = p * weights[bucket]
            share *= (k / share.sum(axis=1))[:, None]
            sums = np.stack([np.bincount(bucket, share[:, j], 65) for j in range(3)], axis=1)
            has = sums.sum(axis=1) > 0
            weights[has] = sums[has] / sums[has].sum(axis=1, keepdims=True)
        weights[:, 2] = np.maximum(weights[:, 2], 1e-6)
        weights /= weights.sum(axis=1, keepdims=True)
        for b in range(2, 65):
            if not has[b] and has[1:b].any():
                weights[b] = weights[b - 1]
    return weights


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row."""
    kind = docs.schema[key].dataType
    counts, v, n = counted(docs, key, text)
    weights = learn_weights(held_out_histogram(counts, n), v)
    from pyspark.sql.pandas.types import to_arrow_type

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [to_arrow_type(kind), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                s = thawed(zstandard.decompress(data))
                words, pairs, lengths = _whole(s["words"]), _whole(s["pairs"]), s["lengths"]
                context = contexts(words, lengths)
                w = weights[bucket_of(context)]
                p = w[:, 0] * ratio(pairs, context) + w[:, 1] * ratio(words, n) + w[:, 2] / (v + 1)
                starts = np.cumsum(lengths) - lengths
                base = np.log10((words + 0.5) / (n + 0.5 * (v + 1)))
                columns = [s["keys"], s["held"], lengths, np.add.reduceat((words > 0).astype(np.int64), starts), np.full(len(lengths), n), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return counts.mapInArrow(run, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm_scores(spark, sf_dir):
    return score(load(spark, sf_dir, "documents"))
