"""Toxicity (9): a convolutional text classifier over hashed word embeddings, trained here in numpy.

A word's vector is the mean of the hashed embeddings of the word and of its prefixes, so unseen forms
of a known stem are read too. Filters of several widths slide over the words; the two strongest
responses of each filter (max pooling with k = 2) feed a logistic layer. Thresholds are calibrated by
language on rows held back from training; the language is guessed from the text's own function words,
and the calibrated score maps each language's threshold to DECISION, so one cut fits all.

Training takes a bounded sample of labelled rows: at most SAMPLE_PER_CLASS of each class, those with
the smallest hashed ids. Every text is scored whole. Null and empty texts get the score of a text
without words; null labels or ids are not learned from; without both classes every score is the base
rate; repeated rows each get their row; other columns are ignored, whatever their names. Texts are read
whole; a long one's windows are pooled piece by piece, so only its words and their numbers are held at once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, claim, fold, give_back, load, map_rows, trim

OWNER = __name__
SAMPLE_PER_CLASS = 2500
BUCKETS, WIDTH, FILTERS, SPANS = 1 << 17, 12, 8, (1, 2, 3)
PREFIXES = (3, 4, 5, 6, 7)
EPOCHS, BATCH, RATE = 6, 32, 0.08
DECISION = 0.7
POOL = 2
MEMO_LIMIT = 150_000
#: Words that are scored at once; a longer text goes piece by piece.
WORDS_AT_ONCE = 1 << 15
#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the and of to in is that it with for was on are by this be",
    "de": "der die und das nicht ist von mit dem den ein eine sich zu auf",
    "fr": "le la les des et est que qui une dans pour pas sur du avec",
    "es": "el los las que y del una por con para se como su al no",
}
LANGUAGES = (*FUNCTION_WORDS, "other")
_MARKS = {w: k for k, words in reversed(list(enumerate(FUNCTION_WORDS.values()))) for w in words.split()}


def stem(token: str) -> str:
    """The token without what isn't a letter at its ends."""
    letters = [i for i, c in enumerate(token) if c.isalpha()]
    return token[letters[0] : letters[-1] + 1] if letters else ""


class Vocabulary:
    """Token -> rows of the embedding table and language mark, remembered up to a bound."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((1024, 1 + len(PREFIXES)), np.int32)
        self.mark = np.zeros(1024, np.int8)

    def row(self, token: str) -> int:
        n = len(self.memo)
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.mark = np.concatenate([self.mark, np.zeros_like(self.mark)])
        word = stem(token)
        self.rows[n, 0] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        self.rows[n, 1:] = [zlib.crc32(f"{p}:{word[:p]}".encode("utf-8", "surrogatepass")) % BUCKETS for p in PREFIXES]
        self.mark[n] = _MARKS.get(word, len(FUNCTION_WORDS))
        self.memo[token] = n
        return n

    def indexes(self, text: str | None) -> np.ndarray:
        """Numbers of the text's tokens; rows and mark have what belongs to them."""
        tokens = text.lower().split() if text else []
        found = list(map(self.memo.get, tokens))
        if None in found:
            found = [self.memo[w] if w in self.memo else self.row(w) for w in tokens]
        return np.array(found, np.int64)

    def language(self, found: np.ndarray) -> int:
        votes = np.bincount(self.mark[found], minlength=len(LANGUAGES))[: len(FUNCTION_WORDS)]
        return int(votes.argmax()) if votes.any() else len(FUNCTION_WORDS)

    def trim(self) -> None:
        if len(self.memo) > MEMO_LIMIT:
            self.clear()


def _empty_model(seed: int) -> dict:
    rng = np.random.default_rng(seed)
    return {
        "table": rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32),
        "kernels": [rng.normal(0, 0.4, (span, WIDTH, FILTERS)).astype(np.float32) for span in SPANS],
        "bias": [np.zeros(FILTERS, np.float32) for _ in SPANS],
        "out": rng.normal(0, 0.3, (len(SPANS), POOL, FILTERS)).astype(np.float32),
        "base": np.float32(-1.0),
        "limits": [0.5] * len(LANGUAGES),
    }


#: Zero vectors after every text: its windows may reach into them, so that each text has POOL windows at least.
PAD = max(SPANS) + POOL - 1


def laid_out(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Where each text starts, the place of every word, and the length of all texts with their padding."""
    starts = np.concatenate([[0], np.cumsum(lengths + PAD)[:-1]]).astype(np.int64)
    before = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return starts, np.repeat(starts, lengths) + np.arange(int(lengths.sum())) - before, int((lengths + PAD).sum())


def pooled(model: dict, vectors: np.ndarray, starts: np.ndarray, lengths: np.ndarray, places: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """hidden[text, span, pool, filter] and the places of the POOL strongest windows of each text and filter (if asked for)."""
    n, total = len(starts), len(vectors)
    hidden = np.empty((n, len(SPANS), POOL, FILTERS), np.float32)
    where = np.empty((n, len(SPANS), POOL, FILTERS), np.int64)
    sizes = np.diff(np.append(starts, total))
    outside = np.arange(total) - np.repeat(starts + lengths + POOL - 1, sizes) >= 0
    for k, span in enumerate(SPANS):
        r = vectors @ model["kernels"][k][0]
        for j in range(1, span):
            r[: total - j] += vectors[j:] @ model["kernels"][k][j]
        r += model["bias"][k]
        r[outside] = -np.inf
        r = np.ascontiguousarray(r.T)
        for f in range(FILTERS):
            own = r[f]
            for p in range(POOL):
                best = np.maximum.reduceat(own, starts)
                hidden[:, k, p, f] = best
                if not places and p == POOL - 1:
                    break
                at = np.flatnonzero(own == np.repeat(best, sizes))
                text = np.searchsorted(starts, at, side="right") - 1
                first = at[np.flatnonzero(np.diff(text, prepend=-1))]
                where[:, k, p, f] = first
                own[first] = -np.inf
    return np.maximum(hidden, 0), where


def strongest(model: dict, rows: list[np.ndarray]) -> np.ndarray:
    """hidden[text, span, pool, filter] of texts given as rows of the table; long ones piece by piece."""
    lengths = np.array([len(r) for r in rows], np.int64)
    out = np.empty((len(rows), len(SPANS), POOL, FILTERS), np.float32)
    short = np.flatnonzero(lengths <= WORDS_AT_ONCE)
    if len(short):
        starts, places, total = laid_out(lengths[short])
        vectors = np.zeros((total, WIDTH), np.float32)
        if len(places):
            vectors[places] = embed(model["table"], np.concatenate([rows[n] for n in short]))
        out[short], _ = pooled(model, vectors, starts, lengths[short], places=False)
    for n in np.flatnonzero(lengths > WORDS_AT_ONCE):
        tops = []
        for begin in range(0, len(rows[n]), WORDS_AT_ONCE):
            part = rows[n][begin : begin + WORDS_AT_ONCE + max(SPANS) - 1]
            last = begin + WORDS_AT_ONCE >= len(rows[n])
            own = embed(model["table"], part)
            own = np.concatenate([own, np.zeros((PAD, WIDTH), np.float32)]) if last else own
            # Windows begin within the piece; those of the last piece may reach into the padding.
            windows = len(rows[n]) - begin if last else WORDS_AT_ONCE - (POOL - 1)
            tops.append(pooled(model, own, np.zeros(1, np.int64), np.array([windows]), places=False)[0][0])
        every = np.concatenate(tops, axis=1)
        out[n] = np.sort(every, axis=1)[:, ::-1][:, :POOL]
    return out


def raw_scores(model: dict, rows: list[np.ndarray]) -> np.ndarray:
    """Uncalibrated scores of texts given as rows of the table."""
    if not rows:
        return np.zeros(0)
    z = np.einsum("nspf,spf->n", strongest(model, rows), model["out"]) + model["base"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def embed(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = table[rows[:, 0]]
    for c in range(1, rows.shape[1]):
        out += table[rows[:, c]]
    return out / np.float32(rows.shape[1])


def train(texts: list, labels: list[int], seed: int = 7) -> dict:
    """Fits the filters on four fifths of the rows and the thresholds by language on the rest."""
    model = _empty_model(seed)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        rate = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
        model["out"][:] = 0
        model["base"] = np.float32(np.log(rate / (1 - rate)))
        return model
    vocabulary = Vocabulary()
    found = [vocabulary.indexes(t) for t in texts]
    languages = [vocabulary.language(i) for i in found]
    docs, every_row = [i.astype(np.int32) for i in found], vocabulary.rows[: len(vocabulary.memo)].copy()
    del found
    vocabulary.clear()
    held = np.array([zlib.crc32(f"calibrate:{n}".encode()) % 5 == 0 for n in range(len(docs))])
    if len(set(y[~held])) < 2:
        held[:] = False
    learn = np.flatnonzero(~held)
    weight = float(np.sqrt((y[learn] == 0).sum() / max(1, (y[learn] == 1).sum())))
    rng = np.random.default_rng(seed)
    speed: dict = {}

    def step(name, value, gradient, at=...):
        """Adagrad."""
        total = speed.setdefault(name, np.full_like(value, 1e-3))
        total[at] += gradient**2
        value[at] -= RATE * gradient / np.sqrt(total[at])

    table, kernels, out = model["table"], model["kernels"], model["out"]
    for _ in range(EPOCHS):
        order = rng.permutation(learn)
        for begin in range(0, len(order), BATCH):
            batch = order[begin : begin + BATCH]
            lengths = np.array([len(docs[n]) for n in batch], np.int64)
            starts, places, total = laid_out(lengths)
            vectors, rows = np.zeros((total, WIDTH), np.float32), np.full((total, 1 + len(PREFIXES)), -1, np.int64)
            if len(places):
                rows[places] = every_row[np.concatenate([docs[n] for n in batch])]
                vectors[places] = embed(table, rows[places])
            hidden, where = pooled(model, vectors, starts, lengths)
            z = np.einsum("nspf,spf->n", hidden, out) + model["base"]
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) * np.where(y[batch] == 1, weight, 1) / len(batch)
            err = err.astype(np.float32)
            back = err[:, None, None, None] * out * (hidden > 0)  # text, span, pool, filter
            touched, pulls = [], []
            for k, span in enumerate(SPANS):
                b, at = back[:, k].reshape(-1, FILTERS), where[:, k].reshape(-1, FILTERS)
                old = kernels[k].copy()
                gradient = np.empty_like(old)
                for j in range(span):
                    place = np.minimum(at + j, total - 1)
                    gradient[j] = np.einsum("nfw,nf->wf", vectors[place], b)
                    real = (rows[place, 0] >= 0) & (b != 0)
                    touched.append(rows[place[real]])
                    pulls.append((old[j].T[None] * b[:, :, None])[real])
                step(f"kernel{k}", kernels[k], gradient)
                step(f"bias{k}", model["bias"][k], b.sum(axis=0))
            step("out", out, np.einsum("n,nspf->spf", err, hidden) + np.float32(1e-5) * out)
            base = np.array([model["base"]], np.float32)
            step("base", base, np.array([err.sum()], np.float32))
            model["base"] = base[0]
            rows_hit, pull = np.concatenate(touched), np.concatenate(pulls) / (1 + len(PREFIXES))
            if len(rows_hit):
                every, inverse = np.unique(rows_hit, return_inverse=True)
                inverse, sums = inverse.reshape(rows_hit.shape), np.zeros((len(every), WIDTH), np.float32)
                for c in range(rows_hit.shape[1]):
                    np.add.at(sums, inverse[:, c], pull)
                step("table", table, sums, every)
    tested = np.flatnonzero(held) if held.any() else learn
    scores = np.concatenate([raw_scores(model, [every_row[docs[n]] for n in tested[i : i + BATCH]]) for i in range(0, len(tested), BATCH)])
    calibrate(model, [(float(p), languages[n], int(y[n])) for p, n in zip(scores, tested, strict=True)])
    return model


def calibrate(model: dict, rows: list[tuple[float, int, int]]) -> None:
    """For each language, the threshold with the best F1 on the rows held back (of all rows where it has few)."""

    def best(chosen) -> float:
        chosen = sorted(chosen, reverse=True)
        positives = sum(y for *_, y in chosen)
        if positives < 5:
            return -1.0
        top, limit, hits = -1.0, -1.0, 0
        for n, (p, _, y) in enumerate(chosen, 1):
            hits += y
            follow = chosen[n][0] if n < len(chosen) else 0.0
            f1 = 2 * hits / (n + positives)
            if f1 > top and follow < p:
                top, limit = f1, (p + follow) / 2
        return float(np.clip(limit, 0.05, 0.95))

    overall = best(rows)
    overall = 0.5 if overall < 0 else overall
    for g in range(len(LANGUAGES)):
        limit = best([r for r in rows if r[1] == g])
        model["limits"][g] = overall if limit < 0 else limit


def calibrated(p: float, limit: float) -> float:
    """Maps the language's threshold to DECISION, 0 to 0 and 1 to 1."""
    return DECISION * p / limit if p < limit else DECISION + (1 - DECISION) * (p - limit) / (1 - limit)


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> dict:
    """Trains on at most per_class labelled rows of each class whose crc32(key) mod 3 is not 1."""
    ids = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).where("k is not null and y is not null")
    ids = ids.where(F.crc32(F.col("k").cast("string")) % 3 != 1).groupBy("k").agg(F.max("y").alias("y"))
    ids = ids.withColumn("h", F.xxhash64("k"))
    picked = ids.where("y <> 0").orderBy("h", "k").limit(per_class).unionByName(ids.where("y = 0").orderBy("h", "k").limit(per_class))
    chosen = {r.k: int(r.y != 0) for r in picked.collect()}  # bounded by 2 * per_class
    if not chosen:
        return train([], [])
    spark = docs.sparkSession
    small = spark.createDataFrame([(k,) for k in chosen], f"k {docs.schema[key].dataType.simpleString()}")
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(F.broadcast(small), "k").groupBy("k").agg(F.min("t").alias("t")).collect()
    rows.sort(key=lambda r: r.k)
    model = train([r.t for r in rows], [chosen[r.k] for r in rows])
    rows.clear()
    trim()  # the driver keeps the model only
    return model


_shared: dict = {}


def forget() -> None:
    _shared.clear()


def _scored(model: dict, texts: list) -> list[tuple[float, int]]:
    """(calibrated score, guessed language) of each text."""
    vocabulary, out = _shared.setdefault("vocabulary", Vocabulary()), []
    found: list[np.ndarray] = []
    held = 0

    def settle():
        nonlocal held
        guessed = [vocabulary.language(i) for i in found]
        raw = raw_scores(model, [vocabulary.rows[i] for i in found])
        out.extend((calibrated(float(p), model["limits"][g]), g) for p, g in zip(raw, guessed, strict=True))
        found.clear()
        held = 0
        vocabulary.trim()

    for t in texts:
        found.append(vocabulary.indexes(t))
        held += len(found[-1]) + PAD
        if held >= WORDS_AT_ONCE:
            settle()
    if found:
        settle()
    return out


def score_toxicity(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted, language (guessed): one row per input row."""
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(keys, texts):
        found = _scored(sent.value, texts)
        return [keys, [fold(k, 3) == 1 for k in keys], [p for p, _ in found], [int(p >= DECISION) for p, _ in found], [LANGUAGES[g] for _, g in found]]

    return map_rows(docs, [key, text], f"`{key}` {kind}, held_out boolean, score double, predicted int, language string", run)


def tag(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The input with a column __toxic (0 or 1): the decision on each row, without a join."""
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), names.index(text)
    return map_rows(docs, names, f"{schema}, __toxic int", lambda *columns: [*columns, [int(s >= DECISION) for s, _ in _scored(sent.value, columns[at])]])


def accepted(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The rows that the classifier doesn't reject, their columns as they are, whatever their names; repeated rows stay repeated."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)
    bound_batches(docs.sparkSession)

    def run(batches):
        claim(OWNER)
        for b in batches:
            yield b.filter(pa.array([s < DECISION for s, _ in _scored(sent.value, b.column(at).to_pylist())], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, load(spark, sf_dir, "labels")))
