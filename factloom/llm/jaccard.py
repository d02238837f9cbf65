"""N-gram Jaccard join (2): T-occurrence search with DivideSkip over inverted lists of 5-word shingles.

Two documents link if 100 * shared >= 75 * united shingles. The join is exact and never emits all pairs
of a group:

1. Equal sets become one (sid: the set's 128-bit digest). Of each set the smallest hashes are counted
   over the corpus; a set that could link must share enough of them, the rest go.
2. What is left counts all its shingles; a set that shares fewer than three quarters goes. Shingles are
   ordered by frequency, then hash, and only a set's first size - T + 1 are keys: linked sets share one.
3. Sets meet the smallest set of their keys (that of most keys), in blocks of bounded size. Every link is found by
   a search of the block's inverted index: short lists are merged, long ones probed by bisection, sets
   that reach the needed overlap are joined. The block's first set searches first, then those it left apart.
4. Keys whose sets lie in different components are searched again in full: families of sets that such keys
   connect at once if they are small, else in pairs of bounded pieces (the largest families key by key); pieces
   of one component skip each other. A set counts at a key only if, were the key the first that it shares with
   another set, enough would be left of it for the key's smallest set: sets that differ from a large group in
   too many places to link with it drop out there, and don't meet it piece by piece.

Null and empty texts have no shingles and link with nothing; texts of any length are read whole; with
fewer than five words the whole sequence is the one shingle; repeated rows are equal sets, each gets its
row; null ids stay null; empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, WordHashes, bound_batches, claim, cut_counted, discard, give_back, input_parts, load, materialize, ngram_hashes, relieve_driver, text_bytes, word_hashes
from .components import connected_components
from .exchange import bucket_bits, bucket_parts, frozen, pack_counts, pack_sorted, requests, settled, state_of, total_counts, unpack_counts, unpack_sorted

WORDS, PERCENT = 5, 75
OWNER = __name__
#: Sets in a block at most (besides the first).
BLOCK = 256
#: Sets that are searched as one family at most; families of up to WIDE sets are searched in pairs of pieces, larger
#: ones key by key, each key's sets in pairs of pieces.
FAMILY, WIDE = 384, 16_384
#: Rows of (id, sid) that are broadcast at most; beyond, the join shuffles.
BROADCAST_ROWS = 2_000_000
_words = WordHashes()


def forget() -> None:
    _words.clear()


def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Ascending distinct hashes of a text's shingles."""
    words = text_bytes(text).translate(ASCII_LOWER).split()
    return np.unique(ngram_hashes(word_hashes(words, _words), n))


def needed(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n shares with any set it links to, at least."""
    return -(-n * percent // 100)


def linked(shared: int, n: int, m: int, percent: int = PERCENT) -> bool:
    return 100 * shared >= percent * (n + m - shared)


def overlap_needed(n: int, m: int, percent: int = PERCENT) -> int:
    return -(-percent * (n + m) // (100 + percent))


def set_id(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def parted(sids: bytes) -> list[bytes]:
    """Set ids that were put one after the other."""
    return [sids[i : i + 16] for i in range(0, len(sids), 16)]


def spare(n: int) -> int:
    """How many shared shingles beyond one the first stage asks for: an eighth of the set."""
    return n // 8


def batch_number(counter: int) -> int:
    return TaskContext.get().partitionId() << 24 | counter


def scan_sets(docs: DataFrame, bits: int) -> DataFrame:
    """Rows for documents (doc_id, n, sid), batches' states, and their requests for the smallest hashes' counts."""
    bound_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.binary()), ("batch", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("state", pa.binary())])

    def run(batches):
        claim(OWNER)
        for counter, b in enumerate(batches):
            number, rows, sets = batch_number(counter), [], {}
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingle_set(text)
                sid = set_id(s) if len(s) else None
                rows.append((key, len(s), sid, None, None, None, None, None))
                if len(s):
                    sets.setdefault(sid, s)
            if sets:
                sizes = np.array([len(s) for s in sets.values()])
                firsts = [s[: len(s) - needed(len(s)) + 1 + spare(len(s))] for s in sets.values()]
                keys, inverse, counts = np.unique(np.concatenate(firsts), return_inverse=True, return_counts=True)
                state = frozen(sids=b"".join(sets), sizes=sizes, firsts=np.array([len(f) for f in firsts], np.uint32), key=inverse.astype(np.uint32), counts=pack_counts(counts), parts=bucket_parts(keys, bits))
                rows.append((None, None, None, number, -1, None, None, state))
                rows += [(None, None, None, *r, None) for r in requests(number, keys, counts, bits)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)
        give_back()

    return docs.mapInArrow(run, "doc_id long, n long, sid binary, batch long, bucket int, keys binary, counts binary, state binary")


def told(states: DataFrame, answers: DataFrame, fn, schema: str) -> DataFrame:
    """fn over each batch: its state and the answers to its requests."""
    own = states.selectExpr("batch", "bucket", "state", "cast(null as binary) at", "cast(null as binary) totals")
    return own.unionByName(answers).groupBy("batch").applyInArrow(fn, schema)


def _likely(table: pa.Table) -> pa.Table:
    s = state_of(table)
    total = settled(unpack_counts(s["counts"], int(s["parts"][1][-1])), s["parts"], table)
    owner = np.repeat(np.arange(len(s["firsts"])), s["firsts"])
    shared = np.bincount(owner, weights=total[s["key"]] > 1, minlength=len(s["sizes"]))
    least = -(-s["sizes"] * PERCENT // 100) // 8 + 1  # a partner may be that much smaller, and asks for an eighth of itself
    sids = parted(s["sids"])
    return pa.table({"sid": pa.array([sids[i] for i in np.flatnonzero(shared >= least)], pa.binary())})


def scan_shared(sets: DataFrame, bits: int) -> DataFrame:
    """Batches of sets: states and requests for the counts of all their shingles."""
    bound_batches(sets.sparkSession)
    schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("state", pa.binary())])

    def run(batches):
        claim(OWNER)
        for counter, b in enumerate(batches):
            if not b.num_rows:
                continue
            own = [np.frombuffer(s, np.uint64) for s in b.column(1).to_pylist()]
            keys, inverse, counts = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
            state = frozen(sids=b"".join(b.column(0).to_pylist()), sizes=np.array([len(s) for s in own]), key=inverse.astype(np.uint32), keys=pack_sorted(keys), counts=pack_counts(counts), parts=bucket_parts(keys, bits))
            number = batch_number(counter)
            rows = [(number, -1, None, None, state), *((*r, None) for r in requests(number, keys, counts, bits))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)
        give_back()

    return sets.mapInArrow(run, "batch long, bucket int, keys binary, counts binary, state binary")


def _keyed(table: pa.Table) -> pa.Table:
    """Sets that share enough: their shared shingles, and the rarest of them as keys."""
    s = state_of(table)
    every = unpack_sorted(s["keys"])
    total = settled(unpack_counts(s["counts"], len(every)), s["parts"], table)
    out, at = [], 0
    for sid, n in zip(parted(s["sids"]), s["sizes"].tolist(), strict=True):
        k = s["key"][at : at + n]
        at += n
        common = k[total[k] > 1]
        if len(common) < needed(n):
            continue
        keys = every[common]
        order = np.lexsort((keys, total[common]))
        first = n - needed(n) + 1 - (n - len(common))
        out.append((sid, n, keys.tobytes(), keys[order[:first]].view(np.int64)))
    kinds = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    return pa.Table.from_arrays([pa.array([r[i] for r in out], type=t) for i, t in enumerate(kinds)], names=["sid", "n", "shared", "keys"])


class InvertedIndex:
    """Inverted lists over the sets of a block, searched by DivideSkip."""

    #: How strongly long lists are skipped (mu of the method).
    MU = 0.02

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.sizes = np.asarray(sizes, np.int64)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        #: The lists, one behind the other by token; each ascends.
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[order]
        self.tokens, starts = np.unique(every[order], return_index=True)
        self.bounds = np.append(starts, len(every))

    def lists(self, query: np.ndarray) -> list[tuple[int, int]]:
        """Where the lists of the query's tokens begin and end, short ones first."""
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        begin, end = self.bounds[at], self.bounds[at + 1]
        order = np.argsort(end - begin, kind="stable")
        return list(zip(begin[order].tolist(), end[order].tolist(), strict=True))

    def search(self, query: np.ndarray, size: int, wanted) -> list[int]:
        """Sets that link to the query, among those for which wanted(i) holds; each once, ascending."""
        least = needed(size)
        if not len(self.tokens) or len(lists := self.lists(query)) < least:
            return []
        longest = lists[-1][1] - lists[-1][0]
        skipped = min(least - 1, len(lists), int(least / (self.MU * np.log2(longest + 1) + 1)))
        short, long = lists[: len(lists) - skipped], lists[len(lists) - skipped :][::-1]
        merged = np.sort(np.concatenate([self.owner[a:b] for a, b in short]), kind="stable")
        starts = np.flatnonzero(np.diff(merged, prepend=-1))
        counts = np.diff(np.append(starts, len(merged)))
        enough = counts >= least - skipped
        found, counts = merged[starts[enough]], counts[enough]
        chosen = np.fromiter((wanted(i) for i in found.tolist()), bool, len(found))
        found, counts = found[chosen], counts[chosen]
        t = overlap_needed(size, self.sizes[found])
        for left, (a, b) in zip(range(skipped, 0, -1), long, strict=True):
            open_ = np.flatnonzero((counts < t) & (counts + left >= t))  # neither settled nor out of reach
            if not len(open_):
                break
            owners = self.owner[a:b]
            at = np.minimum(np.searchsorted(owners, found[open_]), len(owners) - 1)
            counts[open_] += owners[at] == found[open_]
        return found[counts >= t].tolist()


def join_block(sids: list, sizes: list[int], sets: list[np.ndarray], groups: list) -> list[tuple]:
    """Edges (sid, sid) that connect all sets of the block that links connect, given groups known to be connected."""
    n = len(sids)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    seen: dict = {}
    for i, g in enumerate(groups):
        root[find(i)] = find(seen.setdefault(g, i))
    edges = []
    if len(seen) < 2:
        return edges
    index = InvertedIndex(sets, sizes)

    def ask(i: int) -> None:
        for j in index.search(sets[i], sizes[i], lambda j: find(j) != find(i)):
            a, b = find(j), find(i)
            if a != b:
                root[a] = b
                edges.append((sids[i], sids[j]))

    ask(0)
    tops = [find(i) for i in range(n)]
    counts: dict[int, int] = {}
    for t in tops:
        counts[t] = counts.get(t, 0) + 1
    if len(counts) > 1:
        main = max(counts, key=lambda t: (counts[t], -t))
        for i in range(1, n):
            if tops[i] != main:  # a link between two groups is found from its smaller side
                ask(i)
    return edges


def _search(table: pa.Table) -> pa.Table:
    order = np.lexsort((table["sid"].to_numpy(), ~table["first"].to_numpy(zero_copy_only=False)))
    rows = table.take(pa.array(order))
    sets = [np.frombuffer(s, np.uint64) for s in rows["shared"].to_pylist()]
    edges = join_block(rows["sid"].to_pylist(), rows["n"].to_pylist(), sets, rows["group"].to_pylist())
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def keyed_sets(cand: DataFrame) -> DataFrame:
    """A row for each key of a set: sid, token, n, and reach, the largest set that can link if this is the first key that both share."""
    keys = cand.select("sid", "n", F.length("shared").alias("bytes"), F.posexplode("keys").alias("at", "token"))
    return keys.select("sid", "token", "n", F.expr(f"(bytes div 8 - at) * {100 + PERCENT} div {PERCENT} - n").alias("reach"))


def within_reach(keys: DataFrame) -> DataFrame:
    """The rows of keyed_sets whose reach holds a set of the same key; two linked sets both stay at the first key that they share."""
    smallest = keys.groupBy("token").agg(F.min("n").alias("smallest"), F.count("*").alias("k")).where("k > 1").select("token", "smallest")
    return keys.join(smallest, "token").where("reach >= smallest").select("sid", "token")


def similar_sets(cand: DataFrame) -> DataFrame:
    """Edges (a, b) between sets that connect every two linked ones; cand has sid, n, shared, keys."""
    keys = keyed_sets(cand)
    lowest = keys.groupBy("token").agg(F.min("sid").alias("first_sid"), F.max("sid").alias("last")).where("first_sid <> last").select("token", "first_sid")
    # Each set meets the one first set that it shares most keys with; what that leaves apart is searched below.
    shared_keys = keys.join(lowest, "token").where("sid <> first_sid").groupBy("sid", "first_sid").agg(F.count("*").alias("k"))
    meets = materialize(shared_keys.groupBy("sid").agg(F.min(F.struct((-F.col("k")).alias("k"), "first_sid")).alias("m")).select("sid", "m.first_sid"))
    parts = meets.groupBy("first_sid").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = meets.join(parts, "first_sid").select("sid", F.col("first_sid").alias("block"), F.pmod(F.xxhash64("sid"), "parts").alias("part"), F.lit(False).alias("first"))
    heads = parts.select(F.col("first_sid").alias("sid"), F.col("first_sid").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("first"))
    sets = cand.select("sid", "n", "shared")
    rows = dealt.unionByName(heads).join(sets, "sid").withColumn("group", F.col("sid"))
    near = materialize(rows.groupBy("block", "part").applyInArrow(_search, "a long, b long"))

    # Keys whose sets still lie in different components.
    roots = connected_components(near)
    relieve_driver(cand.sparkSession)
    owned = within_reach(keys).join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("token", "sid", F.coalesce("root", "sid").alias("group"))
    owned = materialize(owned)
    lists = owned.groupBy("token").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("sid")).alias("mark"), F.min("group").alias("low"), F.max("group").alias("high"), F.min("sid").alias("first_sid"))
    lists = materialize(lists.where("low <> high").groupBy("size", "mark").agg(F.min(F.struct("token", "first_sid")).alias("m")).select("size", "m.token", "m.first_sid"))
    # Sets that such keys connect are a family; a family of bounded size is searched at once, each set sent once.
    open_sets = owned.join(lists, "token").select("token", "sid", "group", "first_sid", "size")
    family = connected_components(open_sets.select(F.col("sid").alias("a"), F.col("first_sid").alias("b"))).withColumnRenamed("node", "sid")
    kin = materialize(family.join(family.groupBy("root").agg(F.count("*").alias("members")), "root"))
    small = kin.where(F.col("members") <= FAMILY).select("sid", "root")
    rows = small.join(sets, "sid").join(roots.select(F.col("node").alias("sid"), F.col("root").alias("own")), "sid", "left")
    rows = rows.select("sid", "n", "shared", F.coalesce("own", "sid").alias("group"), F.lit(False).alias("first"), "root")
    within = materialize(rows.groupBy("root").applyInArrow(_search, "a long, b long"))
    relieve_driver(cand.sparkSession)
    mine = roots.select(F.col("node").alias("sid"), F.col("root").alias("own"))
    middle = kin.where(F.col("members").between(FAMILY + 1, WIDE)).join(mine, "sid", "left").select(F.col("root").alias("token"), "sid", F.coalesce("own", "sid").alias("group"))
    open_ = middle.unionByName(open_sets.join(kin.where(F.col("members") > WIDE).select("sid"), "sid", "left_semi").select("token", "sid", "group"))
    # A piece holds whole groups where they are small, and a slice of one group where it is large.
    held = open_.groupBy("token", "group").agg(F.count("*").alias("k"))
    held = held.join(held.groupBy("token").agg(F.sum(F.when(F.col("k") <= BLOCK, F.col("k")).otherwise(0)).alias("few")), "token")
    piece = F.when(F.col("k") > BLOCK, -1 - F.pmod(F.xxhash64("group"), F.lit(1 << 40))).otherwise(F.pmod(F.xxhash64("group"), F.greatest(F.ceil(F.col("few") / BLOCK), F.lit(1))))
    placed = open_.join(held.select("token", "group", piece.alias("p")), ["token", "group"])
    sizes = placed.groupBy("token", "p").agg(F.ceil(F.count("*") / BLOCK).alias("slices"))
    placed = placed.join(sizes, ["token", "p"]).select("token", "sid", "group", F.struct("p", F.pmod(F.xxhash64("sid"), "slices").alias("s")).alias("piece"))
    placed = materialize(placed)
    pieces = placed.groupBy("token", "piece").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    other = pieces.select("token", F.col("piece").alias("piece2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = pieces.join(other, "token").where("piece <= piece2 and not (low = high and low2 = high2 and low = low2)").select("token", "piece", "piece2")
    left = placed.join(pairs, ["token", "piece"]).select("token", "piece", "piece2", "sid", "group")
    right = placed.withColumnRenamed("piece", "piece2").join(pairs.where("piece <> piece2"), ["token", "piece2"]).select("token", "piece", "piece2", "sid", "group")
    rows = left.unionByName(right).withColumn("first", F.lit(False)).join(sets, "sid")
    rest = materialize(rows.groupBy("token", "piece", "piece2").applyInArrow(_search, "a long, b long"))
    relieve_driver(cand.sparkSession)
    return near.unionByName(within).unionByName(rest)


def jaccard_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that links reach, itself included): one row per input row."""
    return _grouped(docs, key, text).select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of jaccard_groups with sid, the id of the text's set (null: no words), and root, the least of its component."""
    spark = docs.sparkSession
    relieve_driver(spark)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    bits = bucket_bits(input_parts(rows))
    scan = materialize(scan_sets(rows, bits))
    numbered = materialize(scan.where("batch is null").select("doc_id", "n", "sid"))
    answers = total_counts(scan.where("bucket >= 0").select("batch", "bucket", "keys", "counts"))
    likely = told(scan.where("bucket = -1"), answers, _likely, "sid binary")
    lowest = numbered.groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    chosen, size = cut_counted(lowest.join(likely.distinct(), "sid", "left_semi").where("doc_id is not null"))
    few = size <= BROADCAST_ROWS
    discard(scan)
    relieve_driver(spark)

    def whole(batches):
        claim(OWNER)
        for b in batches:
            made = ((sid, shingle_set(t)) for sid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            rows = [(sid, s.tobytes()) for sid, s in made if len(s) and set_id(s) == sid]  # one id may stand by several texts
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["sid", "shared"])
        give_back()

    picked = rows.join(F.broadcast(chosen) if few else chosen, "doc_id").select("sid", "text")
    sets = materialize(picked.mapInArrow(whole, "sid binary, shared binary"))
    shared = materialize(scan_shared(sets.dropDuplicates(["sid"]), bits))
    discard(sets)
    relieve_driver(spark)
    answers = total_counts(shared.where("bucket >= 0").select("batch", "bucket", "keys", "counts"))
    # Sets that may link get numbers of their own, which are fixed by being written; the search knows them by these.
    cand = materialize(told(shared.where("bucket = -1"), answers, _keyed, "sid binary, n long, shared binary, keys array<long>").withColumn("number", F.monotonically_increasing_id()))
    discard(shared)
    relieve_driver(spark)
    roots = connected_components(similar_sets(cand.select(F.col("number").alias("sid"), "n", "shared", "keys")))

    numbers = cand.select(F.col("number").alias("node"), "sid").join(roots, "node")
    grouped = lowest.join(numbers, "sid").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min("sid").alias("root_sid"))
    by_set = numbers.join(grouped, "root").select("sid", F.col("root_sid").alias("root"), "component_id")
    every = lowest.join(by_set, "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), F.coalesce("component_id", "doc_id").alias("component_id"))
    every = every.where("sid is not null")
    return numbered.join(every, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "sid", "root")


def _with_sets(docs: DataFrame, text: str) -> DataFrame:
    """docs with __sid, the id of each text's set."""
    at, schema = docs.columns.index(text), docs.withColumn("__sid", F.lit(None).cast("binary")).schema

    def run(batches):
        claim(OWNER)
        for b in batches:
            sets = [shingle_set(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([set_id(s) if len(s) else None for s in sets], pa.binary())], names=[*b.schema.names, "__sid"])

    return docs.mapInArrow(run, schema)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each group: that with the smallest id, of several texts by it that with the smallest set id; null ids stay.

    Of rows with one id and one set, the least by their columns in order stays.
    """
    rows = materialize(_grouped(docs, key, text).where("doc_id is not null").select("doc_id", "sid", "root"))
    first = rows.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "sid")).alias("m")).select("root", F.col("m.doc_id").alias("__kept"), F.col("m.sid").alias("__set"))
    repeated, several = cut_counted(rows.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"))
    # The rows that go are the fewer ones, so it is they that are sent to the texts, not the texts to the rows that stay.
    copies = rows.join(first, "root").where("doc_id <> __kept").select("doc_id")
    out, n = cut_counted(copies.unionByName(repeated).distinct().withColumnRenamed("doc_id", "__out"))
    number = F.col(f"`{key}`").cast("long")
    kept = docs.join(F.broadcast(out) if n <= BROADCAST_ROWS else out, number == out["__out"], "left_anti")
    if not several:
        return kept
    chosen = first.select("__kept", "__set").unionByName(rows.where("root is null").select(F.col("doc_id").alias("__kept"), F.col("sid").alias("__set")).distinct())
    many = repeated.withColumnRenamed("doc_id", "__many")
    own = docs.join(many, number == many["__many"], "left_semi")
    packed = own.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("m"), number.alias("__id"), F.col(f"`{text}`").alias("text"))
    packed = _with_sets(packed, "text").join(materialize(chosen), (F.col("__id") == F.col("__kept")) & F.col("__sid").eqNullSafe(F.col("__set")), "left_semi")
    least = packed.groupBy("__id", "__sid").agg(F.min("m").alias("m")).select("m.*")
    return kept.unionByName(least)


def op2_ngram_jaccard(spark, sf_dir):
    return jaccard_groups(load(spark, sf_dir, "documents"))


_SHINGLES = """SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i+4], ' ')))
    WHEN len(w) > 0 THEN [hash(array_to_string(w, ' '))] ELSE [] END) AS s
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS w FROM documents)"""
ORACLE = f"""
WITH RECURSIVE sh AS MATERIALIZED ({_SHINGLES}),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS MATERIALIZED (SELECT s FROM sh GROUP BY s HAVING count(*) > 1),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN common USING (s) JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(low.b, d.doc_id)) AS BIGINT) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
"""
