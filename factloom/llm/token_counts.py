"""Token counts (10): byte-pair merging with a heap and a linked list, counting without identifiers.

A text's count is its number of initial byte symbols minus the number of merges. Merges never cross
a pre-token, so the counts of short pre-tokens are remembered in a bounded table.

Nulls and empty texts count 0 tokens; texts of any length are counted whole; repeated rows each get
their row; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from .common import load, map_rows, text_bytes

#: Fixed values of the public byte-level BPE format: the pre-token pattern (white space as the Unicode property).
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
MEMO_LIMIT, MEMO_BYTES = 300_000, 48
TOKEN_LIMIT = 512


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes stand for themselves, the rest follow from 256."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(free))
        free += b not in plain
    return out


class PairCounter:
    """Counts tokens of one vocabulary file; symbols are small integers, ranks come by pair."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids: dict[str, int] = {}
        self.start = [ids.setdefault(c, len(ids)) for c in byte_letters()]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            pair = (ids.setdefault(a, len(ids)), ids.setdefault(b, len(ids)))
            self.rank.setdefault(pair, (rank, ids.setdefault(a + b, len(ids))))
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.pretokens = regex.compile(PRETOKENS).findall
        self.memo: dict[str, int] = {}

    def merged(self, data: bytes) -> int:
        """Tokens of one pre-token: pops the lowest-ranked adjacent pair, leftmost first, until none is left."""
        n = len(data)
        symbol = [self.start[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, heap = self.rank, []
        for i in range(n - 1):
            if found := rank.get((symbol[i], symbol[i + 1])):
                heap.append((found[0], i, symbol[i], symbol[i + 1]))
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:  # one of the pair has been merged since
                continue
            symbol[i], symbol[j] = rank[a, b][1], -1
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if found := rank.get((symbol[i], symbol[k])):
                    heapq.heappush(heap, (found[0], i, symbol[i], symbol[k]))
            h = before[i]
            if h >= 0 and (found := rank.get((symbol[h], symbol[i]))):
                heapq.heappush(heap, (found[0], h, symbol[h], symbol[i]))
        return count

    def plain(self, text: str) -> int:
        memo, total = self.memo, 0
        for piece in self.pretokens(text):
            n = memo.get(piece)
            if n is None:
                data = text_bytes(piece)
                n = self.merged(data)
                if len(data) <= MEMO_BYTES:
                    if len(memo) >= MEMO_LIMIT:
                        memo.clear()
                    memo[piece] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(maxsize=2)
def counter(path: str) -> PairCounter:
    return PairCounter(path)


def forget() -> None:
    counter.cache_clear()


def count_tokens(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per input row: key, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    path = vocabulary or default_vocabulary()
    kind = df.schema[key].dataType.simpleString()

    def run(keys, texts):
        tokens = [counter(path).count(t) for t in texts]
        return [keys, [len(text_bytes(t)) for t in texts], tokens, [n > limit for n in tokens]]

    return map_rows(df, [key, text], f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean", run)


def op10_token_counts(spark, sf_dir):
    return count_tokens(load(spark, sf_dir, "documents"))
