"""SentencePiece encoding and decoding (1): streaming Viterbi with a bounded window.

The vocabulary at hand is a merge-ranked (BPE) SentencePiece model. Its segmentation is the one path
through the lattice of pieces on which every two neighbours stay apart when merged on their own: a run
of pieces is the model's own result exactly if each adjacent pair is the model's result for the pair's
text. So the lattice search scores a step 0 if the pair is stable and minus infinity otherwise, and each
prefix keeps one backpointer.

Texts stream through the search in blocks. Ids are committed whenever all surviving backpointer paths
run through one boundary; what lies before it leaves the window:

* A boundary that no piece spans (between words, or between two characters that stand side by side in no
  piece) holds all paths, whatever comes: the stretch before it is committed there. Stretches that occur
  again are remembered. New ones of at most WINDOW times the longest piece are searched side by side, one
  lane each, a character a step (Lanes).
* Within a longer stretch a prefix survives while what follows it begins some piece; the survivors' paths
  are followed back until they meet, and the ids up to there are committed (segments).

Nulls and empty texts give no ids; texts of any length are encoded whole, in bounded state; characters
without a piece become byte pieces, as the library does it; repeated rows each get their row; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import load, map_rows

SPACE = "▁"
#: Words that a generation of the memo holds at most, and the longest of them; pairs whose stability is remembered at most.
MEMO_LIMIT, MEMO_CHARS, PAIR_LIMIT = 60_000, 24, 1 << 18
#: A lane's window, in longest pieces; characters of text whose new stretches are searched together, and of a block.
WINDOW, SLICE, BLOCK = 2, 1 << 19, 1 << 18
#: A chunk ends before a run of word marks; no piece holds a mark after another character (checked on loading).
CHUNKS = regex.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
COMMIT_EVERY = 8
ONE = (1,)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class IntTable:
    """int64 keys (not negative) to int32 values, looked up many at once; a fixed number of slots, probed in order."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int32)
        self.size = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * _ODD >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that aren't there, each once."""
        slots, self.size = self._slots(keys), self.size + len(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] < 0)
            self.keys[slots[free]] = keys[free]  # of several for one slot, one stays
            own = self.keys[slots] == keys
            self.values[slots[own]] = values[own]
            keys, values, slots = keys[~own], values[~own], (slots[~own] + 1) & self.mask


class Lanes:
    """The lattice search over many stretches at once: numpy across stretches, one character a step.

    A prefix's paths go on along a tree of the pieces: (lane, start, node) triples are what survives, a node
    with a piece is a candidate for the prefix's backpointer. Only characters of the pieces may occur.
    """

    def __init__(self, codec: PieceCodec):
        self.codec = codec
        #: Pieces by number: those that merges form, and all single characters in them.
        self.names = sorted({*codec.halves, *(c for p in codec.halves for c in p)})
        number = {p: n for n, p in enumerate(self.names)}
        chars = sorted({c for p in self.names for c in p})
        self.char = np.full(max(map(ord, chars), default=0) + 2, 0, np.int64)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        nodes: dict[tuple[int, str], int] = {}
        piece_at = [-1]
        for name, n in number.items():
            at = 0
            for c in name:
                if (at, c) not in nodes:
                    nodes[at, c] = len(piece_at)
                    piece_at.append(-1)
                at = nodes[at, c]
            piece_at[at] = n
        self.piece_at = np.array(piece_at, np.int32)
        self.ways = IntTable(max(4, (4 * len(nodes)).bit_length()))
        self.ways.put(np.array([at << 16 | int(self.char[ord(c)]) for at, c in nodes], np.int64), np.array(list(nodes.values()), np.int32))
        self.pairs = IntTable(PAIR_LIMIT.bit_length())
        ids = [codec.piece_ids(p) for p in self.names]
        self.id_count = np.array([len(i) for i in ids], np.int64)
        self.id_start = np.cumsum(self.id_count) - self.id_count
        self.ids = np.array([x for i in ids for x in i], np.int32)

    def stable(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        keys = before.astype(np.int64) << 24 | piece
        found = self.pairs.get(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            every, inverse = np.unique(keys[new], return_inverse=True)
            if self.pairs.size + len(every) > PAIR_LIMIT:
                self.pairs = IntTable(PAIR_LIMIT.bit_length())
            told = np.array([self.codec.judged(self.names[k >> 24], self.names[k & 0xFFFFFF]) for k in every.tolist()], np.int32)
            if len(every) <= PAIR_LIMIT:
                self.pairs.put(every, told)
            found[new] = told[inverse]
        return found == 1

    def solve(self, parts: list[str]) -> list[bytes]:
        """Each stretch's ids."""
        n, lengths = len(parts), np.array([len(p) for p in parts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        longest = int(lengths[0])
        codes = np.frombuffer("".join([parts[i] for i in order.tolist()]).encode("utf-32-le"), np.uint32)
        at = self.char[codes]
        starts = np.cumsum(lengths) - lengths
        back, last = np.zeros((longest + 1, n), np.uint8), np.zeros((longest + 1, n), np.int32)
        lane, start, node = (np.zeros(0, np.int64) for _ in range(3))
        for i in range(1, longest + 1):
            live = int(np.searchsorted(-lengths, -i, side="right"))  # lanes of at least i characters come first
            keep = lane < live
            lane = np.concatenate([lane[keep], np.arange(live)])
            start = np.concatenate([start[keep], np.full(live, i - 1)])
            node = np.concatenate([node[keep], np.zeros(live, np.int64)])
            node = self.ways.get(node << 16 | at[starts[lane] + (i - 1)]).astype(np.int64)
            keep = node >= 0
            lane, start, node = lane[keep], start[keep], node[keep]
            piece = self.piece_at[node]
            ends = np.flatnonzero(piece >= 0)
            good = start[ends] == 0
            rest = np.flatnonzero(~good)
            good[rest] = self.stable(last[start[ends[rest]], lane[ends[rest]]], piece[ends[rest]])
            ends = ends[good][::-1]  # of several, the longest is written last
            back[i, lane[ends]], last[i, lane[ends]] = i - start[ends], piece[ends]
        # Back along the pointers, all lanes at once.
        at, lanes, steps = lengths.copy(), np.arange(n), []
        while len(lanes):
            steps.append((lanes, last[at[lanes], lanes]))
            at[lanes] -= back[at[lanes], lanes]
            lanes = lanes[at[lanes] > 0]
        own = np.concatenate([s[0] for s in steps[::-1]])
        pieces = np.concatenate([s[1] for s in steps[::-1]])
        pieces = pieces[np.argsort(own, kind="stable")]
        count = self.id_count[pieces]
        flat = self.ids[np.repeat(self.id_start[pieces] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))].tobytes()
        sizes = np.zeros(n, np.int64)
        np.add.at(sizes, np.sort(own), count)
        cuts = [0, *(4 * np.cumsum(sizes)).tolist()]
        out: list = [b""] * n
        for k, i in enumerate(order.tolist()):
            out[i] = flat[cuts[k] : cuts[k + 1]]
        return out


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.hidden = {i for i in range(n) if model.is_control(i)}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.ids), default=1)
        self.split_at_marks = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.halves: dict[str, tuple[str, str]] = {}
        for piece in self.ids:
            trail: list[tuple[str, str]] = []
            if len(piece) == 1:
                self.halves[piece] = (piece, "")
            elif self.merge(piece, trail) == [piece]:
                self.halves[piece] = trail[-1]
        #: Pieces formed after both of their halves, with a score of their own: their history can be undone step by step.
        tied = {s for s in self.score.values() if s <= -1e9}
        self.regular = {p for p, (x, y) in self.halves.items() if self.score[p] not in tied and all(len(h) < 2 or self.score[h] > self.score[p] for h in (x, y))}
        self.regular = {p for p in self.regular if all(len(h) < 2 or h in self.regular for h in self.halves[p])}
        #: Neighbouring characters within pieces; between any two others no merge ever crosses, so text may be cut there.
        self.inside = {p[i : i + 2] for p in self.halves for i in range(len(p) - 1)}
        ends: dict[str, set[int]] = {}
        for piece in self.halves:
            if len(piece) > 1:
                ends.setdefault(piece[-2:], set()).add(len(piece))
        #: Sizes of the pieces that end with two characters, long ones first; one character is a piece of its own.
        self.sizes = {end: (*sorted(found, reverse=True), 1) for end, found in ends.items()}
        #: What each id decodes to; bytes beyond ASCII as escapes, which are put together at the end.
        self.shown = [p.replace(SPACE, " ") for p in self.pieces]
        for i in range(n):
            if i in self.byte_of:
                self.shown[i] = bytes([self.byte_of[i]]).decode("ascii", "surrogateescape")
            elif i == self.unknown:
                self.shown[i] = " ⁇ "
            elif i in self.hidden:
                self.shown[i] = ""
        #: Beginnings of pieces: a prefix of the text survives while what follows it is one of them.
        self.begun = {p[:i] for p in self.halves for i in range(1, len(p))}
        self.stable_pairs: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters = {c for p in self.halves for c in p}
        #: Boundaries at which ids were committed, as far as they were searched for.
        self.commits = 0
        self.lanes = Lanes(self)

    def release(self) -> None:
        """Forgets what was remembered."""
        self.memo, self.older, self.stable_pairs = {}, {}, {}
        self.lanes.pairs = IntTable(PAIR_LIMIT.bit_length())

    def piece_ids(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        return [self.byte_id[b] for b in piece.encode("utf-8", "surrogatepass")] if self.byte_id else [self.unknown]

    def merge(self, text: str, trail: list | None = None) -> list[str]:
        """The model's definition on a short text: merges the best-scored adjacent pair, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            if trail is not None:
                trail.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, a: str, b: str) -> bool:
        """Whether merging a + b gives a, b again."""
        found = self.stable_pairs.get((a, b))
        if found is None:
            found = self.judged(a, b)
            if len(self.stable_pairs) >= PAIR_LIMIT:
                self.stable_pairs.clear()
            self.stable_pairs[a, b] = found
        return found

    def judged(self, a: str, b: str) -> bool:
        regular = self.regular
        easy = (len(a) == 1 or a in regular) and (len(b) == 1 or b in regular)
        return self.apart(a, b) if easy else self.merge(a + b) == [a, b]

    def apart(self, a: str, b: str) -> bool:
        """Undoes the latest merge on either side of the cut until single characters face each other.

        A merge across the cut would have come first if it scores above the merge that used up the
        left symbol, and not below the one that used up the right symbol (ties go leftmost).
        """
        score, halves = self.score, self.halves
        never = float("-inf")
        used_a = used_b = never
        while True:
            across = score.get(a + b)
            if across is not None and across > used_a and across >= used_b:
                return False
            if len(a) == 1 and len(b) == 1:
                return True
            if len(b) == 1 or len(a) > 1 and score[a] < score[b]:
                used_a, a = score[a], halves[a][1]
            else:
                used_b, b = score[b], halves[b][0]

    def segments(self, blocks):
        """Yields the pieces of a stream of text blocks as they become final."""
        text, last = "", [""]  # the window, and for each of its prefixes the last piece (None: no path)
        longest, ids, sizes, pairs, stable = self.longest, self.halves, self.sizes, self.stable_pairs, self.stable
        for block in blocks:
            i = len(text)
            text += block
            n = len(text)
            while i < n:
                i += 1
                piece = None
                for size in sizes.get(text[i - 2 : i], ONE) if i > 1 else ONE:
                    if size > i:
                        continue
                    piece = text[i - size : i]
                    if size > 1 and piece not in ids:
                        continue
                    before = last[i - size]
                    if before is None:
                        continue
                    if not before:
                        break
                    good = pairs.get((before, piece))
                    if good or good is None and stable(before, piece):
                        break
                else:
                    piece = None
                last.append(piece)
                if i >= longest and i % COMMIT_EVERY == 0:
                    begun = self.begun
                    front = {k for k in range(i - longest + 1, i + 1) if last[k] is not None and (k == i or text[k:i] in begun)}
                    while len(front) > 1 and min(front) > 0:
                        k = max(front)
                        front.remove(k)
                        front.add(k - len(last[k]))
                    cut = min(front) if len(front) == 1 else 0
                    if cut > 0:
                        self.commits += 1
                        yield from self.trace(last, cut)
                        text, last = text[cut:], last[cut:]
                        i, n = i - cut, n - cut
        yield from self.trace(last, len(text))

    @staticmethod
    def trace(last: list, end: int) -> list[str]:
        """The pieces from the window's start to end; before the window's first prefix stands a committed piece."""
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def searched(self, blocks) -> bytes:
        """Ids of a stream of text blocks by the search alone."""
        out = array("i")
        for piece in self.segments(blocks):
            found = self.ids.get(piece)
            if found is not None:
                out.append(found)
            else:
                out.extend(self.piece_ids(piece))
        return out.tobytes()

    def stretches(self, part: str) -> list[str]:
        """A word with its marks, cut where no piece spans."""
        inside, last, out = self.inside, 0, []
        for i in range(1, len(part)):
            if part[i - 1 : i + 1] not in inside:
                out.append(part[last:i])
                last = i
        out.append(part[last:])
        return out

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words that aren't in the memo: searched in lanes, or stretch by stretch."""
        width, letters, whole, cut = WINDOW * self.longest, self.letters, [], {}
        for w in words:
            if len(w) <= width and letters.issuperset(w):
                whole.append(w)
            else:
                cut[w] = self.stretches(w)
        known: dict[str, bytes] = {}
        lanes = list(whole)
        for s in {s for found in cut.values() for s in found}:
            if len(s) == 1:
                known[s] = array("i", self.piece_ids(s)).tobytes()
            elif len(s) <= width:
                lanes.append(s)
            else:
                known[s] = self.searched(s[i : i + BLOCK] for i in range(0, len(s), BLOCK))
        if lanes:
            known.update(zip(lanes, self.lanes.solve(lanes), strict=True))
        self.commits += len(whole)
        for w, found in cut.items():
            self.commits += len(found)
            known[w] = b"".join([known[s] for s in found])
        for w in words:
            if len(w) <= MEMO_CHARS:
                self.remember(w, known[w])
        return known

    def remember(self, word: str, ids: bytes) -> None:
        """The memo has two generations: what the older one holds and nobody asks for goes when the younger one is full."""
        if len(self.memo) >= MEMO_LIMIT:
            self.older, self.memo = self.memo, {}
        self.memo[word] = ids

    def words(self, text: str) -> list[str]:
        """The text's words, each behind its marks: every word begins at a committed boundary."""
        if not self.split_at_marks:
            return [text]
        if SPACE + SPACE in text or text[-1] == SPACE:
            return CHUNKS(text)
        first, *rest = text.split(SPACE)
        return [*([first] if first else []), *[SPACE + w for w in rest]]

    def blocks(self, text: str):
        """Marked text in blocks that end before a mark."""
        begin = 0
        while len(text) - begin > BLOCK and self.split_at_marks:
            end = text.find(SPACE, begin + BLOCK)
            while end > 0 and text[end - 1] == SPACE:  # not within a run of marks
                end = text.find(SPACE, end + 1)
            if end < 0:
                break
            yield text[begin:end]
            begin = end
        yield text[begin:] if begin else text

    def encode_all(self, texts: list) -> list[bytes]:
        """For each text its ids as the machine's 32-bit integers, one after the other."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, held = [], 0

        def settle():
            every = [w for _, words in waiting for w in words]
            found = list(map(self.memo.get, every))
            missing = [i for i, ids in enumerate(found) if ids is None]
            new = {every[i]: None for i in missing}
            for w in new.keys() & self.older.keys():
                new[w] = self.older[w]
            told = self.learn([w for w, ids in new.items() if ids is None])
            for w, ids in new.items():
                if ids is not None:
                    told[w] = ids
                    self.remember(w, ids)
            for i in missing:
                found[i] = told[every[i]]
            at = 0
            for n, words in waiting:
                out[n].append(b"".join(found[at : at + len(words)]))
                at += len(words)
            waiting.clear()

        for n, text in enumerate(texts):
            if text:
                for block in self.blocks(SPACE + text.replace(" ", SPACE)):
                    waiting.append((n, self.words(block)))
                    held += len(block)
                    if held >= SLICE:
                        settle()
                        held = 0
        settle()
        return [b"".join(o) for o in out]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        text = "".join(map(self.shown.__getitem__, ids))
        try:
            text.encode()
        except UnicodeEncodeError:
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def forget() -> None:
    codec.cache_clear()


def _ints(data: bytes) -> array:
    out = array("i")
    out.frombytes(data)
    return out


def encode_pieces(df: DataFrame, text: str = "text", key: str = "doc_id", model: str | None = None) -> DataFrame:
    """One row per input row: key, ids (array of int; empty for null or empty texts)."""
    path, kind = model or default_model(), df.schema[key].dataType.simpleString()
    return map_rows(df, [key, text], f"`{key}` {kind}, ids array<int>", lambda keys, texts: [keys, list(map(_ints, codec(path).encode_all(texts)))])


def decode_pieces(df: DataFrame, ids: str = "ids", key: str = "doc_id", model: str | None = None) -> DataFrame:
    """One row per input row: key, text. Null id lists give null; ids outside the vocabulary raise."""
    path, kind = model or default_model(), df.schema[key].dataType.simpleString()
    return map_rows(df, [key, ids], f"`{key}` {kind}, text string", lambda keys, lists: [keys, [None if x is None else codec(path).decode(x) for x in lists]])


def piece_digest(df: DataFrame, text: str = "text", key: str = "doc_id", model: str | None = None) -> DataFrame:
    """key, n_ids, ids_sha256 (of little-endian 32-bit ids), text_sha256 of the text decoded from these ids."""
    path, kind = model or default_model(), df.schema[key].dataType.simpleString()

    def run(keys, texts):
        c, n, ids_sha, text_sha = codec(path), [], [], []
        for ids in c.encode_all(texts):
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(c.decode(_ints(ids)).encode("utf-8", "surrogatepass")).hexdigest())
        return [keys, n, ids_sha, text_sha]

    return map_rows(df, [key, text], f"`{key}` {kind}, n_ids long, ids_sha256 string, text_sha256 string", run)


def op1_sentencepieces(spark, sf_dir):
    return piece_digest(load(spark, sf_dir, "documents"))
