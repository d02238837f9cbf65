"""Media columns (4): telephony audio stored in RIFF/WAVE, expanded by tables and block-parallel decoding.

Bytes are kept losslessly as mu-law or A-law samples (8 bit) or as the nibbles of IMA ADPCM blocks;
reading back expands them to 16-bit PCM (lookup tables; for ADPCM one numpy step per nibble position
over all blocks of a batch), resamples the PCM to another rate and stores it as a PCM file.

Nulls and empty texts store one padded unit; texts of any length are stored whole. Sound is decoded,
resampled and written in slabs: besides a text, its payload and its stored form (and the PCM file, where
the caller asks for that itself), memory doesn't follow the text. Equal texts give equal values; repeated
rows each get their row; null media give null PCM; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import load, map_rows, text_bytes

UNIT = 576
RATE, WIDE_RATE = 8000, 16000
MULAW, ALAW, ADPCM = "mulaw", "alaw", "adpcm"
CODECS = (MULAW, ALAW, ADPCM)
#: Fixed values of the WAVE format: format tags.
TAGS = {MULAW: 7, ALAW: 6, ADPCM: 17, "pcm": 1}
#: An ADPCM block here is the format's 4-byte header and one unit of nibbles.
BLOCK = 4 + UNIT
#: ADPCM blocks, and samples of the other codecs, that are decoded at once.
SLAB, SLAB_SAMPLES = 512, 1 << 19
#: Fixed values of IMA ADPCM: index change by code (sign bit dropped), and the step table.
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """16-bit value of each mu-law byte, by the rule of G.711."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit value of each A-law byte, by the rule of G.711."""
    code = np.arange(256) ^ 0x55
    step, exponent = code & 0x0F, (code >> 4) & 7
    size = np.where(exponent == 0, (step << 4) + 8, ((step << 4) + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def padded(data: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of the unit."""
    return data + b"\xff" * (-len(data) % UNIT or (0 if data else UNIT))


def wave_head(codec: str, size: int, rate: int = RATE) -> bytes:
    """What stands before size coded bytes in a mono WAVE file; after an odd number of bytes comes one 0."""
    tag = TAGS[codec]
    align, bits = {ADPCM: (BLOCK, 4), "pcm": (2, 16)}.get(codec, (1, 8))
    samples = 2 * UNIT + 1
    extra = struct.pack("<HH", 2, samples) if codec == ADPCM else b"" if codec == "pcm" else struct.pack("<H", 0)
    speed = rate * align // samples if codec == ADPCM else rate * align
    fmt = struct.pack("<HHIIHH", tag, 1, rate, speed, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if codec != "pcm":
        count = size // BLOCK * samples if codec == ADPCM else size
        body += b"fact" + struct.pack("<II", 4, count & 0xFFFFFFFF)
    body += b"data" + struct.pack("<I", size)
    return b"RIFF" + struct.pack("<I", len(body) + size + size % 2) + body


def wave(codec: str, data: bytes, rate: int = RATE) -> bytes:
    """A mono WAVE file around the coded bytes."""
    return b"".join((wave_head(codec, len(data), rate), data, b"\0" * (len(data) % 2)))


def parse_wave(blob: bytes) -> tuple[str, int, memoryview]:
    """(codec, rate, view of the coded bytes) of a WAVE file; raises ValueError on anything else."""
    blob = memoryview(blob)
    if blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, found, rate = 12, None, 0
    while at + 8 <= len(blob):
        name, size = blob[at : at + 4], struct.unpack_from("<I", blob, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", blob, at + 8)
            found = next((c for c, t in TAGS.items() if t == tag), None)
        elif name == b"data" and found:
            return found, rate, blob[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data of a known format")


def store(codec: str, payload: bytes) -> bytes:
    """The payload (whole units) as a WAVE file of the codec."""
    if codec == ADPCM:
        units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data = np.concatenate([np.zeros((len(units), 4), np.uint8), units], axis=1).tobytes()
    else:
        data = payload
    return wave(codec, data)


def read_payload(blob: bytes) -> bytes:
    """The payload as it was stored."""
    codec, _, data = parse_wave(blob)
    if codec == ADPCM:
        return np.frombuffer(data, np.uint8).reshape(-1, BLOCK)[:, 4:].tobytes()
    return bytes(data)


def adpcm_pcm(blocks: np.ndarray) -> np.ndarray:
    """Samples [block, 1 + 2 * data bytes] of IMA ADPCM blocks [block, bytes]: sequential in a block, numpy across blocks."""
    head = blocks[:, :4].astype(np.int32)
    value = ((head[:, 0] | head[:, 1] << 8) ^ 0x8000) - 0x8000
    index = np.minimum(head[:, 2], len(STEPS) - 1)
    data = blocks[:, 4:]
    out = np.empty((1 + 2 * data.shape[1], len(blocks)), np.int16)
    out[0] = value
    for k in range(2 * data.shape[1]):
        code = (data[:, k // 2] >> (4 * (k % 2)) & 15).astype(np.int32)
        step = STEPS[index]
        change = step >> 3
        change += np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_STEPS[code & 7], 0, len(STEPS) - 1)
        out[k + 1] = value
    return out.T


def decoded(blob: bytes) -> Iterator[np.ndarray]:
    """The 16-bit samples of a stored file, slab by slab."""
    codec, _, data = parse_wave(blob)
    if codec == ADPCM:
        blocks = np.frombuffer(data, np.uint8).reshape(-1, BLOCK)
        for i in range(0, len(blocks), SLAB):
            yield adpcm_pcm(blocks[i : i + SLAB]).ravel()
        return
    raw = np.frombuffer(data, "<i2" if codec == "pcm" else np.uint8)
    for i in range(0, len(raw), SLAB_SAMPLES):
        part = raw[i : i + SLAB_SAMPLES]
        yield TABLES[codec][part] if codec in TABLES else part


def sample_count(blob: bytes) -> int:
    codec, _, data = parse_wave(blob)
    return len(data) // BLOCK * (2 * UNIT + 1) if codec == ADPCM else len(data) // (2 if codec == "pcm" else 1)


class Resampler:
    """Linear interpolation in integers over a stream of samples; the last sample is held.

    The result goes, as a PCM file of the new rate, to sink piece by piece.
    """

    def __init__(self, total: int, sink: Callable[[bytes], None], rate: int = RATE, to: int = WIDE_RATE):
        self.sink, self.rate, self.to = sink, rate, to
        self.left = np.zeros(0, np.int16)  # the sample before the next, which its right neighbour completes
        self.at = 0  # its place
        self.size = 2 * (total * to // rate)
        head = wave_head("pcm", self.size, to)
        self.file_bytes = len(head) + self.size
        sink(head)

    def feed(self, samples: np.ndarray, end: bool = False) -> None:
        own = np.concatenate([self.left, samples])
        ready = len(own) if end else len(own) - 1  # samples whose right neighbour is known
        if ready > 0:
            first, last = -(-self.at * self.to // self.rate), min(self.size // 2, -(-(self.at + ready) * self.to // self.rate))
            at = np.arange(first, last, dtype=np.int64) * self.rate
            i, part = at // self.to - self.at, (at % self.to).astype(np.int32)
            a, b = own[i].astype(np.int64), own[np.minimum(i + 1, len(own) - 1)]
            self.sink(((a * (self.to - part) + b * part) // self.to).astype("<i2").tobytes())
            self.at += ready
            own = own[ready:]
        self.left = own

    def close(self) -> None:
        self.feed(np.zeros(0, np.int16), end=True)


class Sound:
    """What the feature says of a text's sound, gathered slab by slab, and the digest of its stored PCM file."""

    def __init__(self, codec: str, total: int):
        self.codec, self.total, self.n, self.peak, self.energy, self.turns, self.sign = codec, total, 0, 0, 0, 0, None
        self.sha, self.crc = hashlib.sha256(), 0
        self.pcm = Resampler(total, self.stored)

    def stored(self, piece: bytes) -> None:
        self.sha.update(piece)
        self.crc = zlib.crc32(piece, self.crc)

    def feed(self, samples: np.ndarray) -> None:
        x = samples.astype(np.int64)
        low = x < 0
        self.n += len(x)
        self.peak = max(self.peak, int(np.abs(x).max()))
        self.energy += int(np.dot(x, x))
        self.turns += int(np.count_nonzero(low[1:] != low[:-1])) + (self.sign is not None and self.sign != bool(low[0]))
        self.sign = bool(low[-1])
        self.pcm.feed(samples)

    def close(self) -> tuple[str, int, str]:
        """The feature, and the PCM file's size and digest."""
        self.pcm.close()
        feature = f"{self.codec}:n={self.n}:peak={self.peak}:energy={self.energy // self.n}:turns={self.turns}:pcm16k={self.crc:08x}"
        return feature, self.pcm.file_bytes, self.sha.hexdigest()


def codec_of(payload: bytes) -> str:
    """The codec that a text's payload gets: fixed by its content."""
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def describe_all(texts: list) -> list[list]:
    """Columns of media_features for a batch of texts; ADPCM blocks of several texts are decoded together, slab by slab."""
    columns: list[list] = [[] for _ in range(9)]
    waiting: list[tuple[int, np.ndarray]] = []  # rows and blocks, SLAB blocks at most
    sounds: dict[int, Sound] = {}
    held = 0

    def settle():
        nonlocal held
        if not waiting:
            return
        sound = adpcm_pcm(np.concatenate([b for _, b in waiting]))
        at = 0
        for row, own in waiting:
            sounds[row].feed(sound[at : at + len(own)].ravel())
            at += len(own)
        waiting.clear()
        held = 0
        for row in [r for r, s in sounds.items() if s.n == s.total]:
            finish(row, sounds.pop(row))

    def finish(row: int, sound: Sound):
        for c, v in zip(columns[6:], sound.close(), strict=True):
            c[row] = v

    for row, text in enumerate(texts):
        data = text_bytes(text)
        size, payload = len(data), padded(data)
        del data
        codec = codec_of(payload)
        blob = store(codec, payload)
        back = read_payload(blob) if codec == ADPCM else parse_wave(blob)[2]
        del payload
        values = [size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), "", 0, ""]
        for c, v in zip(columns, values, strict=True):
            c.append(v)
        del back
        sound = Sound(codec, sample_count(blob))
        if codec != ADPCM:
            for samples in decoded(blob):
                sound.feed(samples)
            finish(row, sound)
            continue
        sounds[row] = sound
        blocks = np.frombuffer(parse_wave(blob)[2], np.uint8).reshape(-1, BLOCK)
        while len(blocks):
            own, blocks = blocks[: SLAB - held], blocks[SLAB - held :]
            waiting.append((row, own))
            held += len(own)
            if held == SLAB:
                settle()
    settle()
    return columns


def media_features(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pcm_bytes, pcm_sha256: all read back from
    the stored form; the last two are of the resampled sound's PCM file."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"
    return map_rows(df, [key, text], schema, lambda keys, texts: [keys, *describe_all(texts)])


def store_media(df: DataFrame, text: str = "text", key: str = "doc_id", codec: str | None = None) -> DataFrame:
    """key, media binary: the WAVE file of each text (codec None: by content)."""
    kind = df.schema[key].dataType.simpleString()

    def run(keys, texts):
        payloads = [padded(text_bytes(t)) for t in texts]
        return [keys, [store(codec or codec_of(p), p) for p in payloads]]

    return map_rows(df, [key, text], f"`{key}` {kind}, media binary", run)


def pcm_file(blob: bytes, rate: int = WIDE_RATE) -> bytes:
    """The sound of a stored file as a 16-bit PCM file of the rate."""
    pieces: list[bytes] = []
    out = Resampler(sample_count(blob), pieces.append, parse_wave(blob)[1], rate)
    for samples in decoded(blob):
        out.feed(samples)
    out.close()
    return b"".join(pieces)


def to_pcm(df: DataFrame, media: str = "media", key: str = "doc_id", rate: int = WIDE_RATE) -> DataFrame:
    """key, pcm binary: a 16-bit PCM WAVE file at the given rate; null media give null."""
    kind = df.schema[key].dataType.simpleString()
    return map_rows(df, [key, media], f"`{key}` {kind}, pcm binary", lambda keys, blobs: [keys, [None if b is None else pcm_file(b, rate) for b in blobs]])


def op4_media_columns(spark, sf_dir):
    return media_features(load(spark, sf_dir, "documents"))
