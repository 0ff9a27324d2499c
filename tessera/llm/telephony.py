"""Telephony audio as media columns.

Sounds are stored as WAVE files with mu-law, A-law, PCM or IMA ADPCM samples.
The two companded forms are expanded by tables of 256 values; ADPCM blocks are
decoded with numpy across blocks, one step for each place in a block; decoded
sound can be resampled and stored as 16-bit PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text, session, table, with_number

# Format codes of WAVE files.
PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17
# How an IMA ADPCM nibble moves the step index.
INDEX_MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)
# The step sizes of IMA ADPCM.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
#: Samples a second of telephony.
RATE = 8000
#: A payload's length is a positive multiple of this, filled up with FILL.
UNIT, FILL = 576, 255
#: Samples that are decoded or resampled at once.
CHUNK = 1 << 20
#: Bytes of an ADPCM block when payloads are read as such: a part of a UNIT.
BLOCK = 64
#: Rate of the sound that is stored as PCM.
WIDE = 16000


def mu_law_table() -> np.ndarray:
    """The 256 linear values of mu-law codes."""
    code = ~np.arange(256, dtype=np.uint8) & 0xFF
    sign, exponent, mantissa = code & 0x80, (code >> 4) & 7, (code & 15).astype(np.int32)
    size = (((mantissa << 3) + 132) << exponent.astype(np.int32)) - 132
    return np.where(sign, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """The 256 linear values of A-law codes."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, code & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}


def wave(samples: bytes, code: int = MU_LAW, rate: int = RATE, block: int = 1) -> bytes:
    """A mono WAVE file around stored samples; ``block``: bytes of a block or sample."""
    bits = {PCM: 16, MU_LAW: 8, A_LAW: 8, IMA_ADPCM: 4}[code]
    block = 2 if code == PCM else block
    per_block = (block - 4) * 2 + 1 if code == IMA_ADPCM else 1
    extra = struct.pack("<HH", 2, per_block) if code == IMA_ADPCM else b"" if code == PCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", code, 1, rate, rate * block // per_block, block, bits) + extra
    fact = b"" if code == PCM else b"fact" + struct.pack("<II", 4, len(samples) // block * per_block)
    odd = b"\0" * (len(samples) % 2)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + fact + b"data" + struct.pack("<I", len(samples)) + samples + odd
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(media: bytes) -> dict:
    """Format code, rate, block size and stored samples of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    out, at = {}, 12
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            code, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            if channels != 1:
                raise ValueError("only mono sound is supported")
            out |= {"code": code, "rate": rate, "block": block}
        elif kind == b"data":
            out["samples"] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return out


def decode_adpcm(data: bytes, block: int) -> np.ndarray:
    """All full blocks at once, each step decoding one nibble of every block; then a shorter last one.

    What is left after the full blocks and shorter than a block's head of 4
    bytes holds no sample.
    """
    full = len(data) // block * block
    rest = data[full:]
    out = decode_blocks(np.frombuffer(data, np.uint8, full).reshape(-1, block))
    if len(rest) < 4:
        return out
    return np.concatenate([out, decode_blocks(np.frombuffer(rest, np.uint8).reshape(1, -1))])


def decode_blocks(blocks: np.ndarray) -> np.ndarray:
    """The samples of blocks (one a row), block after block."""
    steps, moves = np.array(STEPS, np.int32), np.array(INDEX_MOVES * 2, np.int32)
    value = blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int8).astype(np.int32) << 8
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    # For each step index and nibble the change of the value.
    n, step = np.arange(16), steps[:, None]
    change = (step >> 3) + np.where(n & 1, step >> 2, 0) + np.where(n & 2, step >> 1, 0) + np.where(n & 4, step, 0)
    change = np.where(n & 8, -change, change).ravel()
    places = 2 * (blocks.shape[1] - 4)
    nibbles = np.empty((places, len(blocks)), np.uint8)
    nibbles[0::2], nibbles[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((places + 1, len(blocks)), np.int16)
    out[0] = value
    for i in range(places):
        nibble = nibbles[i]
        value = value + change[index * 16 + nibble]
        np.clip(value, -32768, 32767, out=value)
        index = index + moves[nibble]
        np.clip(index, 0, len(STEPS) - 1, out=index)
        out[i + 1] = value
    return out.T.ravel()


def decode(media: bytes) -> tuple[np.ndarray, int]:
    """16-bit samples and rate of a WAVE file."""
    x = parse(media)
    if x["code"] in TABLES:
        return TABLES[x["code"]][np.frombuffer(x["samples"], np.uint8)], x["rate"]
    if x["code"] == IMA_ADPCM:
        return decode_adpcm(x["samples"], x["block"]), x["rate"]
    if x["code"] == PCM:
        return np.frombuffer(x["samples"], "<i2"), x["rate"]
    raise ValueError(f"format {x['code']} is not supported")


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate, piece by piece."""
    if rate == to or not len(samples):
        return samples.astype(np.int16)
    n = max(1, len(samples) * to // rate)
    out = np.empty(n, np.int16)
    for at in range(0, n, CHUNK):
        place = np.arange(at, min(n, at + CHUNK)) * (rate / to)
        a, b = int(place[0]), min(len(samples), int(place[-1]) + 2)
        out[at : at + len(place)] = np.rint(np.interp(place, np.arange(a, b), samples[a:b]))
    return out


def resampled_wave(media: bytes, to: int = WIDE) -> bytes:
    """The decoded sound as 16-bit PCM at another rate."""
    samples, rate = decode(media)
    return wave(resample(samples, rate, to).astype("<i2").tobytes(), PCM, to)


def measure(pieces: Iterable[np.ndarray]) -> str:
    """``rms:peak:crossings`` of samples: root mean square and peak, sign changes; whole numbers."""
    n = energy = peak = crossings = 0
    last = None
    for p in pieces:
        wide = p.astype(np.int64)
        n, energy, peak = n + len(p), energy + int(wide @ wide), max(peak, int(np.abs(wide).max(initial=0)))
        up = p >= 0
        crossings += int(np.count_nonzero(up[1:] != up[:-1])) + int(last is not None and len(p) > 0 and last != up[0])
        last = up[-1] if len(p) else last
    return f"{round((energy / max(n, 1)) ** 0.5)}:{peak}:{crossings}"


def cut_up(samples: np.ndarray, table_: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The samples, or what the table has for them, in pieces of CHUNK."""
    for i in range(0, len(samples), CHUNK):
        yield samples[i : i + CHUNK] if table_ is None else table_[samples[i : i + CHUNK]]


def features(media: bytes) -> str:
    """See :func:`measure`; a very long sound needs no more memory than its bytes and one piece."""
    x = parse(media)
    if x["code"] in TABLES:
        return measure(cut_up(np.frombuffer(x["samples"], np.uint8), TABLES[x["code"]]))
    return measure(cut_up(decode(media)[0]))


def as_adpcm(parts: list[bytes]) -> Iterator[np.ndarray]:
    """The samples of each part read as ADPCM blocks of BLOCK bytes; parts are decoded together up to CHUNK bytes.

    The parts' lengths are multiples of BLOCK.
    """
    held: list[bytes] = []

    def flush():
        sizes = [len(p) // BLOCK * ((BLOCK - 4) * 2 + 1) for p in held]
        ends = np.cumsum(sizes).tolist()
        samples = np.concatenate([decode_adpcm(b, BLOCK) for b in in_blocks(b"".join(held))])
        held.clear()
        for a, b in zip([0, *ends], ends, strict=False):
            yield samples[a:b]

    for p in parts:
        held.append(p)
        if sum(map(len, held)) >= CHUNK:
            yield from flush()
    if held:
        yield from flush()


def in_blocks(data: bytes) -> Iterator[bytes]:
    size = max(1, CHUNK // BLOCK) * BLOCK
    for at in range(0, len(data), size):
        yield data[at : at + size]


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled up to a positive multiple of UNIT, and their own number."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes([FILL]) * (max(1, -(-len(data) // UNIT)) * UNIT - len(data)), len(data)


def store(docs: DataFrame, code: int = MU_LAW) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_bytes, media)``: each text's payload as 8-bit telephony samples.

    A null or empty text is one unit of fill. Each row gives one, repeated
    rows too; a null doc_id stays null; other columns are ignored; a very long
    text is one long sound; an empty table gives an empty result.
    """
    session(docs)

    def run(batches):
        for pdf in batches:
            made = [payload(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": [n for _, n in made], "media": [wave(p, code) for p, _ in made]})

    return with_number(id_and_text(docs).mapInPandas(run, "doc_id string, n_bytes long, media binary"))


def inspect(stored: DataFrame) -> DataFrame:
    """Reads stored 8-bit sounds back: size and hash of samples and of the file, and features.

    ``a_law``: features of the samples read as A-law; ``adpcm``: of the samples
    read as blocks of IMA ADPCM, and pcm_bytes and pcm_sha256 of the file in
    which that sound is stored as 16-bit PCM, resampled to WIDE. Null media
    give nulls, repeated rows one row each, an empty table an empty result.
    """
    session(stored)
    columns = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "a_law", "adpcm", "pcm_bytes", "pcm_sha256"]

    def run(batches):
        for pdf in batches:
            there = [m for m in pdf["media"] if m is not None]
            stored_ = [parse(m)["samples"] for m in there]
            rows = []
            for media, data, sound in zip(there, stored_, as_adpcm(stored_), strict=True):
                pcm = wave(resample(sound, RATE, WIDE).astype("<i2").tobytes(), PCM, WIDE)
                rows.append(
                    (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(media))
                    + (measure(cut_up(np.frombuffer(data, np.uint8), TABLES[A_LAW])), measure(cut_up(sound)), len(pcm), hashlib.sha256(pcm).hexdigest())
                )
            found = iter(rows)
            out = pd.DataFrame([(None,) * len(columns) if m is None else next(found) for m in pdf["media"]], columns=columns)
            for c in ("payload_bytes", "tail_crc32", "media_bytes", "pcm_bytes"):
                out[c] = out[c].astype("Int64")
            yield pd.concat([pdf[["doc_id", "n_bytes"]].reset_index(drop=True), out], axis=1)

    named = stored.select(F.col("doc_id").cast("string"), "n_bytes", "media")
    kind = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return with_number(named.mapInPandas(run, f"{kind}, a_law string, adpcm string, pcm_bytes long, pcm_sha256 string"))


def expand(stored: DataFrame, to: int = WIDE) -> DataFrame:
    """``(doc_id, media)`` -> ``(doc_id, media)`` decoded, resampled and stored as 16-bit PCM; null stays null."""
    session(stored)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "media": [None if m is None else resampled_wave(m, to) for m in pdf["media"]]})

    return with_number(stored.select(F.col("doc_id").cast("string"), "media").mapInPandas(run, "doc_id string, media binary"))


def op9(spark, sf_dir: str) -> DataFrame:
    return inspect(store(table(spark, sf_dir, "documents")))
