"""Telephony audio in a media column: mu-law, A-law and IMA ADPCM to resampled PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_bounds, by_bytes, saved

A_LAW, MU_LAW, IMA_ADPCM = 6, 7, 0x11
RATE = 8000
BLOCK = 576

# Fixed values of the IMA ADPCM format: the index changes by nibble, and the step sizes.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
STEP_SIZE = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230,
    253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327,
    3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)


def mu_law_table() -> np.ndarray:
    """G.711 mu-law: 16-bit PCM for each of the 256 codes."""
    u = ~np.arange(256, dtype=np.uint8)
    size = (((u & 15).astype(np.int32) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype("<i2")


def a_law_table() -> np.ndarray:
    """G.711 A-law: 16-bit PCM for each of the 256 codes."""
    a = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent, mantissa = ((a >> 4) & 7).astype(np.int32), (a & 15).astype(np.int32) << 4
    size = np.where(exponent == 0, mantissa + 8, mantissa + 264 << np.maximum(exponent - 1, 0))
    return np.where(a & 128, size, -size).astype("<i2")


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (blocks, 1 + 2 * (width - 4)) of mono IMA ADPCM blocks (blocks, width) of uint8.

    Samples of a block depend on each other, blocks don't: each step decodes one nibble of every block.
    """
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), dtype="<i2")
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEP_SIZE) - 1).astype(np.int32)
    nibbles = np.empty((2 * (width - 4), n), dtype=np.uint8)
    nibbles[0::2], nibbles[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    # the change of value by step index and nibble: small, so one lookup replaces the shifts
    codes = np.arange(16)
    size = (STEP_SIZE[:, None] >> 3) + sum(np.where(codes & bit, STEP_SIZE[:, None] >> shift, 0) for bit, shift in ((4, 0), (2, 1), (1, 2)))
    change = np.where(codes & 8, -size, size).astype(np.int32).ravel()
    out[0] = value
    for k in range(len(nibbles)):
        code = nibbles[k]
        value += change[(index << 4) + code]
        np.clip(value, -32768, 32767, out=value)
        index += INDEX_CHANGE[code]
        np.clip(index, 0, len(STEP_SIZE) - 1, out=index)
        out[k + 1] = value
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """16-bit samples at the new rate, the first sample kept in place: linear interpolation; to a lower rate, of the means over a new sample's time, which damp what the new rate can't hold."""
    if rate == to or not len(pcm):
        return pcm.astype("<i2")
    if to < rate:
        width = -(-rate // to)
        total = np.concatenate([[0], np.cumsum(pcm.astype(np.int64))])
        lo = np.maximum(np.arange(len(pcm)) - (width - 1) // 2, 0)
        hi = np.minimum(np.arange(len(pcm)) + width // 2 + 1, len(pcm))
        pcm = (total[hi] - total[lo]) // (hi - lo)
    at = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    left, part = at // to, at % to
    right = np.minimum(left + 1, len(pcm) - 1)
    x = pcm.astype(np.int64)
    return ((x[left] * (to - part) + x[right] * part) // to).astype("<i2")


def wav(kind: int, data: bytes, rate: int = RATE, width: int = 1) -> bytes:
    """A mono RIFF file of format kind; width: bytes of a block."""
    samples = len(data) if kind in (A_LAW, MU_LAW) else len(data) // width * (1 + 2 * (width - 4))
    extra = struct.pack("<HH", 2, 1 + 2 * (width - 4)) if kind == IMA_ADPCM else struct.pack("<H", 0)
    speed = rate if kind in (A_LAW, MU_LAW) else rate * width // (1 + 2 * (width - 4))
    head = struct.pack("<HHIIHH", kind, 1, rate, speed, width, 4 if kind == IMA_ADPCM else 8) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes | None) -> tuple[int, int, int, bytes] | None:
    """(kind, rate, block width, data) of a RIFF file; None for what isn't one."""
    if not media or len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, fmt, data = 12, None, None
    while at + 8 <= len(media):
        tag, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if tag == b"fmt " and size >= 14 and at + 22 <= len(media):
            fmt = struct.unpack("<HHIIH", media[at + 8 : at + 22])
        elif tag == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return (fmt[0], fmt[2], fmt[4], data) if fmt and data is not None else None


def decode_many(tracks: list[tuple[int, int, bytes]]) -> list[np.ndarray | None]:
    """PCM of each (kind, block width, data); None for other kinds. ADPCM blocks of equal width are decoded together; a last short block is padded with zeros and its padding cut off, and one too short for its 4 bytes of head gives no samples."""
    out: list[np.ndarray | None] = [None] * len(tracks)
    tables = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}
    widths: dict[int, list[int]] = {}
    for i, (kind, width, data) in enumerate(tracks):
        if kind in tables:
            out[i] = tables[kind][np.frombuffer(data, np.uint8)]
        elif kind == IMA_ADPCM and width > 4:
            widths.setdefault(width, []).append(i)
    for width, own in widths.items():
        n = [-(-len(tracks[i][2]) // width) for i in own]
        pcm = decode_adpcm(np.frombuffer(b"".join(tracks[i][2].ljust(k * width, b"\0") for i, k in zip(own, n)), np.uint8).reshape(-1, width)) if sum(n) else np.empty((0, 2 * width - 7), "<i2")
        at = 0
        for i, k in zip(own, n):
            whole = pcm[at : at + k].ravel()
            own_bytes = len(tracks[i][2])
            full, rest = own_bytes // width, own_bytes % width
            out[i], at = whole[: full * (2 * width - 7) + (1 + 2 * (rest - 4) if rest >= 4 else 0)], at + k
    return out


def decode_media(df: DataFrame, media: str = "media", to: int = 16000) -> DataFrame:
    """df's columns and kind int, rate int, pcm binary: media's sound as mono 16-bit little-endian PCM at rate to.

    Null, empty or other media: kind, rate and pcm null. Columns kind, rate, pcm of df are replaced.
    """
    arrow_bounds(df.sparkSession)
    keep = [c for c in df.columns if c.lower() not in ("kind", "rate", "pcm")]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_media = b.column(keep.index(media)).to_pylist()
            for lo, hi in by_bytes([m or b"" for m in all_media], 4 << 20):
                read = [read_wav(m) for m in all_media[lo:hi]]
                pcm = iter(decode_many([(r[0], r[2], r[3]) for r in read if r]))
                rows = [(None, None, None) if r is None or (p := next(pcm)) is None or not r[1] else (r[0], to, resample(p, r[1], to).tobytes()) for r in read]
                part = b.slice(lo, hi - lo)
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=[*keep, "kind", "rate", "pcm"])

    return df.select(*[f"`{c}`" for c in keep]).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", kind int, rate int, pcm binary")


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's bytes, padded with 255 to a positive multiple of 576, as the samples of a mu-law file. Null text: empty. Codes are kept as they are, so the samples read back are the bytes."""
    arrow_bounds(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in by_bytes([t or "" for t in texts], 4 << 20):
                raw = [(t or "").encode() for t in texts[lo:hi]]
                media = [wav(MU_LAW, t.ljust(max(1, -(-len(t) // BLOCK)) * BLOCK, b"\xff")) for t in raw]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    one = docs.select("doc_id", "text")
    return one.mapInArrow(run, f"doc_id {dict(one.dtypes)['doc_id']}, n_bytes long, media binary")


def stored_texts(docs: DataFrame) -> DataFrame:
    """store_texts() as a written table of the shared folder, read again. Cases as there."""
    return saved(store_texts(docs), "media", compression="zstd")


def sound_features(stored: DataFrame, to: int = 16000) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of store_texts().

    All is computed from the stored file's samples: as they are (mu-law), and, to use every decoder, the same bytes
    taken as A-law and as ADPCM blocks of 576 bytes. feature names for each: samples, peak, mean square to the
    integer, sign changes and the CRC-32 of the PCM; mu-law's PCM is at the rate to.
    Null or other media: null in all columns but doc_id, n_bytes and, where there are bytes, media_bytes and media_sha256. Empty table: no rows.
    """
    arrow_bounds(stored.sparkSession)

    def summed(name: str, pcm: np.ndarray) -> str:
        x = pcm.astype(np.int64)
        return f"{name}:{len(x)},{np.abs(x).max(initial=0)},{int((x * x).sum()) // max(1, len(x))},{int(((x[1:] < 0) != (x[:-1] < 0)).sum())},{zlib.crc32(pcm.tobytes()):08x}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column(2).to_pylist()
            for lo, hi in by_bytes([m or b"" for m in files], 2 << 20):
                rows = []
                read = [read_wav(m) for m in files[lo:hi]]
                pcm = iter(decode_many([(kind, width, r[3]) for r in read if r and r[3] for kind, width in ((MU_LAW, 1), (A_LAW, 1), (IMA_ADPCM, BLOCK))]))
                for media, r in zip(files[lo:hi], read):
                    if not r or not r[3] or not r[1]:
                        for _ in range(3 if r and r[3] else 0):
                            next(pcm)
                        rows.append((None, None, None, None if media is None else len(media), None if media is None else hashlib.sha256(media).hexdigest(), None))
                        continue
                    rate, data = r[1], r[3]
                    mu, a, ima = next(pcm), next(pcm), next(pcm)
                    feature = ";".join((summed("mu", resample(mu, rate, to)), summed("a", a), summed("ima", ima)))
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
                part, cols = b.slice(lo, hi - lo), list(zip(*rows))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = dict(stored.dtypes)["doc_id"]
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
