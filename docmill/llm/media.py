"""Media columns: texts' bytes as PNG images in binary columns, read back and hashed by their low frequencies."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Side of the reduced picture, and of the block of low frequencies that the hash keeps.
SIDE, LOW = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(samples: np.ndarray, level: int = 1) -> bytes:
    """An 8-bit grey PNG of a (height, width) array, the smaller of two: all rows with the filter None, which suits texts, or each row with the
    cheaper of None and Up by its sum of differences, which suits pictures."""
    h, w = samples.shape
    rows = np.zeros((h, w + 1), np.uint8)
    rows[:, 1:] = samples
    data = zlib.compress(rows.tobytes(), level)
    up = samples.copy()
    up[1:] -= samples[:-1]
    cheaper = np.abs(up.astype(np.int8)).sum(axis=1, dtype=np.int64) < np.abs(samples.astype(np.int8)).sum(axis=1, dtype=np.int64)
    rows[:, 0] = np.where(cheaper, 2, 0)
    rows[:, 1:] = np.where(cheaper[:, None], up, samples)
    data = min(data, zlib.compress(rows.tobytes(), level), key=len)
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", data) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Undo the PNG row filters 0 to 4 for one byte a pixel. Runs of None and Up rows go by cumulated sums."""
    out = np.zeros_like(rows)
    h, w = rows.shape
    if kinds.max(initial=0) in (0, 2) and not np.isin(kinds, (1, 3, 4)).any():
        # a row of kind None restarts the running sum of its column
        total = np.cumsum(rows, axis=0, dtype=np.uint32)
        start = np.maximum.accumulate(np.where(kinds == 0, np.arange(h), 0))
        base = np.where(start[:, None] > 0, total[np.maximum(start - 1, 0)], 0)
        return (total - base).astype(np.uint8)
    above = np.zeros(w, np.uint8)
    for y in range(h):
        row, kind = rows[y], kinds[y]
        if kind == 0:
            out[y] = row
        elif kind == 1:
            out[y] = np.cumsum(row, dtype=np.uint32)
        elif kind == 2:
            out[y] = row + above
        elif kind == 3:
            left = 0
            for x in range(w):
                left = (int(row[x]) + (left + int(above[x])) // 2) & 255
                out[y, x] = left
        elif kind == 4:
            left = corner = 0
            for x in range(w):
                b = int(above[x])
                p = left + b - corner
                pa, pb, pc = abs(p - left), abs(p - b), abs(p - corner)
                near = left if pa <= pb and pa <= pc else b if pb <= pc else corner
                left = (int(row[x]) + near) & 255
                out[y, x], corner = left, b
        else:
            raise ValueError(f"PNG filter {kind}")
        above = out[y]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG without interlace; a damaged signature, checksum or length raises ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("cut chunk")
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(part) != n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(part, zlib.crc32(kind))):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            ended = True
            break
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("no 8-bit grey PNG")
    w, h = head[:2]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise ValueError("damaged pixels") from e
    if len(raw) != h * (w + 1):
        raise ValueError("wrong number of pixels")
    raw = raw.reshape(h, w + 1)
    return _unfilter(raw[:, 1:], raw[:, 0])


def _cosines(n: int) -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(n)[None, :]
    m = np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


_DCT = _cosines(SIDE)


def shrink(samples: np.ndarray) -> np.ndarray:
    """A SIDE x SIDE picture of block means; rows are repeated where there are fewer than SIDE."""
    h, w = samples.shape
    x = samples.reshape(h, SIDE, w // SIDE).mean(axis=2) if w % SIDE == 0 else samples[:, (np.arange(SIDE) * w) // SIDE].astype(float)
    edge = (np.arange(SIDE) * h) // SIDE
    if h < SIDE:
        return x[edge]
    return np.add.reduceat(x, edge, axis=0) / np.diff(np.append(edge, h))[:, None]


def cosine_hash(pictures: np.ndarray) -> np.ndarray:
    """64-bit hashes of (n, SIDE, SIDE) pictures: a bit says whether a low frequency exceeds the median of all but the mean.

    Frequencies are rounded, so that those that are equal but for the arithmetic's noise (as in flat pictures) stay equal.
    """
    f = _DCT @ pictures @ _DCT.T
    f = f.reshape(len(f), LOW * LOW).round(6)
    bits = f > np.median(f[:, 1:], axis=1)[:, None]
    bits[:, 0] = f[:, 0] > 127.5 * SIDE
    return np.packbits(bits, axis=1)


def as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 1) -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, zeros up to a positive multiple of 64, as a PNG of width 64.

    A null text counts as empty and gives one row of zeros; rows are neither merged nor dropped,
    other columns of `docs` are not read. PNG heights end at 2**31 - 1 rows, far beyond a Spark string.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, sizes, media, held = [], [], [], 0
            for i, t in zip(b["_id"], b["_text"], strict=True):
                raw = (t or "").encode("utf-8")
                pad = raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))
                png = encode_png(np.frombuffer(pad, np.uint8).reshape(-1, WIDTH), level)
                ids.append(i), sizes.append(len(raw)), media.append(png)
                held += len(png)
                if held > 16_000_000:
                    yield _frame(id=pd.array(ids, "Int64"), n_bytes=sizes, media=media)
                    ids, sizes, media, held = [], [], [], 0
            if ids:
                yield _frame(id=pd.array(ids, "Int64"), n_bytes=sizes, media=media)

    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return src.mapInPandas(make, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def _frame(**cols) -> pd.DataFrame:
    return pd.DataFrame(cols)


def media_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", size_col: str = "n_bytes") -> DataFrame:
    """Digests and features of stored PNGs (as_media's table), from the bytes read back.

    A damaged PNG raises: stored bytes that fail their checksum must not pass as data.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, pics = [], []
            for i, n, m in zip(b["_id"], b["_n"], b["_media"], strict=True):
                m = bytes(m)
                px = decode_png(m)
                payload = px.tobytes()
                rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest()))
                pics.append(shrink(px))
            if not rows:
                continue
            out = pd.DataFrame(rows, columns=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"])
            out["id"] = pd.array(out["id"], "Int64")
            hashes = cosine_hash(np.stack(pics))
            out["feature"] = [h.tobytes().hex() for h in hashes]
            out["feature_bits"] = [h.tobytes() for h in hashes]
            yield out

    src = media.select(F.col(id_col).alias("_id"), F.col(size_col).alias("_n"), F.col(media_col).alias("_media"))
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, feature_bits binary"
    return src.mapInPandas(read, schema).withColumnRenamed("id", id_col)
