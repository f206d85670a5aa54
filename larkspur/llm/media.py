"""Media columns: Netpbm and BMP images decoded to numpy, area-resized, tiled and hashed.

``media_table`` stores each document's bytes losslessly as an image, ``media_features`` decodes
stored images whatever their format, resizes them by integral images and returns NPY tiles with
64-bit difference hashes.

Defined cases: a null or empty text is one row of padding; a null doc_id stays null; repeated rows
give repeated rows; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm.common import materialize, texts, tune

SIDE = 24  #: pixels a row; SIDE * SIDE bytes make a block
TILE = 16  #: side of the resized tile


# ---------------------------------------------------------------- codecs


def encode_pgm(pixels: np.ndarray) -> bytes:
    """A (height, width) uint8 array as binary PGM."""
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_ppm(pixels: np.ndarray) -> bytes:
    """A (height, width, 3) uint8 array as binary PPM."""
    h, w, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A gray (palette) or RGB uint8 array as an uncompressed bottom-up BMP."""
    gray = pixels.ndim == 2
    h, w = pixels.shape[:2]
    row = pixels if gray else pixels[:, :, ::-1].reshape(h, w * 3)
    pad = -row.shape[1] % 4
    body = np.pad(row[::-1], ((0, 0), (0, pad))).astype(np.uint8).tobytes()
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) * np.array([1, 1, 1, 0], np.uint8) if gray else np.zeros((0, 4), np.uint8)
    start = 54 + palette.nbytes
    head = struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if gray else 24, 0, len(body), 2835, 2835, 256 if gray else 0, 0)
    return head + info + palette.tobytes() + body


_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*(\S+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6: (height, width) or (height, width, 3); samples scaled to 8 bits unless maxval is 255."""
    kind, at, head = data[:2], 2, []
    while len(head) < (2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("truncated Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h = head[:2]
    top = head[2] if len(head) > 2 else 1
    if not 0 < top < 65536:
        raise ValueError("maxval out of range")
    depth = 3 if kind in (b"P3", b"P6") else 1
    n = w * h * depth
    if kind == b"P4":
        bits = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1)
        px = 1 - np.unpackbits(bits, axis=1)[:, :w]
    elif kind in (b"P5", b"P6"):
        px = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    elif kind == b"P1":
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        px = 1 - np.array([c - 48 for c in body if c in (48, 49)][:n], np.int64)
    elif kind in (b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        px = np.array(body.split()[:n], np.int64)
    else:
        raise ValueError("not a Netpbm image")
    if px.size != n:
        raise ValueError("truncated Netpbm image")
    px = px.astype(np.uint8) if top == 255 else ((px.astype(np.int64) * 510 + top) // (2 * top)).astype(np.uint8)
    return px.reshape((h, w, 3) if depth == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits; a gray palette gives a 2-D array, else RGB."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    (start,) = struct.unpack_from("<I", data, 10)
    size, w, h, _, bits, method = struct.unpack_from("<IiiHHI", data, 14)
    if method not in (0, 3):
        raise ValueError(f"BMP compression {method} is not supported")
    up, h = h > 0, abs(h)
    stride = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride)
    rows = rows[::-1] if up else rows
    if bits in (24, 32):
        k = bits // 8
        return rows[:, : w * k].reshape(h, w, k)[:, :, 2::-1].copy()
    if bits == 8:
        index = rows[:, :w]
    elif bits == 4:
        index = np.stack([rows >> 4, rows & 15], 2).reshape(h, -1)[:, :w]
    elif bits == 1:
        index = np.unpackbits(rows, axis=1)[:, :w]
    else:
        raise ValueError(f"BMP of {bits} bits is not supported")
    (used,) = struct.unpack_from("<I", data, 46)
    palette = np.frombuffer(data, np.uint8, 4 * (used or 1 << bits), 14 + size).reshape(-1, 4)[:, 2::-1]
    gray = (palette == palette[:, :1]).all()
    return (palette[:, 0] if gray else palette)[index]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


# ---------------------------------------------------------------- resize and hash


def _edges(integral: np.ndarray, n: int) -> np.ndarray:
    """Rows of an integral image at n + 1 even, possibly fractional, cuts."""
    at = np.arange(n + 1) * ((len(integral) - 1) / n)
    low = np.minimum(at.astype(np.int64), len(integral) - 2)
    part = (at - low).reshape((-1,) + (1,) * (integral.ndim - 1))
    return integral[low] * (1 - part) + integral[low + 1] * part


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each output cell's area, from an integral image; float64."""
    h, w = pixels.shape[:2]
    total = np.zeros((h + 1, w + 1) + pixels.shape[2:])
    total[1:, 1:] = pixels.astype(np.float64).cumsum(0).cumsum(1)
    rows = np.diff(_edges(total, height), axis=0)
    cells = np.diff(np.swapaxes(_edges(np.swapaxes(rows, 0, 1), width), 0, 1), axis=1)
    return cells / ((h / height) * (w / width))


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits: is each cell of an 8 x 9 reduction brighter than its left neighbour."""
    if pixels.ndim == 3:
        pixels = pixels.mean(2)
    small = np.round(area_resize(pixels, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


# ---------------------------------------------------------------- Spark


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        media, size = [], []
        for t in texts(b):
            n = max(1, -(-len(t) // (SIDE * SIDE))) * SIDE * SIDE
            media.append(encode_pgm(np.frombuffer(t.ljust(n, b"\xff"), np.uint8).reshape(-1, SIDE)))
            size.append(len(t))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for data in b.column("media").to_pylist():
            pixels = decode(data)
            payload = pixels.tobytes()
            tile = np.clip(np.round(area_resize(pixels, TILE, TILE)), 0, 255).astype(np.uint8)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(pixels), npy(tile)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], FEATURE_NAMES)


FEATURE_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_npy"]
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_npy binary"


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a PGM of SIDE pixels a row, padded with 255."""
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Decode stored images (Netpbm or BMP) and return checks, difference hash and NPY tile of each."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, FEATURES)


def store_and_read(docs: DataFrame) -> DataFrame:
    """Store every document as an image in the shared folder, read the stored bytes back, compute features."""
    tune(docs.sparkSession)
    return media_features(materialize(media_table(docs), "media"))
