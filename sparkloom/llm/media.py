"""Media columns (operator 4): PNG images in binary columns, and cosine-transform hashes of what is read back.

`to_png` stores the text of each row as an 8-bit grey PNG, 64 samples wide;
`read_png` tests every chunk's checksum, inflates, undoes the row filters with
numpy and computes a low-frequency hash. Both work row by row inside
`mapInArrow`; nothing is shuffled and memory is bounded by one Arrow batch.

Cases: a null text counts as empty; an empty text is one row of 64 zero bytes;
equal texts give equal bytes; rows may repeat (each gives a row); an empty
table gives an empty table; columns other than doc_id and text are not read.
A damaged PNG raises ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_text import pieces
from .common import texts

#: Fixed value: the first eight bytes of every PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
LEVEL = 6


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """An 8-bit grey PNG whose samples are the payload. Each row takes the filter (none, sub, up) with the least sum of absolute differences."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub, up = image.copy(), image.copy()
    sub[:, 1:] -= image[:, :-1]
    up[1:] -= image[:-1]
    cost = np.stack([np.minimum(x, -x).sum(axis=1, dtype=np.int64) for x in (image, sub, up)])
    kind = cost.argmin(axis=0).astype(np.uint8)
    rows = np.empty((len(image), width + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = np.where((kind == 1)[:, None], sub, np.where((kind == 2)[:, None], up, image))
    head = struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(kind: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the five row filters of 8-bit grey images; none and sub at once, up by runs, the last two sample by sample."""
    out = rows.copy()
    sub = kind == 1
    out[sub] = np.cumsum(rows[sub], axis=1, dtype=np.uint8)
    if not (kind >= 2).any():
        return out
    edges = np.flatnonzero(np.diff(kind)) + 1
    for a, b in zip(np.r_[0, edges].tolist(), np.r_[edges, len(kind)].tolist(), strict=True):
        if kind[a] == 2:
            top = out[a - 1 : a] if a else np.zeros((1, rows.shape[1]), np.uint8)
            out[a:b] = np.cumsum(np.concatenate([top, rows[a:b]]), axis=0, dtype=np.uint8)[1:]
        elif kind[a] >= 3:
            for y in range(a, b):
                above = out[y - 1].tolist() if y else [0] * rows.shape[1]
                left = corner = 0
                line = []
                for x, v in zip(rows[y].tolist(), above, strict=True):
                    if kind[a] == 3:
                        guess = (left + v) // 2
                    else:
                        p = left + v - corner
                        guess = min((left, v, corner), key=lambda c, p=p: abs(p - c))
                    left, corner = (x + guess) & 255, v
                    line.append(left)
                out[y] = line
    return out


def decode_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit grey, not interlaced PNG; ValueError if the signature, a checksum or the size is wrong."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, data, ended = 8, None, [], False
    while at < len(media) and not ended:
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(body) != n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey PNG")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(raw) != head[1] * (head[0] + 1):
        raise ValueError("wrong number of samples")
    raw = raw.reshape(head[1], head[0] + 1)
    return unfilter(raw[:, 0], raw[:, 1:])


def _cosines(n: int = 32, low: int = 8) -> np.ndarray:
    return np.cos(np.pi * np.arange(low)[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n))


_COSINES = _cosines()


def _to_32(image: np.ndarray, axis: int) -> np.ndarray:
    n = image.shape[axis]
    at = np.arange(32) * n // 32
    if n < 32:
        return image.take(at, axis=axis)
    count = np.diff(np.r_[at, n])
    return np.add.reduceat(image, at, axis=axis) / (count[:, None] if axis == 0 else count)


def cosine_hash(image: np.ndarray) -> str:
    """64 bits: which of the 8 x 8 lowest cosine coefficients of the image, shrunk to 32 x 32, exceed their median."""
    small = _to_32(_to_32(image.astype(np.float64), 0), 1)
    low = np.round(_COSINES @ small @ _COSINES.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """data and bytes 0 up to a positive multiple of width."""
    return data + bytes(-len(data) % width or (0 if data else width))


def to_png(docs: DataFrame, level: int = LEVEL) -> DataFrame:
    """doc_id, n_bytes (UTF-8 length of the text), media (the PNG)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            data = [x or b"" for x in b["text"].cast(pa.binary()).to_pylist()]
            media = [encode_png(padded(x), level=level) for x in data]
            yield pa.record_batch([b["doc_id"], pa.array(map(len, data), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts(docs).mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def read_png(images: DataFrame) -> DataFrame:
    """The columns of to_png's result and, from the stored bytes: payload (the samples) and feature (their hash)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "media"):
            found = [decode_png(x) for x in b["media"].to_pylist()]
            new = [pa.array([x.tobytes() for x in found], pa.binary()), pa.array(map(cosine_hash, found), pa.string())]
            yield pa.record_batch([b["doc_id"], b["n_bytes"], b["media"], *new], ["doc_id", "n_bytes", "media", "payload", "feature"])

    return images.mapInArrow(decode, "doc_id long, n_bytes long, media binary, payload binary, feature string")
