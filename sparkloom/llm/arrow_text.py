"""Vectorised tokenising of Arrow string columns: words, hashes, shingles.

Every helper works on the UTF-8 buffer of a whole Arrow column at once, in
slices of bounded size, so that there is no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space, the complement of ``[^\x20\x09-\x0D]``.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Rows are cut into slices of about this many bytes.
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_multipliers = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def multipliers(n: int) -> np.ndarray:
    """The first n odd 64-bit multipliers of the string hash."""
    global _multipliers
    if n > len(_multipliers):
        _multipliers = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _multipliers[:n]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into parts of about `most` bytes of a column, so that what a task makes of one part stays small."""
    for b in batches:
        step = max(1, int(b.num_rows * most / max(1, b[column].nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
    pa.default_memory_pool().release_unused()  # a worker lives on after its task


@dataclass
class Slice:
    """Rows first .. first + rows of a batch; data is their UTF-8, bounds the byte offsets of rows in it."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column (null counts as empty) into slices of about `most` bytes, at least one row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, len(column))
        yield Slice(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


@dataclass
class Tokens:
    """Tokens of a slice, in order: byte spans, row of each, 64-bit hash of each; first: index of each row's first token, one more at the end."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def tokens(part: Slice, inside: np.ndarray, lower: bool = False) -> Tokens:
    """Maximal runs of bytes b with inside[b], never across rows."""
    data, bounds = part.data, part.bounds
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Tokens(z, z, np.zeros(0, np.uint64), np.zeros(part.rows + 1, np.int64))
    keep = inside[data]
    opens = np.zeros(n + 1, bool)
    opens[bounds] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = keep[:-1]
    start = np.flatnonzero(keep & (~before | opens[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = keep[1:]
    end = np.flatnonzero(keep & (~after | opens[1:])) + 1
    first = np.searchsorted(start, bounds)
    if len(start) == 0:
        return Tokens(start, end, np.zeros(0, np.uint64), first)
    length = end - start
    at = np.arange(n, dtype=np.int64)
    at -= np.repeat(start, np.diff(np.r_[0, start[1:], n]))
    np.clip(at, 0, length.max() - 1, out=at)  # only bytes outside tokens are clipped
    value = ((LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * multipliers(int(length.max()))[at]
    value[~keep] = 0
    return Tokens(start, end, mix(np.add.reduceat(value, start) + length.astype(np.uint64)), first)


def words(part: Slice, lower: bool = False) -> Tokens:
    """``[^\\x20\\x09-\\x0D]+`` of every row."""
    return tokens(part, ~SPACE, lower)


_LINE = np.ones(256, bool)
_LINE[10] = False


def lines(part: Slice) -> Tokens:
    """Non-empty ``\\n``-split lines of every row."""
    return tokens(part, _LINE)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k token hashes."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    m = multipliers(k + 8)[8:]
    out = h[: len(h) - k + 1] * m[0]
    for i in range(1, k):
        out = out + (h[i : len(h) - k + 1 + i] ^ (h[i : len(h) - k + 1 + i] >> np.uint64(29))) * m[i]
    return mix(out)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-shingle hashes of a token sequence; a shorter sequence is one shingle, none has none."""
    if len(h) == 0:
        return h
    return np.unique(grams(h, k)) if len(h) >= k else grams(h, len(h)) + np.uint64(len(h))


def code_points(data: np.ndarray) -> np.ndarray:
    """True at each byte that begins a code point."""
    return (data & 0xC0) != 0x80
