"""Statistics of whole texts, computed for an Arrow column at a time (used by the quality rules and the quality classifier)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_text import SPACE, code_points, grams, lines, mix, slices, words
from .common import keyed

#: The columns that `text_stats` adds, all long.
COLUMNS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits",
    "n_marks", "n_exclaims", "n_distinct_words", "n_run_words", "n_symbol_words", "n_ended_lines", "n_long_words",
)


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOLS, _DIGITS, _MARKS = _flags(b"#*$%&|<>"), _flags(b"0123456789"), _flags(b".,;:?!()\"'-")
_UPPER, _LETTERS = _flags(bytes(range(65, 91))), _flags(bytes([*range(65, 91), *range(97, 123)]))
_ENDS = _flags(b".!?\"')")


def slice_stats(part) -> np.ndarray:
    """A row of COLUMNS for each row of the slice."""
    n, data = part.rows, part.data
    out = np.zeros((n, len(COLUMNS)), np.int64)
    col = {name: out[:, i] for i, name in enumerate(COLUMNS)}

    def per_row(hit: np.ndarray) -> np.ndarray:
        """Number of hits (a mask over the bytes) in each row."""
        return np.diff(np.searchsorted(np.flatnonzero(hit), part.bounds))

    w = words(part)
    m = len(w.start)
    row = np.repeat(np.arange(n), np.diff(w.first))
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    col["n_words"][:] = np.diff(w.first)
    starts = code_points(data)
    col["word_chars"][:] = per_row(starts & ~SPACE[data])
    symbol = _SYMBOLS[data]
    col["n_symbols"][:] = per_row(symbol)
    upper = _UPPER[data]
    col["n_upper"][:] = per_row(upper)
    col["n_letters"][:] = per_row(_LETTERS[data] | (starts & (data >= 0x80)))
    col["n_digits"][:] = per_row(_DIGITS[data])
    col["n_marks"][:] = per_row(_MARKS[data])
    col["n_exclaims"][:] = per_row(data == 33)
    if m:
        key = w.hash ^ salt[row]
        col["n_distinct_words"][:] = np.bincount(row[np.unique(key, return_index=True)[1]], minlength=n)
        col["n_run_words"][:] = np.bincount(row[1:][key[1:] == key[:-1]], minlength=n)
        col["n_symbol_words"][:] = np.bincount(row[np.add.reduceat(symbol, w.start) > 0], minlength=n)
        col["n_long_words"][:] = np.bincount(row[w.end - w.start > 30], minlength=n)
    if m >= 3:
        at = np.flatnonzero(row[:-2] == row[2:])  # windows inside a row
        key = grams(w.hash, 3)[at] ^ salt[row[at]]
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        again = at[count[back] > 1]
        covered = np.zeros(m, bool)
        for i in range(3):
            covered[again + i] = True
        col["n_repeat_words"][:] = np.bincount(row[covered], minlength=n)
    ln = lines(part)
    if len(ln.start):
        full = np.searchsorted(w.start, ln.end) > np.searchsorted(w.start, ln.start)
        at = np.repeat(np.arange(n), np.diff(ln.first))[full]
        key = ln.hash[full] ^ salt[at]
        col["n_lines"][:] = np.bincount(at, minlength=n)
        col["n_dup_lines"][:] = col["n_lines"] - np.bincount(at[np.unique(key, return_index=True)[1]], minlength=n)
        last = np.searchsorted(w.start, ln.end[full]) - 1
        col["n_ended_lines"][:] = np.bincount(at[_ENDS[data[w.end[last] - 1]]], minlength=n)
    return out


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text) and COLUMNS of every text. Words are ``[^\\x20\\x09-\\x0D]+``; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [slice_stats(p) for p in slices(b["text"])]
            if found:
                table = np.concatenate(found)
                yield pa.record_batch([b["doc_id"], b["key"], *(pa.array(table[:, i]) for i in range(len(COLUMNS)))], ["doc_id", "key", *COLUMNS])

    return keyed(docs).mapInArrow(run, "doc_id long, key long, " + ", ".join(f"{c} long" for c in COLUMNS))
