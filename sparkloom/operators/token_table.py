"""Embeddings by a learnt table of token vectors.

`token_table` learns the table from texts: a token's vector is the sum of the
random signs of the tokens that stand up to `window` places from it, which is a
random projection of its co-occurrence counts that never holds the counts
themselves: tokens are split by Spark, each slice of texts is
summed in arrays, sums of frequent tokens go on from slice to slice of a task, and there is one shuffle of these partial sums, which are added up in order of tokens. Signs are bits of a token's hash, so nothing is drawn and every run agrees. Everything is in 64-bit integers, so sums don't depend on their order.

`table_vectors` embeds texts: the sum over a text's tokens of their scaled vectors, each by
its rarity weight, by one join on the token, for which only the table's rows of these tokens are dealt out, and one sum by text.

Cases: a null text and one without tokens have no tokens and the zero vector; a
token without neighbours has zeros; tokens that the table lacks count for nothing;
rows with one id count as one text, those without an id too; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import staged

#: Signs come from as many bits of a hash, 32 at most.
DIMENSION = 32
#: A scaled vector's absolute values sum to about SCALE; weights go from RARE down to 1, for a token that is all there is, and have half of RARE at about one in RARE tokens.
SCALE, RARE = 1000, 1000
#: Tokens whose neighbours are summed at once, and bytes of texts that are split at once.
TOKENS, BYTES = 1_000_000, 5_000_000
#: Sums of tokens that a task holds before it gives on those of rarer ones.
HELD = 500_000
#: The bytes of tokens, as \w has them.
WORD = np.array([chr(b) in "0123456789_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" for b in range(256)])


def _lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text.cast("string"), F.lit("")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(_lowered(text), F.lit(r"\w+"), F.lit(0))


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def token_table(texts: DataFrame, text_col: str = "text", dimension: int = DIMENSION, window: int = 2) -> DataFrame:
    """(token, n, weight, vector): occurrences, rarity weight (1 to RARE) and scaled vector of each token of the texts."""
    if not 1 <= dimension <= 32 or window < 1:
        raise ValueError("1 to 32 dimensions and a window of 1 or more")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for words in _words(batch.column(0)):
                for texts in _slices(words) if len(words.values) else ():
                    held.append(_summed(texts, dimension, window))
                    if sum(x.num_rows for x in held) > HELD:
                        rare, often = _parted(_merged(held, dimension), window)
                        held = [often]
                        yield _packed(rare)
        if held:
            yield _packed(_merged(held, dimension))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            *done, left = _totals(_unpacked(batch, dimension), left, dimension)
            yield from map(_scaled, done)
        if left is not None:
            yield _scaled(left)

    rows = texts.select(_lowered(F.col(text_col)).alias("text"))
    part = rows.mapInArrow(parts, "token string, n long, vector binary").repartition("token").sortWithinPartitions("token")
    table = staged(part.mapInArrow(whole, "token string, n long, vector array<long>"), "sums")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))  # one row
    return table.crossJoin(F.broadcast(total)).select("token", "n", F.expr(f"({RARE} * total) div (total + {RARE - 1} * n)").alias("weight"), "vector")


def _rows(token: pa.Array, n: np.ndarray, vector: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(len(n) + 1, dtype=np.int32) * vector.shape[1]
    return pa.RecordBatch.from_arrays([token, pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(vector.ravel()))], names=["token", "n", "vector"])


def _totals(batch: pa.RecordBatch, left: pa.RecordBatch | None, dimension: int) -> list[pa.RecordBatch]:
    """Rows of (token, n, vector) in order of tokens, summed by token: all but the last token, and that, which may go on in the next batch. left is the last one before."""
    own = [x for x in (left, batch) if x is not None and x.num_rows]
    if not own:
        return [left]
    token = pa.concat_arrays([x.column(0).cast(pa.string()) for x in own])
    n = np.concatenate([x.column(1).to_numpy() for x in own])
    vector = np.concatenate([x.column(2).flatten().to_numpy().astype(np.int64) for x in own]).reshape(-1, dimension)
    code = token.dictionary_encode().indices.to_numpy()
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    out = _rows(token.take(pa.array(starts)), np.add.reduceat(n, starts), np.add.reduceat(vector, starts, axis=0))
    return [out.slice(0, out.num_rows - 1), out.slice(out.num_rows - 1)] if out.num_rows > 1 else [out]


def _scaled(sums: pa.RecordBatch) -> pa.RecordBatch:
    v = sums.column(2).flatten().to_numpy().reshape(sums.num_rows, -1)
    size = np.maximum(np.abs(v).sum(axis=1, keepdims=True), 1)
    return _rows(sums.column(0), sums.column(1).to_numpy(), np.sign(v) * (np.abs(v) * SCALE // size))


def _cuts(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of items, whose ends are given after a first start, that have `most` together at most; a longer item is alone."""
    first = 0
    while first < len(ends) - 1:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, side="right")) - 1)
        yield first, last
        first = last


def _slices(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """Runs of lists that hold at most TOKENS tokens together; a longer list is alone."""
    for first, last in _cuts(lists.offsets.to_numpy(), TOKENS):
        yield lists.slice(first, last - first)


def _words(texts: pa.StringArray) -> Iterator[pa.ListArray]:
    """The tokens of each text, by runs of texts of BYTES bytes at most; a longer text is alone."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends or bytes(8), kind)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    for first, last in _cuts(ends, BYTES):
        own, bounds = data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        word = WORD[own]
        begins, stops = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        stops[:-1] &= ~word[1:]
        inner = bounds[(bounds > 0) & (bounds < len(own))]  # no token goes on from text to text
        begins[inner], stops[inner - 1] = word[inner], word[inner - 1]
        at = np.flatnonzero(begins)
        starts = np.append(0, np.cumsum(np.flatnonzero(stops) + 1 - at)).astype(np.int32)
        found = pa.StringArray.from_buffers(len(at), pa.py_buffer(starts), pa.py_buffer(own[word]))
        yield pa.ListArray.from_arrays(pa.array(np.searchsorted(at, bounds).astype(np.int32)), found)


def _merged(sums: list[pa.RecordBatch], dimension: int) -> pa.RecordBatch:
    """The sums of batches in each of which a token is there once."""
    found = pa.concat_arrays([x.column(0) for x in sums]).dictionary_encode()
    code, known, first = found.indices.to_numpy(), found.dictionary, 0
    n, v = np.zeros(len(known), np.int64), np.zeros((len(known), dimension), np.int32)
    for x in sums:
        own = code[first : first + x.num_rows]
        n[own] += x.column(1).to_numpy()
        v[own] += x.column(2).flatten().to_numpy().reshape(-1, dimension)
        first += x.num_rows
    return _rows(known, n, v)


def _parted(sums: pa.RecordBatch, window: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Sums to give on, and those of at most a quarter of HELD tokens, the most frequent ones, that more can be added to: a number has 32 bits."""
    n, most = sums.column(1).to_numpy(), HELD // 4
    least = np.partition(n, -most)[-most] if 0 < most <= len(n) else 0
    often = (n > least) & (n < 2**29 // window)
    return sums.filter(pa.array(~often)), sums.filter(pa.array(often))


def _packed(sums: pa.RecordBatch) -> pa.RecordBatch:
    """Vectors as bytes: one for each number where they fit, else four."""
    v = sums.column(2).flatten().to_numpy().reshape(sums.num_rows, -1)
    small = np.abs(v).max(axis=1, initial=0) < 128
    ends = np.append(0, np.cumsum(np.where(small, 1, 4) * v.shape[1])).astype(np.int32)
    out, wide = np.empty(ends[-1], np.uint8), np.repeat(~small, np.diff(ends))
    out[~wide], out[wide] = v[small].astype(np.int8).view(np.uint8).ravel(), v[~small].astype("<i4").view(np.uint8).ravel()
    vector = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(ends), pa.py_buffer(out)])
    return pa.RecordBatch.from_arrays([sums.column(0), sums.column(1), vector], names=["token", "n", "vector"])


def _unpacked(sums: pa.RecordBatch, dimension: int) -> pa.RecordBatch:
    held = sums.column(2).cast(pa.large_binary())
    ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    data = np.frombuffer(held.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    small, v = np.diff(ends) == dimension, np.empty((len(held), dimension), np.int32)
    wide = np.repeat(~small, np.diff(ends))
    v[small], v[~small] = data[~wide].view(np.int8).reshape(-1, dimension), data[wide].view("<i4").reshape(-1, dimension)
    return _rows(sums.column(0), sums.column(1).to_numpy(), v)


def _summed(texts: pa.ListArray, dimension: int, window: int) -> pa.RecordBatch:
    """(token, n, vector) of the tokens of lists: occurrences and, by bit, the summed signs of their neighbours.

    Neighbours with a set bit are counted in lanes of 8 bits or more, several of
    which are added in one number, over pieces of so few places that no lane is exceeded.
    """
    words = texts.flatten().dictionary_encode()
    code, known = words.indices.to_numpy(), words.dictionary
    hashes = b"".join([md5(w.encode()).digest() for w in known.to_numpy(zero_copy_only=False)])
    h = np.frombuffer(hashes, ">u4")[::4].astype(np.int64)
    near_by = 2 * max(1, min(window, len(code) - 1))
    lane = next(x for x in (np.uint8, np.uint16, np.uint32) if np.iinfo(x).max >= 16 * near_by or x is np.uint32)
    bits = np.zeros((len(known), -(-dimension // 8) * 8), lane)
    bits[:, :dimension] = (h[:, None] >> np.arange(dimension)) & 1
    own = bits.view(np.uint64)[code]
    near, n_near = np.zeros_like(own), np.zeros(len(code))
    text = np.repeat(np.arange(len(texts)), np.diff(texts.offsets.to_numpy()))
    for k in range(1, near_by // 2 + 1 if len(code) > 1 else 1):
        same = text[k:] == text[:-k]
        mask = np.where(same, np.uint64(2**64 - 1), np.uint64(0))[:, None]
        near[k:] += own[:-k] & mask
        near[:-k] += own[k:] & mask
        n_near[k:] += same
        n_near[:-k] += same
    n = np.bincount(code, minlength=len(known))
    most = np.iinfo(lane).max // near_by
    pieces = -(-n // most)
    first = np.cumsum(pieces) - pieces
    at = np.arange(pieces.sum()) - np.repeat(first, pieces)
    sums = np.add.reduceat(near[np.argsort(code)], np.repeat(np.cumsum(n) - n, pieces) + at * most, axis=0)
    lanes = sums.view(lane)[:, :dimension].astype(np.int32)
    out, several = lanes[first], np.flatnonzero(pieces > 1)
    if len(several):
        own = np.flatnonzero(np.repeat(pieces > 1, pieces))
        out[several] = np.add.reduceat(lanes[own], np.cumsum(pieces[several]) - pieces[several], axis=0)
    total = np.bincount(code, weights=n_near, minlength=len(known)).astype(np.int32)
    return _rows(known, n, 2 * out - total[:, None])


def table_vectors(texts: DataFrame, table: DataFrame, id_col: str = "id", text_col: str = "text", dimension: int = DIMENSION, salts: int = 16) -> DataFrame:
    """(id, n_tokens, sums, vector): the weighted sums and their unit vector (zeros where they are zero).

    A token's rows are dealt to `salts` parts, and its row of the table goes to those that have any, so that a token of nearly all texts is not one task's.
    """
    own = texts.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ts"))
    counts = own.select("id", F.explode_outer("ts").alias("token")).groupBy("id", "token").agg(F.count("token").alias("n"))
    counts = staged(counts.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")), "counts")
    used = counts.groupBy("token", "salt").agg(F.sum("n").alias("uses")).filter("uses > 0")
    known = table.select("token", "weight", "vector").join(used, "token").drop("uses")
    part = counts.join(known, ["token", "salt"], "left")
    by = F.col("n") * F.col("weight")
    sums = part.groupBy("id").agg(F.sum("n").alias("n_tokens"), *[F.coalesce(F.sum(by * F.get("vector", F.lit(j))), F.lit(0)).cast("long").alias(f"v{j}") for j in range(dimension)])
    v = [F.col(f"v{j}") for j in range(dimension)]
    size = F.sqrt(_total([x.cast("double") * x for x in v]))
    return sums.select("id", "n_tokens", F.array(*v).alias("sums"), F.array(*[F.when(size > 0, x / size).otherwise(0.0) for x in v]).alias("vector"))
