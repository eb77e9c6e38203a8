"""SimHash near-duplicates (operator 12) by anchor-point covering.

A fingerprint has 64 bits; a bit is set if over half of a text's shingle hashes
have it. The anchors are the pairs of words of the binary Golay code of 23 bits
over bits 0-22 and 23-45 of a fingerprint: that code is perfect with covering
radius 3, so each fingerprint has one home anchor, within 3 of it in either
part. If two fingerprints differ in at most 2 bits, each of them lies within
3 + i and 3 + j of the home of the other in the two parts, with i + j <= 2. So
every fingerprint is replicated to all anchors so near (some 61 of 2^24), those
that are nobody's home left out by a table of 2 MB, and compared with what is
at home there.

The rows of an anchor are compared in bounded blocks, in one task, which gives
links to the least fingerprint of each component and not all pairs. Anchors
with over MOST rows are not one group: their fingerprints are dealt to the
anchors of the finest covering code, all 2^64 words with covering radius 0.
There two that differ in at most 2 bits have a word in common within 1 of both,
and no more than 65 distinct fingerprints are at one word.

Cases: a null, empty or blank text has fingerprint zero and links like any
other; a text of one or two words is one shingle; rows are linked by their
fingerprints, so repeated rows and equal texts share a component; a fingerprint
that only rows without a doc_id have links with nothing and has no component;
an empty table gives an empty one; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import LOWER, pieces, slices, words
from .common import Stages, staged, texts
from .linking import components

#: Bits, the greatest difference that links, and the bits of a part that an anchor covers.
BITS, APART, PART = 64, 2, 23
#: Covering radius of the code, and its generator polynomial (a fixed value).
RADIUS, GOLAY = 3, 0xC75
#: Most rows of an anchor that are compared as one group, and pairs that are compared at once.
MOST, BLOCK = 1 << 15, 1 << 20
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprints(column: pa.Array, k: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """Fingerprints of the texts of a column, a slice at a time."""
    digest = xxhash.xxh64_intdigest
    for part in slices(column):
        w = words(part)
        n = np.diff(w.first)
        out = np.zeros(part.rows, np.uint64)
        if len(w.start) == 0:
            yield out
            continue
        # the words of the slice with one space after each, so that a shingle is one run of bytes
        length = w.end - w.start
        ends = np.cumsum(length + 1) - 1
        joined = np.full(int(ends[-1]) + 1, 32, np.uint8)
        at = np.arange(len(joined), dtype=np.int64)
        owner = np.repeat(np.arange(len(length)), length + 1)
        at -= (ends - length)[owner]
        inside = at < length[owner]
        joined[inside] = LOWER[part.data[(at + w.start[owner])[inside]]]
        text = joined.tobytes()
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        of = np.repeat(np.arange(part.rows), count)
        left = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + w.first[of]
        right = left + np.minimum(k, n[of]) - 1
        for lo in range(0, len(of), CHUNK):
            some = slice(lo, lo + CHUNK)
            begins, stops = (ends - length)[left[some]].tolist(), ends[right[some]].tolist()
            h = np.fromiter((digest(text[a:b], seed) for a, b in zip(begins, stops, strict=True)), np.uint64, len(begins))
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            mine = of[some]
            heads = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
            sums = np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
            if lo == 0:
                ones = np.zeros((part.rows, BITS), np.int64)
            ones[mine[heads]] += sums
        set_ = 2 * ones > count[:, None]
        yield np.packbits(set_, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def signed(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and print (the fingerprint as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 4 << 20):
            found = list(fingerprints(b["text"], k, seed))
            yield pa.record_batch([b["doc_id"], pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], ["doc_id", "print"])

    return texts(docs).mapInArrow(run, "doc_id long, print long")


def _remainder(x: np.ndarray) -> np.ndarray:
    """Remainders (11 bits) of 23-bit polynomials by the generator: the syndromes of words."""
    x = x.astype(np.int64).copy()
    for bit in range(PART - 1, 10, -1):
        x ^= np.where(x >> bit & 1, GOLAY << (bit - 11), 0)
    return x


@cache
def _patterns() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of weight RADIUS + APART at most, by syndrome and weight; the first of each syndrome; how many of each syndrome have weight RADIUS + 0, 1, 2 at most.

    A word x is within the weight of a pattern of its syndrome from the code word x ^ pattern.
    """
    masks, layer = [np.zeros(1, np.int64)], np.zeros(1, np.int64)
    for _ in range(RADIUS + APART):
        layer = np.unique((layer[:, None] | (1 << np.arange(PART))).ravel())
        layer = layer[np.bitwise_count(layer) == np.bitwise_count(masks[-1][0]) + 1]
        masks.append(layer)
    e = np.concatenate(masks)
    weight, s = np.bitwise_count(e).astype(np.int64), _remainder(e)
    order = np.lexsort((e, weight, s))
    e, weight, s = e[order], weight[order], s[order]
    counts = np.array([np.bincount(s[weight <= RADIUS + i], minlength=1 << 11) for i in range(APART + 1)])
    return e, np.searchsorted(s, np.arange(1 << 11)), counts


def _parts(x: np.ndarray) -> list[np.ndarray]:
    x = x.view(np.uint64)
    mask = np.uint64((1 << PART) - 1)
    return [(x & mask).astype(np.int64), ((x >> np.uint64(PART)) & mask).astype(np.int64)]


def _anchor(words_: list[np.ndarray]) -> np.ndarray:
    """Number (24 bits) of a pair of code words, by their 12 upper bits, which tell them apart."""
    return (words_[0] >> 11) << 12 | words_[1] >> 11


def homes(x: np.ndarray) -> np.ndarray:
    """The home anchor of each fingerprint."""
    e, first, _ = _patterns()
    return _anchor([p ^ e[first[_remainder(p)]] for p in _parts(x)])


def near_anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor) of all anchors within the covering radius plus the threshold of each fingerprint, its home included."""
    e, first, counts = _patterns()
    p, q = _parts(x)
    s, t = _remainder(p), _remainder(q)
    n = counts[APART][s]
    i = np.repeat(np.arange(len(x)), n)
    at = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    one = e[first[s[i]] + at]
    over = np.maximum(0, np.bitwise_count(one).astype(np.int64) - RADIUS)
    m = counts[APART - over, t[i]]  # what the first part leaves to the second
    j = np.repeat(np.arange(len(i)), m)
    at = np.arange(len(j)) - np.repeat(np.cumsum(m) - m, m)
    two = e[first[t[i[j]]] + at]
    return i[j], _anchor([p[i[j]] ^ one[j], q[i[j]] ^ two])


def _least(x: np.ndarray, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels (indices into x) after joining a[i] and b[i]: the least index of each component."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def compared(anchor: np.ndarray, home: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b), b the least of a's component, of rows sorted by anchor: each fingerprint at home with each that visits its anchor, or is at home there."""
    values, row = np.unique(x, return_inverse=True)
    label = np.arange(len(values))
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    at_home = np.flatnonzero(home)
    group = np.searchsorted(starts, at_home, "right") - 1
    todo = sizes[group]  # each at home meets all rows of its anchor
    lo = 0
    while lo < len(at_home):
        hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(todo[lo : lo + BLOCK]), BLOCK, "right")))
        n = todo[lo:hi]
        left = np.repeat(at_home[lo:hi], n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[group[lo:hi]], n)
        hit = np.bitwise_count((x[left] ^ x[right]).view(np.uint64)) <= APART  # of signed numbers it counts the absolute value
        label = _least(values, row[left[hit]], row[right[hit]], label)
        lo = hi
    far = np.flatnonzero(label != np.arange(len(values)))
    return values[far], values[label[far]]


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `print` of a table that join all that differ in APART bits at most, by chains at least."""
    spark = prints.sparkSession
    stage = Stages(spark)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = np.unique(homes(b["print"].to_numpy()))
            word, first = np.unique(a >> 6, return_index=True)
            bit = np.uint64(1) << (a & 63).astype(np.uint64)
            yield pa.record_batch([pa.array(word), pa.array(np.bitwise_or.reduceat(bit, first).view(np.int64) if len(a) else [], pa.int64())], ["word", "bits"])

    held = np.zeros(1 << 18, np.int64)  # 2^24 bits, one for each anchor
    for r in prints.mapInArrow(at_home, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        held[r["word"]] = r["bits"]
    shared = spark.sparkContext.broadcast(held)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            x = b["print"].to_numpy()
            for lo in range(0, len(x), 4096):
                some = x[lo : lo + 4096]
                i, anchor = near_anchors(some)
                keep = bits[anchor >> 6] >> (anchor & 63) & 1 == 1
                i, anchor = i[keep], anchor[keep]
                home = homes(some)
                yield pa.record_batch([pa.array(anchor.astype(np.int32)), pa.array(home[i] == anchor), pa.array(some[i])], ["anchor", "home", "print"])

    rows = stage(prints.mapInArrow(visit, "anchor int, home boolean, print long"), "anchors")
    sizes = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    rows = rows.join(sizes, "anchor")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; an anchor's are held until the next one's come."""
        kept: list[list[np.ndarray]] = []

        def out(anchor: np.ndarray, home: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            a, b = compared(anchor, home, x)
            return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            if b.num_rows == 0:
                continue
            kept.append([b["anchor"].to_numpy(), b["home"].to_numpy(zero_copy_only=False), b["print"].to_numpy()])
            if kept[0][0][0] == kept[-1][0][-1]:
                continue
            whole = [np.concatenate(c) for c in zip(*kept, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            kept = [[c[cut:] for c in whole]]
            yield out(*[c[:cut] for c in whole])
        if kept:
            yield out(*[np.concatenate(c) for c in zip(*kept, strict=True)])

    near = rows.filter(F.col("rows") <= MOST).select("anchor", "home", "print").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long")
    crowd = rows.filter(F.col("rows") > MOST).select("print").distinct()
    one = F.array(*[F.lit(0).cast("long"), *[F.lit((1 << i) if i < 63 else -(1 << 63)).cast("long") for i in range(BITS)]])
    finest = crowd.select("print", F.explode(one).alias("flip")).select("print", F.expr("print ^ flip").alias("word"))
    met = finest.groupBy("word").agg(F.min("print").alias("b"), F.collect_set("print").alias("all")).filter(F.size("all") > 1)  # 65 at most
    found = near.unionByName(met.select(F.explode("all").alias("a"), "b").filter("a <> b"))
    out = staged(found.distinct(), "links")
    stage.drop()
    return out


def joined(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, print and component_id (least doc_id reachable) of every document."""
    own = staged(signed(docs, k, seed), "prints")
    least = staged(own.filter("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("least")), "least")
    part = components(links(least.select("print")))
    named = least.join(part, least["print"] == part["node"], "left").select("print", "least", F.coalesce("component", "print").alias("component"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(first, "component").select("print", "component_id")
    return own.join(named, "print", "left").select("doc_id", "print", "component_id")
