"""Ranked lexical search (operator 13): hierarchical max trees and best-first branch and bound.

Documents are read once and cut into segments of bounded size, each a row with
the postings of the items' terms. With the counts over all documents, a task
builds for each segment a tree over its document ranges: for each term, the
greatest contribution within a range of FAN documents, of FAN such ranges, and
so on up to the segment. For each item the range with the highest sum of its
terms' maxima is opened first: into its parts, or, at the bottom, by scoring
its documents. The search ends when no range left has a sum as great as the
score of the k-th best document so far, which a task keeps from one segment
to the next; ranges of an equal sum are opened, since they can hold a document
of the same score and a lower id. The k best of each task meet in two steps, by
hash bucket of the document and then by item.

The items' terms are broadcast in blocks of TERMS pairs of item and term about
(the pairs are dealt by a hash of the item; one item's own terms stay
together). Terms are told apart by a 64-bit hash.

Cases: a null or empty text, of a document or an item, has no terms; a
document without terms isn't counted; each row of documents is a document of
its own, so repeated rows are counted and listed; rows of items that share an
item_id are one item with the terms of all of them; of equal scores the lower
doc_id comes first, and none last; items without a hit have no rows; an empty
table of either kind gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import pieces, slices, tokens
from .common import BATCH_BYTES, Stages, staged, texts

#: Parts of a range, bytes of text in a segment, and pairs of item and term that are broadcast at once.
FAN, SEGMENT, TERMS = 16, 4 << 20, 1 << 17
#: Hash buckets of documents in which the best of all tasks meet first.
BUCKETS = 64
#: Bytes of terms: digits, letters and all that isn't ASCII.
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True
_LAST = np.iinfo(np.int64).max


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term): the distinct hashes of each item's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b["text"]):
                t = tokens(part, TERM, lower=True)
                of = np.repeat(np.arange(part.rows), np.diff(t.first)) + part.first
                yield pa.record_batch([b["item"].take(pa.array(of)), pa.array(t.hash.view(np.int64))], ["item", "term"])

    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "item long, term long").distinct()


@dataclass
class Postings:
    """Documents of a segment: ids, whether there is one, terms with repeats; postings (term, document, times) by term and document."""

    ids: np.ndarray
    known: np.ndarray
    size: np.ndarray
    term: np.ndarray
    doc: np.ndarray
    times: np.ndarray


_SEGMENT = "kind int, ids binary, known binary, size binary, term binary, doc binary, times binary, number long, count long"
_NAMES = [c.split()[0] for c in _SEGMENT.split(", ")]
#: Numbers of counts besides those of terms: documents with a term, their terms.
_DOCS, _WORDS = -1, -2


def _segments(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Rows of kind 0: segments; of kind 1: (number, count) of documents that hold a term, for each task."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held, n_docs, n_words = np.zeros(len(known), np.int64), 0, 0
        for b in pieces(batches, "text", SEGMENT):
            if b.num_rows == 0:
                continue
            size, keys, times = [], [], []
            for part in slices(b["text"]):
                t = tokens(part, TERM, lower=True)
                n = np.diff(t.first)
                size.append(n)
                at = np.minimum(np.searchsorted(known, t.hash), len(known) - 1)
                hit = known[at] == t.hash
                doc = np.repeat(np.arange(part.rows) + part.first, n)[hit]
                key, count = np.unique(at[hit] * np.int64(b.num_rows) + doc, return_counts=True)
                keys.append(key)
                times.append(count)
            size, key, count = np.concatenate(size), np.concatenate(keys), np.concatenate(times)
            order = np.argsort(key, kind="stable")
            term, doc = np.divmod(key[order], b.num_rows)
            held += np.bincount(term, minlength=len(known))
            n_docs, n_words = n_docs + int((size > 0).sum()), n_words + int(size.sum())
            ids = b["doc_id"]
            columns = [ids.fill_null(0).to_numpy().astype("<i8"), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), size.astype("<i8"), term.astype("<i4"), doc.astype("<i4"), count[order].astype("<i8")]
            yield pa.record_batch([pa.array([0], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in columns], pa.array([None], pa.int64()), pa.array([None], pa.int64())], _NAMES)
        counts = [(int(i), int(held[i])) for i in np.flatnonzero(held)] + [(_DOCS, n_docs), (_WORDS, n_words)]
        none = pa.nulls(len(counts)).cast(pa.binary())
        yield pa.record_batch([pa.array(np.ones(len(counts), np.int32)), *[none] * 6, pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())], _NAMES)

    return texts(docs).mapInArrow(run, _SEGMENT)


def weight(n_docs: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held + 1)))


def contributions(p: Postings, weights: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """What each posting adds to the score of its document for an item with its term."""
    most = int(p.size.max(initial=0))
    if 90 * most * n_docs < 1 << 63:
        m = 10 + 90 * p.size * n_docs // max(1, n_words)
    else:
        m = np.array([10 + 90 * n * n_docs // n_words for n in p.size.tolist()], np.int64)
    return weights[p.term] * (1_000_000_000 * p.times // (1000 * p.times + 8 * m[p.doc]))


class Tree:
    """Maxima of the contributions of each term by document range; level 0 has ranges of FAN documents, the last level one range."""

    def __init__(self, p: Postings, adds: np.ndarray, n_terms: int):
        self.p, self.adds, self.docs = p, adds, len(p.ids)
        ranges = -(-self.docs // FAN)
        at = p.term * np.int64(ranges) + p.doc // FAN  # sorted, as postings are
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        low = np.zeros(n_terms * ranges, np.int64)
        if len(at):
            low[at[starts]] = np.maximum.reduceat(adds, starts)
        self.begin = np.searchsorted(at, np.arange(n_terms * ranges + 1))  # postings of a term in a range
        self.ranges = ranges
        self.levels = [low.reshape(n_terms, ranges)]
        while (n := self.levels[-1].shape[1]) > 1:
            self.levels.append(np.maximum.reduceat(self.levels[-1], np.arange(0, n, FAN), axis=1))

    def bounds(self, terms: np.ndarray, level: int, lo: int, hi: int) -> np.ndarray:
        return self.levels[level][terms, lo:hi].sum(axis=0)

    def scores(self, terms: np.ndarray, at: int) -> np.ndarray:
        """Scores of the documents of range `at` of level 0."""
        begin, end = self.begin[terms * self.ranges + at], self.begin[terms * self.ranges + at + 1]
        n = end - begin
        own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        out = np.zeros(min(FAN, self.docs - at * FAN), np.int64)
        np.add.at(out, self.p.doc[own] - at * FAN, self.adds[own])
        return out

    def search(self, terms: np.ndarray, best: list[tuple[int, int, int]], k: int) -> int:
        """Add this segment's documents to best, a heap of (score, -id, whether known) of the k best so far; the number of ranges opened."""
        top = len(self.levels) - 1
        heap, opened = [(-int(self.bounds(terms, top, 0, 1)[0]), top, 0)], 0
        while heap:
            bound, level, at = heapq.heappop(heap)
            least = best[0][0] if len(best) == k else 1
            if -bound < least:
                break
            opened += 1
            if level:
                lo, hi = at * FAN, min((at + 1) * FAN, self.levels[level - 1].shape[1])
                found = self.bounds(terms, level - 1, lo, hi)
                for i in np.flatnonzero(found >= least).tolist():
                    heapq.heappush(heap, (-int(found[i]), level - 1, lo + i))
                continue
            found = self.scores(terms, at)
            for i in np.flatnonzero(found >= least).tolist():
                d = at * FAN + i
                row = (int(found[i]), bool(self.p.known[d]), -int(self.p.ids[d]))
                if len(best) < k:
                    heapq.heappush(best, row)
                elif row > best[0]:
                    heapq.heapreplace(best, row)
        return opened


def _best(segments: DataFrame, model: tuple, k: int) -> DataFrame:
    """The k best documents of each item in each task, and rows without a score that count ranges."""
    shared = segments.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_words = shared.value
        best: dict[int, list] = {i: [] for i in range(len(items))}
        opened = total = 0
        kinds = [("ids", "<i8"), ("known", "u1"), ("size", "<i8"), ("term", "<i4"), ("doc", "<i4"), ("times", "<i8")]
        for b in batches:
            for row in range(b.num_rows):
                p = Postings(*[np.frombuffer(b[name][row].as_py(), kind).astype(np.int64) for name, kind in kinds])
                tree = Tree(p, contributions(p, weights, n_docs, n_words), len(weights))
                for i, (_, terms) in enumerate(items):
                    opened += tree.search(terms, best[i], k)
                    total += tree.ranges
        rows = [(items[i][0], -d if known else None, score) for i, found in best.items() for score, known, d in found]
        rows.append((None, opened, -1))
        rows.append((None, total, -2))
        yield pa.record_batch([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["item", "doc_id", "score"])

    return segments.mapInArrow(run, "item long, doc_id long, score long")


def searched(docs: DataFrame, items: DataFrame, k: int = 10, counts: dict | None = None) -> DataFrame:
    """item_id, rank, doc_id, score of the k documents of highest score above 0 for each item. counts, if given, gets the ranges opened and the ranges there are (of level 0, times items)."""
    spark = docs.sparkSession
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    stage = Stages(spark)
    wanted = stage(item_terms(items), "terms")
    blocks = max(1, -(-wanted.count() // TERMS))
    found = None
    for block in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()  # TERMS about
        vocabulary = np.array(sorted({r["term"] for r in rows}), np.int64).view(np.uint64)
        vocabulary.sort()
        if len(vocabulary) == 0:
            continue
        of: dict[int | None, list[int]] = {}
        for r in rows:
            of.setdefault(r["item"], []).append(r["term"])
        segments = stage(_segments(docs, vocabulary), "segments")
        counted = {r["number"]: r["count"] for r in segments.filter("kind = 1").groupBy("number").agg(F.sum("count").alias("count")).collect()}
        n_docs, n_words = counted.get(_DOCS, 0), counted.get(_WORDS, 0)
        weights = np.array([weight(n_docs, counted.get(i, 0)) for i in range(len(vocabulary))], np.int64)
        terms = [(i, np.searchsorted(vocabulary, np.sort(np.array(t, np.int64).view(np.uint64)))) for i, t in of.items()]
        near = stage(_best(segments.filter("kind = 0").drop("kind", "number", "count"), (terms, weights, n_docs, n_words), k), "near")
        if counts is not None:
            for name, mark in (("opened", -1), ("ranges", -2)):
                counts[name] = counts.get(name, 0) + (near.filter(F.col("score") == mark).agg(F.sum("doc_id")).first()[0] or 0)
        near = near.filter("score > 0")
        found = near if found is None else found.unionByName(near)
    if found is None:
        stage.drop()
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    bucket = F.pmod(F.xxhash64("doc_id", "score"), F.lit(BUCKETS))
    some = found.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(Window.partitionBy("item", "bucket").orderBy(*by))).filter(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).filter(F.col("rank") <= k)
    out = staged(ranked.select(F.col("item").alias("item_id"), "rank", "doc_id", "score"), "ranked")
    stage.drop()
    return out
