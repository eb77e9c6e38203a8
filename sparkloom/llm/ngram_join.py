"""N-gram Jaccard join (operator 5): documents linked by the Jaccard similarity of their word shingles.

Documents with equal shingle sets form one class first. The shingles of a class
are ordered rare first: those that many documents of one part of a batch share are
counted, the most frequent ones (a table of fixed size, see linking.frequent) come last, by
frequency, all others first, by hash. Any two sets of the wanted similarity
share a shingle in their prefixes, so classes are joined on prefix shingles,
with length and positional filters; a suffix filter compares the numbers of
shingles in ranges of the hash; each remaining pair is verified once on its
whole sets. See linking.py for how groups are joined without all pairs.

Cases: a null or empty text has the empty set and links with nothing; rows with
the same doc_id and text count once as a document but each gives a row; a set
that only rows without a doc_id hold links with nothing; an empty table gives
an empty table; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import mix, pieces, shingle_set, slices, words
from .common import apart, keyed, staged, texts
from .linking import HOT, WORDS, among, bits_of, frequent, linked, long_enough, nodes_of, overlap

#: Least number of documents of a part of a batch that share a shingle which is counted.
SHARED = 3
#: Ranges of the hash whose counts the suffix filter compares.
RANGES = 512


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for part in slices(column):
        w = words(part, lower=True)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            yield shingle_set(w.hash[a:b], k)


def class_of(items: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, the first without its sign bit."""
    if len(items) == 0:
        return 0, 0
    one, two = mix(items ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64), mix(items + np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    return int(mix(np.array([one + np.uint64(len(items))]))[0] >> np.uint64(1)), int(two >> np.uint64(1))


def profile(docs: DataFrame, k: int) -> DataFrame:
    """Rows of kind 0: a document with its id, key (hash of the text), set size, class (node), bits (signature) and sketch (counts by range); of kind 1: a shingle (node) that n documents of a batch share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "key", "n", "node", "bits", "sketch"]
        for b in pieces(batches, "text", 4 << 20):
            sets = list(shingle_sets(b["text"], k))
            node = [class_of(s)[0] for s in sets]
            bits = [bits_of(np.zeros(len(s), np.int64), s, 1)[0] for s in sets]
            sketch = [np.minimum(np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8).tobytes() for s in sets]
            yield pa.record_batch([pa.array(np.zeros(len(sets), np.int32)), b["doc_id"], b["key"], pa.array(list(map(len, sets)), pa.int64()), pa.array(node, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names)
            if sets:
                shingle, count = np.unique(np.concatenate(sets), return_counts=True)
                shingle, count = shingle[count >= SHARED].view(np.int64), count[count >= SHARED]
                none = pa.nulls(len(shingle))
                yield pa.record_batch([pa.array(np.ones(len(shingle), np.int32)), none.cast(pa.int64()), none.cast(pa.int64()), pa.array(count.astype(np.int64)), pa.array(shingle), none.cast(pa.list_(pa.int64())), none.cast(pa.binary())], names)

    return keyed(docs).mapInArrow(run, "kind int, doc_id long, key long, n long, node long, bits array<long>, sketch binary")


def prefixes(docs: DataFrame, k: int, num: int, den: int, heavy) -> DataFrame:
    """(token, node, n, pos, hot): each class's rare-first prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = heavy.value
        for b in pieces(batches, "text", 4 << 20):
            token, node, n, pos, hot, seen = [], [], [], [], [], set()
            for s in shingle_sets(b["text"], k):
                c = class_of(s)[0]
                if len(s) == 0 or c in seen:
                    continue
                seen.add(c)
                most = len(s) - -(-num * len(s) // den) + 1
                rank = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    rank = np.where(known[at] == s, often[at], 0)
                    order = np.argsort(rank, kind="stable")
                    s, rank = s[order], rank[order]
                token.append(s[:most])
                hot.append(rank[:most] >= HOT)
                node.append(np.full(most, c))
                n.append(np.full(most, len(s)))
                pos.append(np.arange(most, dtype=np.int32))
            if token:
                yield pa.record_batch([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(node)), pa.array(np.concatenate(n).astype(np.int32)), pa.array(np.concatenate(pos)), pa.array(np.concatenate(hot))], ["token", "node", "n", "pos", "hot"])

    return texts(docs).select("text").mapInArrow(run, "token long, node long, n int, pos int, hot boolean")


def joined(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, keyed_rows: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; linked when den * |A & B| >= num * |A | B|. With keyed_rows also key (hash of the text) and component (hash of a set in it)."""
    sc = docs.sparkSession.sparkContext
    rows = staged(profile(docs, k), "profile")
    own = rows.filter("kind = 0").select("doc_id", "key", "n", "node", "bits", "sketch")
    often = frequent(rows.filter("kind = 1").select(F.col("node").alias("token"), "n"))
    known = np.array(sorted((r["token"] for r in often)), np.int64).view(np.uint64)
    by = {r["token"]: r["n"] for r in often}
    order = np.argsort(known)
    known = known[order]
    heavy = sc.broadcast((known, np.array([by[x] for x in known.view(np.int64).tolist()], np.int64)))
    tokens = staged(prefixes(docs, k, num, den, heavy), "prefixes")
    classes = staged(own.filter("n > 0").groupBy("node").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))).alias("at"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("sketch").alias("sketch")).select("node", "at.*", "n", "bits", "sketch"), "classes")

    def fetch(nodes: DataFrame) -> DataFrame:
        wanted = staged(classes.join(nodes, "node").select("node", F.col("doc_id").alias("own"), F.col("key").alias("own_key")), "wanted")
        found = among(keyed(docs), "key", wanted.withColumnRenamed("own_key", "key"))
        return found.join(wanted, (F.col("key") == F.col("own_key")) & (F.col("doc_id") == F.col("own"))).select("node", "text").dropDuplicates(["node"])

    def fits(x: Column, y: Column) -> Column:
        return long_enough(x["n"], y["n"], num, den) & (overlap(x, y, x["n"], y["n"]) * (num + den) >= num * (x["n"] + y["n"]))

    def prune(pairs: DataFrame) -> DataFrame:
        """Suffix filter: the overlap is at most the sum over hash ranges of the smaller number of shingles."""
        nodes = nodes_of(pairs)
        sketch = among(classes.select("node", "n", "sketch"), "node", nodes)
        x = sketch.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("ax"))
        y = sketch.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("bx"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows == 0:
                    continue
                p, q = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(b.num_rows, RANGES) for c in ("ax", "bx"))
                n, m = (b[c].to_numpy() for c in ("an", "bn"))
                most = np.minimum(p, q).sum(axis=1, dtype=np.int64)
                most = np.where(((p == 255) & (q == 255)).any(axis=1), np.minimum(n, m), most)  # counts stop at 255
                yield b.select(["a", "b"]).filter(pa.array(most * (num + den) >= num * (n + m)))

        return pairs.join(x, "a").join(y, "b").select("a", "b", "an", "bn", "ax", "bx").mapInArrow(run, "a long, b long")

    trait = F.struct("n", *[F.get("bits", F.lit(i)).alias(f"s{i}") for i in range(WORDS)])
    traits = classes.select("node", trait.alias("trait"))
    part = linked(tokens, fetch, lambda column: shingle_sets(column, k), num, den, traits, fits, prune)
    named = classes.select("node", F.col("doc_id").alias("least")).join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.select("node", "component").join(least, "component").select("node", "component", "component_id")
    out = own.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "key", "component")
    return out if keyed_rows else out.drop("key", "component")


def representatives(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row of each component, of the least doc_id, with docs' columns. Rows that share a doc_id and differ in text count apart; those without a doc_id stay."""
    rows, own, key = apart(docs.columns, "join_key", "join_own", "join_id")
    found = joined(docs, k, num, den, keyed_rows=True).filter(F.col("doc_id") == F.col("component_id"))
    # rows of one doc_id in one component are copies of each other: the text with the least hash stays for them
    keep = found.groupBy("component", "doc_id").agg(F.min("key").alias(own)).select(F.col("doc_id").alias(key), own).distinct()
    d = docs.filter(F.col("doc_id").isNotNull()).withColumn(rows, F.xxhash64(F.col("text").cast("string")))
    kept = d.join(keep, (F.col("doc_id").cast("long") == F.col(key)) & (F.col(rows) == F.col(own)), "left_semi").dropDuplicates(["doc_id", rows])
    return kept.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
