"""Substring dedup (operator 6): repeated passages across and inside documents.

Paragraphs are of two kinds. A line is a non-empty line of MIN_WORDS words or
more; lines with equal shingles form
a class; each class has a MinHash signature whose bands (tuned by
`tuned` to reach RECALL at the wanted similarity with the fewest rows) are the
tokens on which classes meet. Colliding classes are verified by exact Jaccard
similarity (see linking.py), and components of the links cluster the lines.

A block is a run of so many words, whatever the newlines, so that passages
inside longer lines or over many short ones are found: each begins where a
shingle's hash is the least of `block` neighbouring ones, so where a block
begins depends on its words and few behind them, blocks overlap, and any two
equal passages of 2 * block - 1 words or more hold an equal block. A block is
too short to differ in a word at a similarity of 0.8 (one word changes five of
its 22 shingles), so a class of blocks, those with equal shingles, is a cluster
as it is and needs no bands.

Of each cluster the first paragraph, by doc_id and place, stays, and
so do blocks that overlap it; a cluster of nothing else is not repeated.
`spans` joins what overlaps or touches in a document to maximal spans.

Cases: a null or empty text has no paragraphs; shorter lines are never removed
unless blocks cover parts of them;
rows that repeat a doc_id and text count as one document, rows with the same
doc_id and other texts as documents of their own; rows without a doc_id
come first in a cluster; an empty table gives an empty table; `repeated` and `spans` read
doc_id and text only, `deduplicated` keeps the columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import code_points, grams, lines, mix, pieces, slices, words
from .common import apart, keyed, staged
from .linking import HOT, WORDS, Fetch, among, bits_of, frequent, linked, long_enough, overlap
from .ngram_join import SHARED, shingle_sets

MIN_WORDS = 25
#: Words of a block: passages of over 50 words hold one.
BLOCK = 26
RECALL = 0.995
_KIND = np.uint64(0x5851F42D4C957F2D)
#: Kinds of rows of `paragraphs`, and how many paragraphs are hashed at once.
LINE, RUN, COUNT = 0, 1, 2
_AT_ONCE = 1 << 18


def tuned(similarity: float, recall: float = RECALL, most: int = 64) -> tuple[int, int]:
    """(bands, rows): at most three rows a band, so that far pairs seldom meet, and as few bands as reach the recall at this similarity."""
    rows = 3
    bands = next(b for b in range(1, most + 1) if 1 - (1 - similarity**rows) ** b >= recall)
    return bands, rows


def band_tokens(g: np.ndarray, start: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """63-bit tokens, one for each paragraph and band, of the MinHash signatures; g: shingle hashes, paragraph i begins at start[i] and ends where the next begins."""
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    token = np.empty((len(start), bands), np.uint64)
    for b in range(bands):
        own = np.full(len(start), b, np.uint64)
        for r in range(rows):
            i = 2 * (b * rows + r)
            x = (g ^ seeds[i]) * (seeds[i + 1] | np.uint64(1))
            own = mix(own ^ np.minimum.reduceat(x ^ (x >> np.uint64(32)), start))
        token[:, b] = own
    return (token >> np.uint64(1)).view(np.int64)


def block_starts(x: np.ndarray, first: np.ndarray, block: int) -> np.ndarray:
    """The words at which blocks begin; x: hash of the block at each word, text i has the words first[i] .. first[i + 1].

    Of each window of `block` places in a text one with the least hash is picked,
    the last such one; of picks with equal blocks those that stand close together
    are thinned so far that no window loses all of its own, for texts that say the same over and over.
    """
    at = np.arange(max(0, len(x) - block + 1))
    at = at[at + 2 * block - 1 <= first[np.searchsorted(first, at, "right")]] if len(at) else at  # windows inside one text
    if len(at) == 0:
        return at
    windows = np.lib.stride_tricks.sliding_window_view(x, block)[:, ::-1]
    start = np.unique(np.concatenate([p + block - 1 - np.argmin(windows[p], axis=1) for p in np.split(at, range(1 << 14, len(at), 1 << 14))]))
    same = np.r_[False, (x[start[1:]] == x[start[:-1]]) & (np.diff(start) <= block)]
    opens = np.flatnonzero(~same)
    stretch = (start - np.repeat(start[opens], np.diff(np.r_[opens, len(start)]))) // (block // 2)
    return start[~same | np.r_[True, stretch[1:] != stretch[:-1]] | np.r_[~same[1:], True]]


def paragraphs(docs: DataFrame, k: int, min_words: int, bands: int, rows: int, block: int | None = None) -> DataFrame:
    """Rows of kind LINE or RUN (a block): doc_id, key (hash of the text), start and end (code points), n_words, node (hash of the shingles) and, for lines, n (distinct shingles), tokens (one a band) and bits (signature); of kind COUNT: a token (node) that n lines of a slice share."""
    if block is not None and block < k:
        raise ValueError(f"a block needs {k} words")
    names = ["kind", "doc_id", "key", "start", "end", "n_words", "node", "n", "tokens", "bits"]

    def listed(x: np.ndarray) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            for part in slices(batch["text"]):
                w, ln = words(part, lower=True), lines(part)
                whole = grams(w.hash, k)
                points = np.r_[0, np.cumsum(code_points(part.data))]

                def places(kind: int, row: np.ndarray, from_: np.ndarray, to: np.ndarray, n_words: np.ndarray, node: np.ndarray) -> list[pa.Array]:
                    base, at = points[part.bounds[row]], pa.array(row + part.first)
                    return [pa.array(np.full(len(row), kind, np.int32)), batch["doc_id"].take(at), batch["key"].take(at), pa.array(points[from_] - base), pa.array(points[to] - base), pa.array(n_words), pa.array(node)]

                def hashed(total: np.ndarray, kind: int) -> np.ndarray:
                    return (mix(total + np.uint64(kind) * _KIND) >> np.uint64(1)).view(np.int64)

                first_word, last_word = np.searchsorted(w.start, ln.start), np.searchsorted(w.start, ln.end)
                long = np.flatnonzero(last_word - first_word >= max(min_words, k))
                for keep in np.split(long, range(_AT_ONCE, len(long), _AT_ONCE)):
                    if len(keep) == 0:
                        continue
                    a, b = first_word[keep], last_word[keep]
                    n = b - a - k + 1  # shingles of each line
                    start = np.r_[0, np.cumsum(n)[:-1]]
                    of = np.repeat(np.arange(len(n)), n)
                    g = whole[np.repeat(a - start, n) + np.arange(int(n.sum()))]
                    key = np.sort((of.astype(np.uint64) << np.uint64(43)) | (g >> np.uint64(21)))
                    first = np.r_[True, key[1:] != key[:-1]]
                    size = np.bincount((key[first] >> np.uint64(43)).astype(np.int64), minlength=len(n))
                    node = hashed(np.add.reduceat(mix(g), start) + n.astype(np.uint64), LINE)
                    token = band_tokens(g, start, bands, rows)
                    row = np.searchsorted(ln.first, keep, "right") - 1
                    yield pa.record_batch([*places(LINE, row, ln.start[keep], ln.end[keep], b - a, node), pa.array(size), listed(token), listed(bits_of(of, g, len(n)))], names)
                    shared, count = np.unique(token, return_counts=True)
                    shared, count = shared[count >= SHARED], count[count >= SHARED]
                    none, lists = pa.nulls(len(shared), pa.int64()), pa.nulls(len(shared), pa.list_(pa.int64()))
                    yield pa.record_batch([pa.array(np.full(len(shared), COUNT, np.int32)), none, none, none, none, none, pa.array(shared), pa.array(count), lists, lists], names)
                if block is not None:
                    total = np.r_[np.uint64(0), np.cumsum(mix(whole), dtype=np.uint64)]
                    blocks = hashed(total[block - k + 1 :] - total[: max(0, len(total) - block + k - 1)] + np.uint64(block), RUN)
                    s = block_starts(blocks, w.first, block)
                    node = blocks[s]
                    none, lists = pa.nulls(len(s), pa.int64()), pa.nulls(len(s), pa.list_(pa.int64()))
                    yield pa.record_batch([*places(RUN, np.searchsorted(w.first, s, "right") - 1, w.start[s], w.end[s + block - 1], np.full(len(s), block), node), none, lists, lists], names)

    return keyed(docs).mapInArrow(run, "kind int, doc_id long, key long, start long, end long, n_words long, node long, n long, tokens array<long>, bits array<long>")


def repeated(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, min_words: int = MIN_WORDS, block: int | None = BLOCK) -> DataFrame:
    """Each occurrence of a repeated line or block: doc_id, key (hash of the text), start, end (code points), n_words, passage_id, first_doc_id, n_copies, removed."""
    bands, rows = tuned(num / den)
    every = staged(paragraphs(docs, k, min_words, bands, rows, block), "paragraphs")
    place = ("doc_id", "key", "start", "end")
    whole = every.filter(F.col("kind") == LINE)
    trait = F.struct("n", "tokens", *[F.get("bits", F.lit(i)).alias(f"s{i}") for i in range(WORDS)])

    def fits(x: Column, y: Column) -> Column:
        return long_enough(x["n"], y["n"], num, den) & (overlap(x, y, x["n"], y["n"]) * (num + den) >= num * (x["n"] + y["n"]))

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        return shingle_sets(column, k)

    part = linked(_tokens(every, whole), _texts_of(docs, whole), sets, num, den, whole.select("node", trait.alias("trait")), fits)
    own = whole.select(*place, "n_words", "node").join(part, "node", "left").select(*place, "n_words", F.coalesce("component", "node").alias("component"))
    own = own.unionByName(every.filter(F.col("kind") == RUN).select(*place, "n_words", F.col("node").alias("component")))
    several = own.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    own = among(own, "component", several).distinct()  # rows that repeat a doc_id and text are one
    own = staged(own, "places")
    groups = own.groupBy("component").agg(F.count(F.lit(1)).alias("n_copies"), F.min(F.struct(*place)).alias("lead")).filter("n_copies > 1")
    groups = staged(groups, "groups")  # so that Spark can split a large cluster when it joins them back
    out = own.join(groups, "component")
    # blocks that overlap the first one are no copies of it; lines never overlap
    first = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("key") == F.col("lead.key")) & (F.col("start") < F.col("lead.end"))
    out = staged(out.withColumn("first", first), "places")
    over = staged(out.filter("first").groupBy("component").agg(F.count(F.lit(1)).alias("over")), "over")
    out = out.join(over, "component").withColumn("n_copies", F.col("n_copies") - F.col("over") + 1).filter("n_copies > 1")
    return out.select(*place, "n_words", F.col("component").alias("passage_id"), F.col("lead.doc_id").alias("first_doc_id"), "n_copies", (~F.col("first")).alias("removed"))


def _tokens(every: DataFrame, whole: DataFrame) -> DataFrame:
    """What `linked` reads of the lines: each band's token, marked where many lines share it."""
    shared = whole.select(F.explode("tokens").alias("token"), "node", F.col("n").cast("int").alias("n"), F.lit(0).alias("pos"))
    often = [(r["token"],) for r in frequent(every.filter(F.col("kind") == COUNT).select(F.col("node").alias("token"), "n")) if r["n"] >= HOT]
    if not often:
        return shared.withColumn("hot", F.lit(False))
    hot = every.sparkSession.createDataFrame(often, "token long").withColumn("hot", F.lit(True))  # linking.HEAVY rows at most
    return shared.join(F.broadcast(hot), "token", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


def _texts_of(docs: DataFrame, whole: DataFrame) -> Fetch:
    """Gives the text of each class asked for, from the first place that holds it."""
    def fetch(nodes: DataFrame) -> DataFrame:
        wanted = among(whole.select("node", "doc_id", "key", "start", "end"), "node", nodes).join(nodes, "node", "left_semi")
        wanted = staged(wanted.groupBy("node").agg(F.min(F.struct("doc_id", "key", "start", "end")).alias("at")).select("node", "at.*"), "wanted")
        cut = F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
        own = among(keyed(docs), "key", wanted).withColumnsRenamed({"doc_id": "own_id", "key": "own_key"})
        found = own.join(wanted, (F.col("own_key") == F.col("key")) & F.col("own_id").eqNullSafe(F.col("doc_id")))
        return found.select("node", cut.alias("text")).dropDuplicates(["node"])

    return fetch


def spans(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, min_words: int = MIN_WORDS, block: int | None = BLOCK) -> DataFrame:
    """Maximal spans that repeated lines and blocks cover, those that are removed apart from those that stay: doc_id, key, start, end (code points), n_passages, first_doc_id (least), n_copies (greatest), removed."""
    return joined(repeated(docs, k, num, den, min_words, block))


def joined(found: DataFrame) -> DataFrame:
    """The rows of `repeated` that overlap or touch in a document, as one."""
    by = Window.partitionBy("doc_id", "key", "removed").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("opens", (F.col("start") > F.coalesce(before, F.lit(-1))).cast("int")).withColumn("span", F.sum("opens").over(by))
    rows = rows.groupBy("doc_id", "key", "removed", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_passages"), F.min("first_doc_id").alias("first_doc_id"), F.max("n_copies").alias("n_copies"))
    return rows.select("doc_id", "key", "start", "end", "n_passages", "first_doc_id", "n_copies", "removed")


def deduplicated(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, min_words: int = MIN_WORDS, block: int | None = BLOCK) -> DataFrame:
    """docs without the spans that `repeated` removes; the line ends around lines stay."""
    gone = joined(repeated(docs, k, num, den, min_words, block).filter("removed"))
    own, own_key, cuts = apart([*docs.columns, "text"], "cut_id", "cut_key", "cuts")
    cut = gone.groupBy(F.col("doc_id").alias(own), F.col("key").alias(own_key)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cuts))
    text = F.col("text").cast("string")
    d = docs.join(cut, docs["doc_id"].cast("long").eqNullSafe(cut[own]) & (F.xxhash64(docs["text"].cast("string")) == cut[own_key]), "left")
    n = F.size(cuts)

    def kept(i: Column) -> Column:
        """What stands between the cuts i - 1 and i."""
        from_ = F.when(i > 0, F.get(F.col(cuts), i - 1)["end"]).otherwise(0)
        return F.substring(text, (from_ + 1).cast("int"), (F.coalesce(F.get(F.col(cuts), i)["start"], F.lit(2**31 - 1)) - from_).cast("int"))

    return d.withColumn("text", F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n), kept), "")).otherwise(text)).select(*docs.columns)
