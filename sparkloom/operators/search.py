"""Exact vector search: one query, many queries, group similarity, pairs within a distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from .components import Staged, ranked, staged
from .filters import compile_filter

#: Most pivots, rows of a block, and queries that are scored at once.
PIVOTS, BLOCK, SCORED = 1024, 2_000, 500
#: Bands of the grid of all pairs, most rows of one, cells of a matrix, and rows that tell whether blocks can be told apart.
GRID, BAND, CELLS, SAMPLE = 16, 50_000, 2_000_000, 500


def top_k(points: DataFrame, query: list[float], k: int = 5, metric: str = "cosine", where: dict | None = None, id_col: str = "id", vector_col: str = "vector", prefix: str = "") -> DataFrame:
    """The k nearest points that pass the filter, with their score: filter, project, TakeOrderedAndProject. Ties go to the lower id."""
    measure, higher = vectors.METRICS[metric]
    score = measure(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query]))
    found = points.filter(compile_filter(where, prefix)).withColumn("score", score)
    return found.orderBy(F.desc("score") if higher else F.asc("score"), id_col).limit(k)


class Cells:
    """Unit vectors dealt to blocks of bounded size by where they lie.

    Some points are pivots. Every point belongs to the cell of its nearest pivot,
    and the order of cells, and of distances to the pivot inside, is cut into
    blocks of `block` rows, so a crowded cell is many rings and a thin one a
    part of a block. What lies within r of a point x is only in cells whose pivot
    is at most 2 r farther from x than x's own, and there only in rings that
    the triangle inequality allows. Distances are Euclidean ones of unit vectors:
    the square is twice the cosine distance.

    rows: id, v, label, cell, away, block; segments: (label, cell, block, lo, hi), the rings; pivots, and the radius of each cell.
    """

    def __init__(self, points: DataFrame, id_col: str, vector_col: str, block: int, within: str | None = None):
        self.stage, self.n = Staged(points.sparkSession), 0
        label = F.lit(0).cast("long") if within is None else F.xxhash64(within)
        kind = points.schema[vector_col].dataType.simpleString()
        kind = kind if kind in ("array<float>", "array<double>") else "array<double>"  # floats stay, being half as long; they are compared as doubles
        given = points.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"), label.alias("label")).filter("v IS NOT NULL")
        given = self.stage(given, "vectors")
        self.n = given.count()
        if not self.n:
            return
        some = min(PIVOTS, 4 * -(-self.n // block))
        chosen = given.orderBy(F.xxhash64("id"), "id").limit(some).select("v").collect()  # PIVOTS at most
        self.pivots = _unit(np.array([r["v"] for r in chosen], np.float64).reshape(len(chosen), -1))
        shared = points.sparkSession.sparkContext.broadcast(self.pivots)

        def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    d = _apart(_unit(np.stack(b.v.to_numpy())), shared.value)
                    cell = d.argmin(axis=1)
                    yield b.assign(cell=cell, away=d[np.arange(len(b)), cell])

        own = given.mapInPandas(home, f"id long, v {kind}, label long, cell int, away double")
        self.rows = self.stage(ranked(own, "label", "cell", "away", "id").withColumn("block", F.floor(F.col("place") / block)).drop("place"), "cells")
        self.segments = self.stage(self.rows.groupBy("label", "cell", "block").agg(F.min("away").alias("lo"), F.max("away").alias("hi")), "rings")
        found = {r["cell"]: r["r"] for r in self.segments.groupBy("cell").agg(F.max("hi").alias("r")).collect()}  # PIVOTS at most
        self.radius = np.array([found.get(i, -np.inf) for i in range(len(chosen))])

    def visits(self, rows: DataFrame) -> DataFrame:
        """rows (id, v, label, r and more, without v) with `other`: each block that can hold a point within r of v, r below 0 for none but where v lies."""
        shared = rows.sparkSession.sparkContext.broadcast((self.pivots, self.radius))
        names = [c for c in rows.columns if c != "v"]
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("v").schema)

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pivots, radius = shared.value
            for whole in batches:
                for first in range(0, len(whole), 1000):
                    b = whole.iloc[first : first + 1000]
                    d = _apart(_unit(np.stack(b.v.to_numpy())), pivots)
                    r = b.r.to_numpy()[:, None] * (1 + 1e-9) + 1e-9
                    near = np.where(np.isfinite(radius), d, np.inf).argmin(axis=1)
                    hit = (d - d.min(axis=1, keepdims=True) <= 2 * r) & (d <= radius + r)
                    only = b.r.to_numpy() < 0
                    hit[only] = False
                    hit[only, near[only]] = True
                    at, cell = np.nonzero(hit)
                    low, high = d[at, cell] - r[at, 0], d[at, cell] + r[at, 0]
                    low[only[at]], high[only[at]] = -np.inf, np.inf
                    yield b[names].iloc[at].assign(at_cell=cell, at_lo=low, at_hi=high)

        found = rows.mapInPandas(look, kinds + ", at_cell int, at_lo double, at_hi double")
        rings = self.segments.select(F.col("label").alias("l"), "cell", F.col("block").alias("other"), "lo", "hi")
        met = found.join(rings, (F.col("label") == F.col("l")) & (F.col("at_cell") == F.col("cell")) & (F.col("hi") >= F.col("at_lo")) & (F.col("lo") <= F.col("at_hi")))
        return met.select(*names, "other").distinct()

    def crowded(self, r: float) -> bool:
        """Whether points meet, within r, over GRID blocks each and over half of those with their label, as some of them (SAMPLE at most, by their hash) tell."""
        some = self.rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "v", "label")
        held = self.segments.select("label", "block").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        most = some.join(held, "label").agg(F.sum("n")).first()[0]
        return self.visits(some.withColumn("r", F.lit(r))).count() > max(GRID * min(SAMPLE, self.n), most / 2)


def _all_pairs(c: Cells, own: DataFrame, eps: float) -> DataFrame:
    """(a, b, distance), a < b, of all rows (id, v, label, block) of one label within eps, every two compared.

    Consecutive blocks form GRID bands, more where a band would get over BAND rows. Two bands meet in one
    square of the grid, so a row is sent to as many squares as there are bands, which up to GRID * BAND rows
    does not depend on the number of rows; in a square CELLS of the matrix are made at a time. Blocks are in order of labels: bands without a common label don't meet.
    """
    blocks = own.agg(F.max("block")).first()[0] + 1
    span = max(1, min(-(-blocks // GRID), BAND * blocks // c.n))
    band = own.withColumn("band", F.floor(F.col("block") / span)).drop("block")
    ends = band.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    lo, hi = (ends.select(F.col("band").alias(n), F.col("low").alias(f"{n}_low"), F.col("high").alias(f"{n}_high")) for n in ("lo", "hi"))
    squares = lo.join(hi, F.col("lo") <= F.col("hi")).filter("lo_low <= hi_high AND hi_low <= lo_high").select("lo", "hi")
    squares = c.stage(squares.unionByName(squares.filter("lo < hi").select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))), "squares")
    sent = band.join(F.broadcast(squares.withColumnRenamed("lo", "band")), "band")  # a row goes to each square of its band's row and column
    sent = sent.select("id", "v", "label", F.least("band", "hi").alias("lo"), F.greatest("band", "hi").alias("hi"), (F.col("band") <= F.col("hi")).alias("first"))

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        same = key[0] == key[1]
        left, right = (pdf, pdf) if same else (pdf[pdf["first"]], pdf[~pdf["first"]])
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(left) and len(right):
            unit, ids, labels, found = _unit(np.stack(right.v.to_numpy())).T, right.id.to_numpy(), right.label.to_numpy(), []
            step = max(1, CELLS // len(right))
            for first in range(0, len(left), step):
                part = left.iloc[first : first + step]
                d = 1 - _unit(np.stack(part.v.to_numpy())) @ unit
                i, j = np.nonzero(d <= eps)
                a, b = part.id.to_numpy()[i], ids[j]
                keep = (a < b if same else a != b) & (part.label.to_numpy()[i] == labels[j])
                found.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], d[i[keep], j[keep]]))
            out = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pd.DataFrame(dict(zip(("a", "b", "distance"), out, strict=True)))

    return sent.groupBy("lo", "hi").applyInPandas(compare, "a long, b long, distance double")


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x to those of y."""
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)))


def top_k_many(points: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id", vector_col: str = "vector", block: int = BLOCK, counts: dict | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k points of highest cosine for each query, itself included.

    Each query first looks at one block near to it, whose k-th best score bounds
    how far the others can be, then at all blocks that can hold a point so
    near. A block meets up to `block` queries in one matrix product.
    counts, if given, gets the visits of queries to blocks.
    """
    c = Cells(points, id_col, vector_col, block)
    if not c.n:
        return points.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    q = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.lit(0).cast("long").alias("label")).filter("v IS NOT NULL")
    q = c.stage(q.dropDuplicates(["id"]), "queries")
    deal = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-q.count() // block))))

    def scored(visits: DataFrame) -> DataFrame:
        """The k best points of each visit (id of a query, other)."""
        asked = visits.join(q.select("id", "v"), "id").select(F.col("id").alias("query_id"), "v", F.col("other").alias("block")).withColumn("deal", deal)
        need = asked.select("block", "deal").distinct()
        held = c.rows.select("id", "v", "block").join(need, "block")
        both = asked.select("block", "deal", F.col("query_id").alias("id"), "v", F.lit(True).alias("asks")).unionByName(held.withColumn("asks", F.lit(False)))

        def best(pdf: pd.DataFrame) -> pd.DataFrame:
            ask, own = pdf[pdf.asks], pdf[~pdf.asks].sort_values("id")
            if len(ask) == 0 or len(own) == 0:
                return pd.DataFrame({"query_id": [], "id": [], "score": []})
            key, unit, out = own.id.to_numpy(), _unit(np.stack(own.v.to_numpy())), []
            for first in range(0, len(ask), SCORED):
                part = ask.iloc[first : first + SCORED]
                score = np.round(_unit(np.stack(part.v.to_numpy())) @ unit.T, 9)
                at = np.argsort(-score, axis=1, kind="stable")[:, :k]  # equal scores: the lower ids
                out.append(pd.DataFrame({"query_id": np.repeat(part.id.to_numpy(), at.shape[1]), "id": key[at.ravel()], "score": np.take_along_axis(score, at, axis=1).ravel()}))
            return pd.concat(out)

        return both.groupBy("block", "deal").applyInPandas(best, "query_id long, id long, score double")

    first = c.visits(q.withColumn("r", F.lit(-1.0))).groupBy("id").agg(F.min("other").alias("other"))
    first = c.stage(first, "first")
    near = c.stage(scored(first), "near")
    bound = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - F.min("score"))) + 1e-8)).otherwise(2.0).alias("r"))
    wider = q.join(bound.withColumnRenamed("query_id", "id"), "id", "left").withColumn("r", F.coalesce("r", F.lit(2.0)))
    rest = c.stage(c.visits(wider).select("id", "other").join(first, ["id", "other"], "left_anti"), "rest")
    if counts is not None:
        counts["visits"] = rest.count() + first.count()
        counts["blocks"] = c.rows.agg(F.max("block")).first()[0] + 1
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    out = staged(near.unionByName(scored(rest)).withColumn("rank", rank).filter(F.col("rank") <= k), "ranked")
    c.stage.drop()
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64, copy=False)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > vectors.EPSILON)


def group_similarity(points: DataFrame, group_col: str, vector_col: str = "vector") -> DataFrame:
    """(group_a, group_b, similarity) of each two groups: the mean cosine of all pairs of their members.

    A mean of pairwise cosines is the dot product of the groups' mean unit
    vectors, so one aggregation per coordinate replaces the pairs.
    """
    unit = points.select(F.col(group_col).alias("g"), F.posexplode(F.transform(vector_col, lambda x: x.cast("double") / vectors.norm(F.col(vector_col)))).alias("at", "v"))
    counts = points.groupBy(F.col(group_col).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    mean = unit.groupBy("g", "at").agg(F.sum("v").alias("v")).join(counts, "g").select("g", "at", (F.col("v") / F.col("n")).alias("v"))
    a, b = mean.select(F.col("g").alias("group_a"), "at", F.col("v").alias("va")), mean.select(F.col("g").alias("group_b"), "at", F.col("v").alias("vb"))
    return a.join(b, "at").filter("group_a < group_b").groupBy("group_a", "group_b").agg(F.sum(F.col("va") * F.col("vb")).alias("similarity"))


def pairs_within(points: DataFrame, eps: float, id_col: str = "id", vector_col: str = "vector", block: int = BLOCK, within: str | None = None, counts: dict | None = None) -> DataFrame:
    """(a, b, distance), a < b, of all points (of one value of `within`, if given) whose cosine distance is at most eps.

    Exact: see Cells. Two blocks meet in one group of at most 2 * block rows,
    where a matrix product compares those of the one that can be near to the other
    with all of that. Vectors without a nearer neighbourhood than others (all at a
    right angle, say) can't be told apart by any such bound, and then all blocks
    meet, in squares of a grid (see _all_pairs). counts, if given, gets the number of pairs
    compared by blocks.
    """
    c = Cells(points, id_col, vector_col, block, within)
    if not c.n:
        return points.sparkSession.createDataFrame([], "a long, b long, distance double")
    r = float(np.sqrt(2 * max(eps, 0)))
    own = c.rows.select("id", "v", "label", "block")
    if counts is None and c.crowded(r):
        out = staged(_all_pairs(c, own, eps), "within")
        c.stage.drop()
        return out
    far = c.visits(own.withColumn("r", F.lit(r))).filter("other > block").select("id", "block", "other")
    far = c.stage(far, "visits")
    meet = c.stage(far.groupBy("block", "other").agg(F.count(F.lit(1)).alias("n")), "meet")
    if counts is not None:
        size = c.rows.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
        across = meet.join(size.withColumnRenamed("block", "other"), "other").agg(F.sum(F.col("n") * F.col("size"))).first()[0] or 0
        counts["compared"] = across + size.agg(F.sum(F.col("size") * (F.col("size") - 1) / 2).cast("long")).first()[0]
    key = [F.col("block").alias("lo"), F.col("other").alias("hi")]
    left = own.join(far.select("id", "block", "other"), ["id", "block"]).select("id", "v", "label", *key, F.lit(True).alias("visits"))
    right = own.withColumnRenamed("block", "other").join(meet.select("block", "other"), "other").select("id", "v", "label", *key, F.lit(False).alias("visits"))
    inside = own.select("id", "v", "label", F.col("block").alias("lo"), F.col("block").alias("hi"), F.lit(True).alias("visits"))

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        same = key[0] == key[1]
        left, right = (pdf, pdf) if same else (pdf[pdf.visits], pdf[~pdf.visits])
        d = 1 - _unit(np.stack(left.v.to_numpy())) @ _unit(np.stack(right.v.to_numpy())).T
        i, j = np.nonzero((d <= eps) & (left.label.to_numpy()[:, None] == right.label.to_numpy()))
        a, b = left.id.to_numpy()[i], right.id.to_numpy()[j]
        keep = a < b if same else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "distance": d[i, j][keep]})

    out = left.unionByName(right).unionByName(inside).groupBy("lo", "hi").applyInPandas(compare, "a long, b long, distance double")
    out = staged(out, "within")
    c.stage.drop()
    return out


def shaped(results: DataFrame, payload: list[str], id_col: str = "id") -> DataFrame:
    """Search results as (id, score, payload struct)."""
    return results.select(F.col(id_col).alias("id"), "score", F.struct(*payload).alias("payload"))


def context(results: DataFrame, files: DataFrame, limit: int = 8000, suffix: str = "\n... (truncated)") -> DataFrame:
    """Results with the code lines they point at (rank, file_path, start_line, end_line joined to files) and, per result, a running cut at `limit` characters in rank order."""
    lines = F.split("content", r"\r\n|\n|\r")
    inside = (F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line")) & (F.col("start_line") <= F.size(lines))
    code = F.when(inside, F.array_join(F.slice(lines, F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"))
    rows = results.join(files.select("file_path", "content"), "file_path", "left").withColumn("code", code).drop("content")
    ahead = F.coalesce(F.sum(F.length(F.coalesce("code", F.lit("")))).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("room", F.lit(limit) - ahead).filter("room > 0")
    return rows.withColumn("code", F.when(F.length("code") > F.col("room"), F.concat(F.expr("left(code, cast(room as int))"), F.lit(suffix))).otherwise(F.col("code"))).drop("room")


