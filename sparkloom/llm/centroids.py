"""Centroid clustering (operator 11): exponion search over integer vectors.

Vectors become integers, so that distances and centroids are exact. Each vector
carries its cluster, an upper bound of its distance to that centroid and a
lower bound of its distance to any other. In a round, the bounds move by how
far centroids moved; a vector whose upper bound is below the lower one, or
below half the way from its centroid to the next, keeps its cluster unread.
The others scan only centroids in the ball around their centroid of radius
twice the upper bound plus the way to the next centroid, found in that
centroid's sorted list of distances, whose blocks double in length. The radius
is inclusive and bounds are compared strictly, so ties are seen and go to the
smaller number.

A round is one pass over a table of vectors and bounds, with one row of sums
for each task, cluster and component; the vectors are never shuffled, and the
driver holds the k centroids alone (k * k distances are broadcast).

Cases: vectors that are null, of another length, or hold a null, NaN or
infinite component are left out; components are held within 2^27 either way, so
that a squared distance is a long; sums of distances over the largest long are
given as that; each row counts as a vector, repeated ids too; a null id is
clustered but starts no centroid; with fewer than k vectors that have an id each of them starts
one; without any the result is empty; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Stages, staged

#: Components are held within this, either way.
MOST = 1 << 27
#: Relative slack by which square roots are rounded up or down.
SLACK = 1e-12
_NONE = np.iinfo(np.int64).max


def integers(column: pa.Array, dims: int, scale: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the rows kept, their integer vectors) of a column of lists of doubles."""
    length = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(length == dims)
    flat = column.take(pa.array(rows)).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), dims)
    fine = np.isfinite(flat).all(axis=1)
    with np.errstate(over="ignore"):
        return rows[fine], np.clip(np.floor(scale * flat[fine]), -MOST, MOST).astype(np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to the rows of c, as 64-bit integers."""
    most = max((int(np.abs(m).max()) for m in (x, c) if m.size), default=0)
    if 4 * x.shape[1] * most * most < 1 << 53:  # a product of doubles is exact
        p, q = x.astype(np.float64), c.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ q.T) + (q * q).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j in range(len(c)):
        d = x - c[j]
        out[:, j] = (d * d).sum(axis=1)
    return out


def own_squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of x to the same row of c."""
    d = x - c
    return (d * d).sum(axis=1)


@dataclass
class Geometry:
    """Centroids; of each one the others by distance, these distances (rounded down), and the way to the next one."""

    c: np.ndarray
    order: np.ndarray
    away: np.ndarray
    near: np.ndarray


def geometry(c: np.ndarray) -> Geometry:
    k = len(c)
    d = np.sqrt(squares(c, c).astype(np.float64))
    np.fill_diagonal(d, -1)  # a centroid comes first in its own list, which is cut off
    order = np.argsort(d, axis=1, kind="stable")[:, 1:]
    away = np.take_along_axis(d, order, axis=1) * (1 - SLACK)
    near = away[:, 0] if k > 1 else np.full(k, np.inf)
    return Geometry(c, order, away, near)


def assign(x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, g: Geometry) -> int:
    """Put each vector into the cluster of its nearest centroid, in place, with its bounds; the number of distances taken."""
    least = np.maximum(lower, g.near[a] / 2)
    rows = np.flatnonzero(~(upper < least))
    d = own_squares(x[rows], g.c[a[rows]])
    taken = len(rows)
    upper[rows] = np.sqrt(d.astype(np.float64)) * (1 + SLACK)
    some = ~(upper[rows] < least[rows])
    rows, d = rows[some], d[some]
    if len(g.c) == 1:
        lower[rows] = np.inf
        return taken
    by = np.argsort(a[rows], kind="stable")
    rows, d = rows[by], d[by]
    ends = np.flatnonzero(np.r_[a[rows][1:] != a[rows][:-1], True]) + 1 if len(rows) else []
    first = 0
    for end in ends:
        at, best = rows[first:end], d[first:end].copy()
        own = int(a[at[0]])
        number, second = np.full(len(at), own), np.full(len(at), _NONE)
        radius = (2 * upper[at] + g.near[own]) * (1 + 4 * SLACK)
        count = np.searchsorted(g.away[own], radius, "right")
        lo, width = 0, 1
        while len(on := np.flatnonzero(count > lo)):
            js = g.order[own, lo : lo + width]
            found = squares(x[at[on]], g.c[js])
            taken += found.size
            least_d = found.min(axis=1)
            least_j = np.where(found == least_d[:, None], js, len(g.c)).min(axis=1)
            next_d = np.partition(found, 1, axis=1)[:, 1] if len(js) > 1 else np.full(len(on), _NONE)
            second[on] = np.minimum(np.minimum(second[on], next_d), np.maximum(best[on], least_d))
            better = (least_d < best[on]) | ((least_d == best[on]) & (least_j < number[on]))
            best[on], number[on] = np.where(better, least_d, best[on]), np.where(better, least_j, number[on])
            lo, width = lo + width, 2 * width
        a[at], upper[at], lower[at] = number, np.sqrt(best.astype(np.float64)) * (1 + SLACK), np.sqrt(second.astype(np.float64)) * (1 - SLACK)
        first = end
    return taken


def _vectors(points: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """id and v (32-bit little-endian components) of the vectors that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = integers(b["vector"], dims)
            raw = x.astype("<i4").tobytes()
            yield pa.record_batch([b["id"].take(pa.array(rows)), pa.array([raw[i : i + 4 * dims] for i in range(0, len(raw), 4 * dims)], pa.binary())], ["id", "v"])

    conf = points.sparkSession.conf
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in conf.getAll:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return points.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(run, "id long, v binary")


_STATE = "kind int, id long, v binary, cluster int, upper double, lower double, distance long, at int, total decimal(38,0)"
#: Components of a sums row besides those of the vectors: number of vectors, sum of distances, distances taken.
_COUNT, _SUM, _TAKEN = -1, -2, -3


def _assigned(rows: DataFrame, g: Geometry, moved: np.ndarray | None, dims: int, last: bool) -> DataFrame:
    """Rows of kind 0: the vectors with cluster and bounds; of kind 1: a task's sums by cluster."""
    shared = rows.sparkSession.sparkContext.broadcast((g, moved))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, moved = shared.value
        k, names = len(g.c), _names()
        total, count, summed, taken = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), [0] * k, 0
        if moved is not None:
            far = np.argsort(moved)[::-1]
            most = np.full(k, moved[far[0]])  # by how far any other centroid moved
            most[far[0]] = moved[far[1]] if k > 1 else 0.0
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            x = np.frombuffer(b"".join(b["v"].to_pylist()), "<i4").reshape(n, dims).astype(np.int64)
            if moved is None:
                a, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n)
            else:
                a = b["cluster"].to_numpy().astype(np.int64)
                upper = (b["upper"].to_numpy() + moved[a]) * (1 + SLACK)
                lower = np.maximum(0, (b["lower"].to_numpy() - most[a]) * (1 - SLACK))
            taken += assign(x, a, upper, lower, g)
            np.add.at(total, a, x)
            count += np.bincount(a, minlength=k)
            distance = own_squares(x, g.c[a]) if last else np.zeros(n, np.int64)
            for j in np.unique(a) if last else []:
                summed[j] += sum(distance[a == j].tolist())
            none = pa.nulls(n)
            v = none.cast(pa.binary()) if last else b["v"]
            yield pa.record_batch([pa.array(np.zeros(n, np.int32)), b["id"], v, pa.array(a.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(distance), none.cast(pa.int32()), none.cast(pa.decimal128(38, 0))], names)
        sums = [(j, i, int(total[j, i])) for j in np.flatnonzero(count).tolist() for i in range(dims)]
        sums += [(j, at, int(of[j])) for j in np.flatnonzero(count).tolist() for at, of in ((_COUNT, count), (_SUM, summed))] + [(0, _TAKEN, taken)]
        n, none = len(sums), pa.nulls(len(sums))
        yield pa.record_batch([pa.array(np.ones(n, np.int32)), none.cast(pa.int64()), none.cast(pa.binary()), pa.array([s[0] for s in sums], pa.int32()), none.cast(pa.float64()), none.cast(pa.float64()), none.cast(pa.int64()), pa.array([s[1] for s in sums], pa.int32()), pa.array([Decimal(s[2]) for s in sums], pa.decimal128(38, 0))], names)

    return rows.mapInArrow(run, _STATE)


def _names() -> list[str]:
    return [c.split()[0] for c in _STATE.split(", ")]


@dataclass
class Clustering:
    """rows: id, cluster, distance; centroids, and sums of distances by cluster; taken: distances taken in each pass; size: vectors."""

    rows: DataFrame
    centroids: list[list[int]]
    inertia: list[int]
    taken: list[int]
    size: int


def clustered(points: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering:
    """Rounds of assignment and exact floors of means from k vectors taken by the hash of seed and id, then a last assignment."""
    spark = points.sparkSession
    stage = Stages(spark)
    rows = stage(_vectors(points, dims, id_col, vector_col), "vectors")
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    firsts = rows.filter("id IS NOT NULL").orderBy(by, "v").limit(k).select("v").collect()
    if not firsts:
        stage.drop()
        return Clustering(spark.createDataFrame([], "id long, cluster int, distance long"), [], [], [], 0)
    c = np.array([np.frombuffer(r["v"], "<i4") for r in firsts], np.int64)
    moved, taken = None, []
    for turn in range(rounds + 1):
        last, own = turn == rounds, Stages(spark)
        found = _assigned(rows, geometry(c), moved, dims, last)
        found = staged(found, "clustered") if last else own(found, "assigned")
        sums = {(r["cluster"], r["at"]): int(r["total"]) for r in found.filter("kind = 1").groupBy("cluster", "at").agg(F.sum("total").alias("total")).collect()}  # k * (dims + 3) rows at most
        taken.append(sums.get((0, _TAKEN), 0))
        stage.drop()
        stage, rows = own, found.filter("kind = 0")
        if not last:
            new = np.array([[sums[j, i] // sums[j, _COUNT] for i in range(dims)] if (j, _COUNT) in sums else c[j] for j in range(len(c))], np.int64)
            moved = np.sqrt(own_squares(new, c).astype(np.float64)) * (1 + SLACK)
            c = new
    size = sum(sums.get((j, _COUNT), 0) for j in range(len(c)))
    return Clustering(rows.select("id", "cluster", "distance"), c.tolist(), [sums.get((j, _SUM), 0) for j in range(len(c))], taken, size)


def digest(found: Clustering) -> DataFrame:
    """The rows with the sums of distances and the hash of the final centroid (a table of k rows is broadcast)."""
    spark, most = found.rows.sparkSession, int(_NONE)
    model = [(j, min(of, most), min(sum(found.inertia), most), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, (c, of) in enumerate(zip(found.centroids, found.inertia, strict=True))]
    model = spark.createDataFrame(model, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(model), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
