"""Quality classifier (operator 10): random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of every whole text are standardised and mapped by cosines of random
projections, whose inner products approximate a Gaussian kernel. Each partition
sums its share of the normal equations; the sums are added up in a second step
and the ridge weights solved from one matrix of fixed size. A part of the
training rows (`_CALIBRATION`) is left out of the ridge; on it the numbers of
good and bad documents per score bin, summed by Spark, give an isotonic curve
from ridge scores to probabilities.

Cases: a null text counts as empty and gets a score like any other; null labels
are left out; without labels every score is 0.5; repeated rows each count; an
empty table gives an empty table; only doc_id and text of documents are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .text_stats import text_stats

DIMENSIONS = 128
RIDGE = 1e-3
BINS = 1000
SEED = 7
#: One in so many training rows calibrates.
_CALIBRATION = 4


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def features() -> list[Column]:
    """What the classifier sees of a document."""
    return [
        F.log1p("n_words"),
        _share("word_chars", "n_words"),
        F.sqrt(_share("n_symbols", "n_words")),
        F.sqrt(_share("n_dup_lines", "n_lines")),
        F.sqrt(_share("n_repeat_words", "n_words")),
        F.log1p(_share("n_words", "n_lines")),
        F.sqrt(_share("n_upper", "n_letters")),
        _share("n_letters", "word_chars"),
        F.sqrt(_share("n_digits", "word_chars")),
        F.sqrt(_share("n_marks", "n_words")),
        F.sqrt(_share("n_exclaims", "n_words")),
        _share("n_distinct_words", "n_words"),
        F.sqrt(_share("n_run_words", "n_words")),
        F.sqrt(_share("n_symbol_words", "n_words")),
        _share("n_ended_lines", "n_lines"),
        F.sqrt(_share("n_long_words", "n_words")),
    ]


class Fourier:
    """z(x) with z(x) . z(y) close to exp(-|x - y|^2 / (2 width^2)) on standardised x, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.turn = rng.normal(size=(len(mean), dimensions)) / np.sqrt(len(mean) / 2)
        self.phase = rng.uniform(0, 2 * np.pi, dimensions)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.spread, -6, 6)
        z = np.sqrt(2 / len(self.phase)) * np.cos(x @ self.turn + self.phase)
        return np.c_[z, np.ones(len(z))]


def isotonic(good: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: non-decreasing shares of good, for bins in order; each pool is smoothed by half a document of either kind."""
    pools: list[list[float]] = []
    for g, n in zip(good, all_, strict=True):
        pools.append([g, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            g2, n2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + g2, pools[-1][1] + n2, pools[-1][2] + k2]
    return np.maximum.accumulate(np.concatenate([np.full(int(k), (g + 0.5) / (n + 1)) for g, n, k in pools]))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    x = b["x"].flatten().to_numpy(zero_copy_only=False)
    return x.reshape(b.num_rows, -1)


def _sums(parts: DataFrame) -> DataFrame:
    """One row per partition: the sum of its rows, arrays of doubles in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b["part"].to_pylist():
                v = np.frombuffer(x)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["part"])

    return parts.mapInArrow(run, "part binary")


def fit(rows: DataFrame, dimensions: int = DIMENSIONS, ridge: float = RIDGE) -> tuple[Fourier, np.ndarray, np.ndarray, np.ndarray] | None:
    """rows: x (array of doubles), y (0 or 1), calibrate. The map, the ridge weights, and the calibration's bin middles and shares."""
    if rows.limit(1).count() == 0:
        return None
    n = len(features())
    seen = rows.select(*[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(n) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = Fourier(np.array([seen[f"m{i}"] for i in range(n)]), np.array([seen[f"s{i}"] for i in range(n)]), dimensions)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimensions + 1, dimensions + 2))
        for b in batches:
            if b.num_rows:
                v = z(_matrix(b))
                total += v.T @ np.c_[v, b["y"].to_numpy(zero_copy_only=False)]
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = rows.filter(~F.col("calibrate")).select("x", "y").mapInArrow(part, "part binary")
    for width in (32, 4):
        parts = _sums(parts.repartition(width))
    total = sum(np.frombuffer(r["part"]) for r in parts.collect()).reshape(dimensions + 1, dimensions + 2)  # 4 rows at most
    gram = total[:, :-1] + ridge * max(1.0, total[-1, -2]) * np.diag(np.r_[np.full(dimensions, 1 / dimensions), 1e-9])
    weights = np.linalg.solve(gram, total[:, -1])
    binned = ridge_scores(rows.filter("calibrate").select("x", "y"), z, weights).groupBy(F.round("ridge", 3).alias("bin")).agg(F.sum("y").alias("good"), F.count("y").alias("all"))
    found = sorted((r["bin"], r["good"], r["all"]) for r in binned.collect())  # BINS and one rows at most
    if not found:
        return z, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0])
    at, good, all_ = (np.array(v, float) for v in zip(*found, strict=True))
    return z, weights, at, isotonic(good, all_)


def ridge_scores(rows: DataFrame, z: Fourier, weights: np.ndarray) -> DataFrame:
    """rows with the column ridge, clipped to [0, 1], in place of x."""
    keep = [c for c in rows.columns if c != "x"]
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.clip(z(_matrix(b)) @ weights, 0, 1) if b.num_rows else np.zeros(0)
            yield pa.record_batch([*(b[c] for c in keep), pa.array(s)], [*keep, "ridge"])

    return rows.mapInArrow(run, f"{kinds}, ridge double")


def scored(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """doc_id and score (probability that the text is good) of every document.

    labels: doc_id, quality (0 or 1); train: a condition over doc_id that says whose labels may be learnt from.
    """
    stats = text_stats(docs)
    rows = staged(stats.select("doc_id", F.array(*[f.cast("double") for f in features()]).alias("x")), "statistics")
    y = labels.select("doc_id", F.col("quality").cast("double").alias("y")).filter(F.col("y").isNotNull() & train)
    calibrate = F.pmod(F.xxhash64("doc_id"), F.lit(_CALIBRATION)) == 0
    model = fit(staged(rows.join(y, "doc_id").select("x", "y", calibrate.alias("calibrate")), "training"))
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    z, weights, at, share = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.interp(np.clip(z(_matrix(b)) @ weights, 0, 1), at, share) if b.num_rows else np.zeros(0)
            yield pa.record_batch([b["doc_id"], pa.array(s)], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")
