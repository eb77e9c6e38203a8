"""Mixing sources to target weights (operator 8): a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1]: it starts at
(1 - tilt) times and ends at (1 + tilt) times its mean weight (or the reverse
for a source at an even rank), so the integral over the whole run is the mean
weight, and its cumulative word demand is D(t) = target * (a t + b t^2). The
words of a source form a stream, document after document in an order dealt by
a hash of the doc_id, repeated while the target asks for more. A document is
taken once for each pass in which its first word lies below the target; its
training position is the t with D(t) = offset of that first word. `dealt` gives
a row for each pass, range-sorted by position; `mixed` has the documents in that
order and `digest` sums the rows of each document.

The running offset is found in two steps, so that a hot source is never one
group: sums by (source, hash bucket), a running sum over the buckets, then a
running sum inside each bucket, whose number of rows stays near ROWS_PER_BUCKET.

Cases: null texts have size 0 and are taken 0 words; null is a source of its
own, last; documents with size 0 are never placed; repeated rows are dealt one
after another; an empty table gives an empty table; other columns are kept by
`mixed`, whatever their names, and `placed` needs other names than its own, which begin with mix_; in `dealt` and `digest` documents without a pass stay,
once, with neither pass nor position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
TILT = 0.5
ROWS_PER_BUCKET = 20_000
#: Sources up to this number are broadcast with their targets; beyond it the join is left to Spark.
FEW_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """sizes: one row per source (mix_source, mix_size), so a small table. Adds mix_rank, mix_weight and mix_target.

    Targets share the total by weight; those above most * size stop there, and
    the excess is shared again, until none is above. With r = most * size /
    weight in ascending order, exactly the sources before the first one whose r
    is at least (total - capped sizes before) / (weights from here on) stop.
    """
    order = Window.orderBy(F.col("mix_source").asc_nulls_last())
    s = sizes.withColumn("mix_rank", F.row_number().over(order) - 1)
    s = s.withColumn("mix_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("mix_rank") % len(weights) + 1).cast("int")))
    ratio = Window.orderBy(F.col("mix_size") / F.col("mix_weight"), "mix_rank")
    before, rest, whole = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(1))
    s = s.withColumn("mix_left", F.sum("mix_size").over(whole) - most * F.coalesce(F.sum("mix_size").over(before), F.lit(0)))
    s = s.withColumn("mix_over", F.sum("mix_weight").over(rest)).withColumn("mix_cap", most * F.col("mix_size"))
    s = s.withColumn("mix_fits", F.col("mix_cap") * F.col("mix_over") >= F.col("mix_left") * F.col("mix_weight"))
    first = F.when(F.col("mix_fits"), F.struct(F.col("mix_size") / F.col("mix_weight"), "mix_rank"))
    s = s.withColumn("mix_level", F.min_by(F.col("mix_left") / F.col("mix_over"), first).over(whole))
    target = F.least(F.col("mix_cap").cast("double"), F.coalesce(F.col("mix_level"), F.lit(0.0)) * F.col("mix_weight"))
    return s.withColumn("mix_target", target).select("mix_source", "mix_size", "mix_rank", "mix_weight", "mix_target")


def placed(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """docs and: mix_words, mix_rank, mix_size and mix_target (of the source), mix_offset (words of the source before this row), mix_passes, mix_row (names the row)."""
    return _placed(docs.withColumn("mix_words", word_count(F.col("text"))), weights, most)


def _placed(docs: DataFrame, weights: tuple, most: int) -> DataFrame:
    """`placed` for rows that know their mix_words."""
    d = docs.withColumn("mix_deal", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    by_source = d.groupBy(F.col("source").alias("mix_source")).agg(F.sum("mix_words").alias("mix_size"), F.count(F.lit(1)).alias("mix_rows"))
    seen = by_source.agg(F.max("mix_rows").alias("rows"), F.count(F.lit(1)).alias("sources")).first()
    digits = bucket_digits(seen["rows"] or 0)
    targets = source_targets(by_source.select("mix_source", "mix_size"), weights, most)
    if seen["sources"] <= FEW_SOURCES:
        targets = F.broadcast(targets)
    d = d.withColumn("mix_bucket", F.substring("mix_deal", 1, digits))
    buckets = d.groupBy(F.col("source").alias("mix_s"), F.col("mix_bucket").alias("mix_b")).agg(F.sum("mix_words").alias("mix_in_bucket"))
    ahead = Window.partitionBy("mix_s").orderBy("mix_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("mix_ahead", F.coalesce(F.sum("mix_in_bucket").over(ahead), F.lit(0))).drop("mix_in_bucket")
    order = Window.partitionBy("source", "mix_bucket").orderBy("mix_deal", "doc_id", "mix_words")
    inside = order.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("mix_within", F.coalesce(F.sum("mix_words").over(inside), F.lit(0))).withColumn("mix_nth", F.row_number().over(order))
    d = d.join(buckets, F.col("source").eqNullSafe(F.col("mix_s")) & (F.col("mix_bucket") == F.col("mix_b")), "left").drop("mix_s", "mix_b")
    d = d.join(targets, F.col("source").eqNullSafe(F.col("mix_source")), "left").drop("mix_source")
    d = d.withColumn("mix_offset", F.col("mix_ahead") + F.col("mix_within")).withColumn("mix_row", F.struct("mix_rank", "mix_bucket", "mix_nth"))
    d = d.drop("mix_ahead", "mix_within", "mix_bucket", "mix_deal", "mix_nth")
    passes = F.when(F.col("mix_words") > 0, F.greatest(F.lit(0), F.ceil((F.col("mix_target") - F.col("mix_offset")) / F.col("mix_size")))).otherwise(0)
    return d.withColumn("mix_passes", F.least(passes, F.lit(most)).cast("int"))


def bucket_digits(rows: int) -> int:
    """Hex digits of the hash that keep a bucket of so many rows near ROWS_PER_BUCKET."""
    return max(1, math.ceil(math.log(max(1, rows / ROWS_PER_BUCKET), 16)))


def position(offset: Column, target: Column, rank: Column, tilt: float = TILT) -> Column:
    """The t in [0, 1) with target * ((1 - s) t + s t^2) = offset, s = tilt at odd ranks and -tilt at even ones."""
    s = F.when(rank % 2 == 1, F.lit(tilt)).otherwise(F.lit(-tilt))
    y = offset / target
    return 2 * y / ((1 - s) + F.sqrt((1 - s) * (1 - s) + 4 * s * y))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The taken documents, once per pass, with docs' columns, range-sorted by training position."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("mix_words"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("mix_all"))
    return dealt(_placed(rows, weights, most).filter("mix_passes > 0")).select("mix_all.*")


def dealt(p: DataFrame) -> DataFrame:
    """A row for each pass of the placed rows, with mix_pass (from 0) and mix_position, range-sorted by position; rows without a pass come first, once, with nulls there."""
    passes = F.when(F.col("mix_passes") > 0, F.sequence(F.lit(0), F.col("mix_passes") - 1))
    p = p.select("*", F.explode_outer(passes).alias("mix_pass"))
    p = p.withColumn("mix_position", position(F.col("mix_offset") + F.col("mix_pass") * F.col("mix_size"), F.col("mix_target"), F.col("mix_rank")))
    n = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ("mix_position", "doc_id", "mix_row")
    return p.repartitionByRange(n, *by).sortWithinPartitions(*by)


def training_order(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """`dealt` without texts, written out: doc_id, mix_row, mix_words, mix_size, mix_target, mix_pass, mix_position."""
    p = placed(docs, weights, most).select("doc_id", "mix_row", "mix_words", "mix_rank", "mix_size", "mix_target", "mix_offset", "mix_passes")
    return staged(dealt(p).drop("mix_rank", "mix_offset", "mix_passes"), "order")


def digest(order: DataFrame) -> DataFrame:
    """A row for each document of `training_order`: doc_id, mix_words, mix_size, mix_target, mix_taken (words, over its passes) and mix_first (position of the first)."""
    words = F.when(F.col("mix_pass").isNotNull(), F.col("mix_words")).otherwise(0)
    found = order.groupBy("mix_row", "doc_id", "mix_words", "mix_size", "mix_target").agg(F.sum(words).alias("mix_taken"), F.min("mix_position").alias("mix_first"))
    return found.drop("mix_row")
