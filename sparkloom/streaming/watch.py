"""Change streams: debounced sessions of file events, and synchronisation per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def changes(events: DataFrame) -> DataFrame:
    """Events of files; directory events are left out, all kinds of change count the same."""
    return events.filter(~F.coalesce(F.col("is_directory"), F.lit(False)))


def debounced(events: DataFrame, gap: str, key: str | Column | None = None, time: str = "ts", late: str | None = None) -> DataFrame:
    """One row per quiet period: (key), started, last, n_events. Events closer than or exactly one gap apart belong together.

    On a stream, `late` is the watermark; a session is given out when the
    watermark has passed its end (append mode).
    """
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    if late is not None:
        e = e.withWatermark(time, late)
    # a stream has no sessions without a key: a constant that the optimizer doesn't see stands for it
    by = [F.session_window(time, gap), key if key is not None else F.pmod(F.hash(time), F.lit(1)).alias("everything")]
    return e.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"), F.max(time).alias("last")).withColumn("started", F.col("session_window.start")).drop("session_window", *(["everything"] if key is None else []))


def sync_on_change(events: DataFrame, gap: str, late: str, sync: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run sync(sessions, batch number) for each micro-batch of finished sessions; batches never overlap."""
    def once(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            sync(batch, number)

    return debounced(changes(events), gap, late=late).writeStream.outputMode("append").foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
