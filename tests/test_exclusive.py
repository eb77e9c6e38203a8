"""Triggers that come while a synchronisation runs are skipped, over several micro-batches; incremental parsing."""

import random

from pyspark.sql import functions as F

from sparkloom.sources import code
from sparkloom.streaming import exclusive


def test_state_outlives_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted((rng.randrange(1000), rng.choice("ab")) for _ in range(120))
    for part in range(3):  # in order of time, a file each
        spark.createDataFrame(rows[40 * part : 40 * part + 40], "s long, k string").coalesce(1).select("k", F.timestamp_seconds("s").alias("t")).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run, from the checkpoint, finds nothing new
        stream = spark.readStream.schema("k string, t timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = exclusive.exclusive(stream, "k", "t", 30).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    want, free = [], {}
    for s, k in rows:
        ran = s >= free.get(k, 0)
        if ran:
            free[k] = s + 30
        want.append((k, s, ran))
    got = [(r.k, r.s, r.ran) for r in spark.read.parquet(str(tmp_path / "out")).select("k", F.unix_seconds("t").alias("s"), "ran").collect()]
    assert sorted(got) == sorted(want)


def test_only_changed_files_are_parsed(spark):
    first = [("a.py", "x = 1\n"), ("b.py", "y = 1\n"), ("c.py", "z = 1\n"), ("n.py", None), ("e.py", "")]
    known = code.incremental(spark.createDataFrame(first, "file_path string, content string")).cache()
    second = [("a.py", "x = 1\n"), ("b.py", "y = 2\n"), ("d.py", "x = 1\n"), ("n.py", None), ("e.py", "")]
    got = code.incremental(spark.createDataFrame(second, "file_path string, content string"), known)
    assert {(r.file_path, r.name, r.parsed) for r in got.collect()} == {("a.py", "a", False), ("a.py", "x", False), ("b.py", "b", True), ("b.py", "y", True), ("d.py", "d", True), ("d.py", "x", True), ("e.py", "e", False)}
    assert got.columns == known.columns
