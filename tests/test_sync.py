import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import sync
from sparkloom.sources import config, versions
from sparkloom.streaming import watch


def points(files):
    """One point for each file."""
    h = T.content_hash(F.col("content"))
    return files.select(F.col("file_path").alias("id"), F.array(F.lit(1.0)).alias("vector"), F.struct(h.alias("content_hash"), F.struct("file_path", h.alias("file_content_hash")).alias("file_metadata")).alias("payload"))


def test_sync_is_idempotent_and_follows_changes(spark, tmp_path):
    index, snap = str(tmp_path / "index"), str(tmp_path / "snap")
    make = lambda rows: spark.createDataFrame(rows, "file_path string, content string")
    one = make([("a/x.py", "1"), ("a/y.py", "2"), ("z.py", "3")])
    assert versions.sync_index(spark, one, index, snap, "main", "20240101", points)
    assert not versions.sync_index(spark, one, index, snap, "main", "20240102", points)
    two = make([("a/x.py", "1"), ("a/y.py", "changed"), ("new.py", "4")])
    assert versions.sync_index(spark, two, index, snap, "main", "20240103", points)
    got = {r.id: r.payload.content_hash for r in versions.read_version(spark, index).collect()}
    want = {r.id: r.payload.content_hash for r in points(two).collect()}
    assert got == want and versions.current_version(spark, index) == 2
    assert {r.path for r in versions.latest_snapshot(spark, snap, "main").collect()} == {"", "a", "a/x.py", "a/y.py", "new.py"}
    (tmp_path / "index" / "v=3").mkdir()  # a version without _SUCCESS was never finished
    assert versions.current_version(spark, index) == 2


def test_plan_and_states(spark):
    cur = spark.createDataFrame([("same", "1"), ("mod", "2"), ("new", "3")], "file_path string, hash string")
    prev = spark.createDataFrame([("same", "file", "1"), ("mod", "file", "x"), ("gone", "file", "4"), ("new", "dir", "3")], "file_path string, type string, hash string")
    index = spark.createDataFrame([("same", "c1"), ("mod", "c2"), ("gone", "c3"), ("orphan", "c4")], "file_path string, chunk_id string")
    process, delete = sync.sync_plan(cur, prev, index)
    assert {r.file_path for r in process.collect()} == {"mod", "new"} and {r.chunk_id for r in delete.collect()} == {"c2", "c3", "c4"}
    none = prev.filter("false")
    assert sync.sync_plan(cur, none, index)[0].count() == 3 and sync.sync_plan(cur, none, index)[1].count() == 4
    stored = spark.createDataFrame([("same", "1"), ("same", "0"), ("mod", "9"), ("gone", "4")], "file_path string, hash string")
    assert {(r.file_path, r.action) for r in sync.compare_states(cur, stored).collect()} == {("mod", "update"), ("new", "add"), ("gone", "delete")}


def test_payloads(spark):
    p = spark.createDataFrame([(1, ("a", 1)), (2, ("b", None))], "id int, payload struct<k:string,n:int>")
    rows = lambda df: [(r.id, tuple(r.payload) if r.payload else None) for r in df.orderBy("id").collect()]
    assert rows(sync.set_payload(p, F.col("id") == 2, {"n": F.lit(5)})) == [(1, ("a", 1)), (2, ("b", 5))]
    assert rows(sync.replace_payload(p, F.col("id") == 1, F.struct(F.lit("z").alias("k"), F.lit(0).alias("n")))) == [(1, ("z", 0)), (2, ("b", None))]
    assert rows(sync.clear_payload(p, F.col("payload.n") > 0)) == [(1, None), (2, ("b", None))]
    assert rows(sync.drop_payload_keys(p, F.lit(True), ["k"])) == [(1, (None, 1)), (2, (None, None))]
    assert sync.drop_payload_columns(p, ["n"]).schema["payload"].dataType.names == ["k"]
    assert [r.id for r in sync.delete_where(p, F.col("payload.n") > 0).collect()] == [2]
    assert sync.scroll_ids(p, F.col("id") > 1).collect()[0].id == 2 and sync.fetch(p, p.filter("id = 1").select("id")).count() == 1


def test_sessions_tie_at_the_gap(spark):
    t = datetime.datetime(2024, 1, 1)
    e = spark.createDataFrame([(t, False), (t + datetime.timedelta(seconds=10), False), (t + datetime.timedelta(seconds=20, microseconds=1), False), (t, True)], "ts timestamp, is_directory boolean")
    assert sorted(r.n_events for r in watch.debounced(watch.changes(e), "10 seconds").collect()) == [1, 2]


def test_stream_syncs_once_per_finished_session(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    e = spark.createDataFrame([(t + datetime.timedelta(seconds=s), False) for s in (0, 3, 100, 1000, 5000)], "ts timestamp, is_directory boolean")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    watch.sync_on_change(stream, "10 seconds", "1 minute", lambda b, n: seen.extend(r.n_events for r in b.collect()), str(tmp_path / "state")).awaitTermination()
    assert sorted(seen) == [1, 1, 2]  # the last session is still open


def test_settings():
    s = config.settings({"embedding": {"dimension": 64}, "sync": {"exclude_patterns": ["x"]}})
    assert s.embedding.dimension == 64 and s.embedding.metric == "cosine" and s.sync.exclude_patterns == ("x",) and config.settings() == config.Settings()
    with pytest.raises(ValueError):
        config.settings({"nope": 1})
