"""Versioned tables on Parquet: snapshots per branch, and point tables with an atomic current version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sync, tree


def write_snapshot(nodes: DataFrame, path: str, branch: str, stamp: str) -> None:
    """Append the nodes (path, type, hash) of a run as branch / snapshot_ts partitions; call it after a sync has succeeded."""
    nodes.withColumn("branch", T.safe_branch(F.lit(branch))).withColumn("snapshot_ts", F.lit(stamp)).write.mode("append").partitionBy("branch", "snapshot_ts").parquet(path)


def latest_snapshot(spark: SparkSession, path: str, branch: str) -> DataFrame:
    """Nodes of the branch's last snapshot (by its stamp); both columns prune partitions."""
    schema = "path string, type string, hash string, branch string, snapshot_ts string"
    rows = spark.read.schema(schema).parquet(path).filter(F.col("branch") == T.safe_branch(F.lit(branch)))
    last = rows.agg(F.max("snapshot_ts")).first()[0]
    return rows.filter(F.col("snapshot_ts") == F.lit(last)).select("path", "type", "hash")


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def current_version(spark: SparkSession, path: str) -> int:
    """Number of the last complete version of a table, 0 if there is none: a version counts once its _SUCCESS file is there."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(_hadoop(spark, f"{path}/{n}/_SUCCESS")[1])]
    return max(done, default=0)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{path}/v={current_version(spark, path) if version is None else version}")


def write_version(df: DataFrame, path: str) -> int:
    """Write df as the table's next version and return its number."""
    version = current_version(df.sparkSession, path) + 1
    df.write.mode("overwrite").parquet(f"{path}/v={version}")
    return version


def sync_index(spark: SparkSession, files: DataFrame, index_path: str, snapshot_path: str, branch: str, stamp: str, make_points: Callable[[DataFrame], DataFrame]) -> bool:
    """Bring the point table in line with files (file_path, content). Returns whether anything changed.

    Equal root hashes end it at once. Else new and changed files are chunked by
    make_points (id, vector, payload) and upserted, stale chunks are dropped,
    and the snapshot is written last, so that a run that failed is done again.
    """
    current = files.select("file_path", T.content_hash(F.col("content")).alias("hash"))
    nodes = tree.tree_hashes(current)
    fs, p = _hadoop(spark, snapshot_path)
    schema = "path string, type string, hash string"
    previous = latest_snapshot(spark, snapshot_path, branch) if fs.exists(p) else spark.createDataFrame([], schema)
    root = nodes.filter("path = ''").first()
    old_root = previous.filter("path = ''").first()
    if old_root is not None and old_root["hash"] == root["hash"]:
        return False
    has_index = current_version(spark, index_path) > 0
    old = read_version(spark, index_path) if has_index else None
    index = sync.index_state(old).select("file_path", "chunk_id") if has_index else spark.createDataFrame([], "file_path string, chunk_id string")
    process, delete = sync.sync_plan(current, previous.withColumnRenamed("path", "file_path"), index)
    new = make_points(files.join(process, "file_path", "left_semi"))
    if has_index:
        kept = sync.delete_ids(old, delete.select(F.col("chunk_id").alias("id")))
        new = sync.upsert(kept, new)
    write_version(new, index_path)
    write_snapshot(nodes, snapshot_path, branch, stamp)
    return True
