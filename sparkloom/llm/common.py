"""Shared pieces of the Spark side: staging tables and small conversions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of an Arrow batch that goes to a Python worker, where the session does not say it.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def staging_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a session on one machine (tests) may leave it unset and gets a temporary one; on a cluster that is an error, since executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            return made.get()
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="staged-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    return Stages(df.sparkSession)(df, name)


class Stages:
    """Staged tables that go together once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{staging_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for p in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = []


def texts(docs: DataFrame) -> DataFrame:
    """The two columns that operators read, whatever else the table holds."""
    conf = docs.sparkSession.conf
    if _BATCH not in conf.getAll:
        conf.set(_BATCH, str(BATCH_BYTES))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and key, a hash of the text."""
    return texts(docs).withColumn("key", F.xxhash64("text"))


def apart(names: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each with underscores before it until no given name is like it."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        out.append(w)
    return out
