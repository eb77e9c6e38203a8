"""Connected components of an edge table, and density clusters on top of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def staging_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one on one machine (tests) where that is unset, which on a cluster is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="staged-")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage."""
    return Staged(df.sparkSession)(df, name)


class Staged:
    """Tables in the shared folder that go together once a round no longer reads them."""

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


def ranked(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """df with a number (from 0) of each row in this total order: rows are counted by range, so no task sees all of them."""
    parts = df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id())
    parts = staged(parts, "ranges")
    by = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = parts.groupBy("range_no").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(by), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("range_no").orderBy(*order)) - 1
    return parts.withColumn("own_no", own).join(sizes, "range_no").withColumn(name, F.col("ahead") + F.col("own_no")).drop("range_no", "own_no", "ahead")


def running(df: DataFrame, sums: dict[str, str], *order: str) -> DataFrame:
    """df with running sums (name: of column), up to and with each row in this total order, over ranges of it as in `ranked`."""
    parts = staged(df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()), "ranges")
    by = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    total = parts.groupBy("range_no").agg(*[F.sum(c).alias(f"ahead_{n}") for n, c in sums.items()])
    total = total.select("range_no", *[F.coalesce(F.sum(f"ahead_{n}").over(by), F.lit(0)).alias(f"ahead_{n}") for n in sums])
    own = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.withColumns({f"own_{n}": F.sum(c).over(own) for n, c in sums.items()}).join(total, "range_no")
    return out.select(*df.columns, *[(F.col(f"ahead_{n}") + F.col(f"own_{n}")).alias(n) for n in sums])


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of each end of the edges (a, b); component is the least id reachable.

    Each round takes the least label among neighbours, then the label of that
    label, so a path shrinks by more than half; rounds end when nothing changes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edge, own = Staged(edges.sparkSession), Staged(edges.sparkSession)
    both = edge(both, "edges")
    labels = own(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = new.select(F.col("id").alias("up_id"), F.col("label").alias("up"))
        turn = Staged(edges.sparkSession)
        new = turn(new.join(up, F.col("label") == F.col("up_id"), "left").select("id", "old", F.least("label", "up").alias("label")), "labels")
        changed = new.filter("label <> old").limit(1).count()
        own.drop()
        labels, own = new.drop("old"), turn
        if not changed:
            edge.drop()
            return labels.withColumnRenamed("label", "component")


def density_clusters(ids: DataFrame, pairs: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, component) for all ids under density clustering with two points a core: every point with a neighbour is core, so clusters are components and the rest are on their own."""
    part = connected_components(pairs)
    return ids.select(F.col(id_col).alias("id")).join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
