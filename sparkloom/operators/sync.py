"""Index synchronisation as relational algebra, and copy-on-write point tables.

States are tables: current (file_path, hash), previous (file_path, type, hash),
index (file_path, chunk_id). A point table is (id, vector, payload struct); its
updates return the new version, since Parquet tables have no MERGE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_status(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(file_path, status): new, changed, unchanged or deleted. Only file nodes of previous count."""
    old = previous.filter(F.col("type") == "file").select("file_path", F.col("hash").alias("old_hash"), F.lit(True).alias("was"))
    new = current.select("file_path", F.col("hash").alias("new_hash"), F.lit(True).alias("is"))
    both = new.join(old, "file_path", "full_outer")
    status = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted").when(F.col("new_hash").eqNullSafe(F.col("old_hash")), "unchanged").otherwise("changed")
    return both.select("file_path", status.alias("status"))


def sync_plan(current: DataFrame, previous: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to process, chunks to delete).

    New and changed files are processed. Chunks go whose file is processed, was
    deleted, or is in neither state (orphans).
    """
    status = file_status(current, previous)
    process = status.filter(F.col("status").isin("new", "changed")).select("file_path")
    known = status.filter("status = 'unchanged'").select("file_path")
    return process, index.join(known, "file_path", "left_anti").select("file_path", "chunk_id").distinct()


def compare_states(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(file_path, action) with add, update or delete. stored holds one row for each hash of a file; a file is updated when its hash is none of them."""
    sets = stored.groupBy("file_path").agg(F.collect_set("hash").alias("hashes"))
    both = current.select("file_path", "hash").join(sets, "file_path", "full_outer")
    action = F.when(F.col("hashes").isNull(), "add").when(F.col("hash").isNull(), "delete").when(~F.array_contains("hashes", F.col("hash")), "update")
    return both.select("file_path", action.alias("action")).filter("action IS NOT NULL")


def drifted(chunks: DataFrame, current: DataFrame, fields: list[str]) -> DataFrame:
    """(chunk_id, values struct): the new values of fields for each chunk (of unchanged files) where any differs, null-safely."""
    new = current.select("file_path", F.struct(*fields).alias("values"))
    joined = chunks.join(new, "file_path")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"values.{f}"))
    return joined.filter(~same).select("chunk_id", "values")


def metadata_drift(chunks: DataFrame, current: DataFrame, fields: list[str]) -> DataFrame:
    """(values struct, chunk_ids): `drifted` as one row for each new value, for few chunks; many are better updated by the rows of `drifted`."""
    return drifted(chunks, current, fields).groupBy("values").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))


def index_state(points: DataFrame) -> DataFrame:
    """(file_path, chunk_id, hash) of points; rows without a path or hash are skipped."""
    rows = points.select(F.col("payload.file_metadata.file_path").alias("file_path"), F.col("id").alias("chunk_id"), F.col("payload.file_metadata.file_content_hash").alias("hash"))
    return rows.filter(F.col("file_path").isNotNull() & F.col("hash").isNotNull()).distinct()


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row, in this order, of each combination of keys."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("first_of_n", n).filter("first_of_n = 1").drop("first_of_n")


def content_hashes(points: DataFrame) -> DataFrame:
    """Distinct content_hash:file_content_hash where both are non-empty."""
    a, b = F.col("payload.content_hash"), F.col("payload.file_metadata.file_content_hash")
    return points.filter((F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")).select(F.concat_ws(":", a, b).alias("hashes")).distinct()


def upsert(points: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """points with new rows put in, or in place of rows with their ids."""
    return points.join(new.select(id_col), id_col, "left_anti").select(*points.columns).unionByName(new.select(*points.columns))


def delete_ids(points: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return points.join(ids.select(id_col), id_col, "left_anti").select(*points.columns)


def delete_where(points: DataFrame, condition: Column) -> DataFrame:
    """Points for which the condition is not true."""
    return points.filter(~F.coalesce(condition, F.lit(False)))


def fetch(points: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, payload) of the points asked for."""
    return points.select(id_col, "payload").join(ids.select(id_col), id_col, "left_semi")


def scroll_ids(points: DataFrame, condition: Column | None = None, id_col: str = "id") -> DataFrame:
    return (points if condition is None else points.filter(condition)).select(id_col)


def set_payload(points: DataFrame, condition: Column, values: dict[str, Column], key: str | None = None) -> DataFrame:
    """Set payload fields (under the struct field key, if given) where the condition is true; other fields stay."""
    payload = F.col("payload")
    for name, value in values.items():
        payload = payload.withField(f"{key}.{name}" if key else name, value)
    return points.withColumn("payload", F.when(condition, payload).otherwise(F.col("payload")))


def replace_payload(points: DataFrame, condition: Column, payload: Column) -> DataFrame:
    return points.withColumn("payload", F.when(condition, payload).otherwise(F.col("payload")))


def clear_payload(points: DataFrame, condition: Column) -> DataFrame:
    return points.withColumn("payload", F.when(~F.coalesce(condition, F.lit(False)), F.col("payload")))


def drop_payload_keys(points: DataFrame, condition: Column, keys: list[str]) -> DataFrame:
    """Null out payload fields where the condition is true; without rows that keep them, use dropFields on the whole table."""
    kind = {f.name: f.dataType for f in points.schema["payload"].dataType.fields}
    payload = F.col("payload")
    for k in keys:
        payload = payload.withField(k, F.lit(None).cast(kind[k]))
    return points.withColumn("payload", F.when(condition, payload).otherwise(F.col("payload")))


def drop_payload_columns(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.withColumn("payload", F.col("payload").dropFields(*keys))
