"""Directory trees from paths: nodes, bottom-up hashes, drawn lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import staged


def path_nodes(files: DataFrame) -> DataFrame:
    """(path, parent, name, depth, is_file) of every file and all its directories; the root is "" at depth 0. Where a path is both, it counts as a directory."""
    parts = F.split("file_path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), (i < F.size(parts)).alias("is_dir"), i.alias("depth")))
    nodes = files.filter("file_path <> ''").select(F.explode(ends).alias("n")).select("n.*").groupBy("path").agg(F.max("is_dir").alias("is_dir"), F.max("depth").alias("depth"))
    parent = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    return nodes.select("path", parent.alias("parent"), F.element_at(F.split("path", "/"), -1).alias("name"), "depth", (~F.col("is_dir")).alias("is_file"))


def excluded(paths: DataFrame, patterns: list[str], path_col: str = "path") -> DataFrame:
    """Adds `excluded_by`: the first pattern (regular expressions, searched) that a path matches, null if none; "." is the root."""
    hit = F.coalesce(*[F.when(F.col(path_col).rlike(p), F.lit(p)) for p in patterns], F.lit(None).cast("string"))
    return paths.withColumn("excluded_by", hit)


def tree_hashes(files: DataFrame, empty_dirs: DataFrame | None = None, patterns: list[str] | None = None) -> DataFrame:
    """(path, type, hash) of every node from files (file_path, hash).

    A directory's hash is that of its children's name:hash, by name, with
    nothing between. What an exclusion pattern matches keeps a hash of the
    reason, and nothing below it counts. One aggregation per level, deepest
    first; the number of levels is the depth of the tree.
    """
    nodes = path_nodes(files.select("file_path"))
    if empty_dirs is not None:
        more = path_nodes(empty_dirs.select("file_path")).withColumn("is_file", F.lit(False))
        nodes = nodes.unionByName(more).groupBy("path", "parent", "name", "depth").agg(F.min("is_file").alias("is_file"))
    nodes = nodes.join(files.select(F.col("file_path").alias("path"), F.col("hash").alias("file_hash")), "path", "left")
    if patterns:
        nodes = excluded(nodes, patterns)
        steps = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))
        above = F.exists(F.slice(steps, 1, F.col("depth") - 1), lambda p: F.exists(F.array(*[F.lit(x) for x in patterns]), lambda r: F.regexp_like(p, r)))
        nodes = nodes.filter(~above)
        reason = F.concat_ws(":", F.lit("EXCLUDED_BY_PATTERN"), "excluded_by", "path")
        nodes = nodes.withColumn("file_hash", F.when(F.col("excluded_by").isNotNull(), F.sha2(reason, 256)).otherwise(F.col("file_hash")))
    else:
        nodes = nodes.withColumn("excluded_by", F.lit(None).cast("string"))
    kind = F.when(F.col("excluded_by").isNotNull(), "excluded").when(F.col("is_file"), "file").otherwise("dir")
    nodes = staged(nodes.withColumn("type", kind), "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    done = None
    below = None
    for depth in range(deepest, -1, -1):
        level = nodes.filter(F.col("depth") == depth).select("path", "parent", "name", "type", "file_hash") if depth else nodes.sparkSession.range(1).select(F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("name"), F.lit("dir").alias("type"), F.lit(None).cast("string").alias("file_hash"))
        if below is not None:
            children = below.groupBy(F.col("parent").alias("of")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "hash"))), lambda c: F.concat(c["name"], F.lit(":"), c["hash"])), "").alias("inside"))
            level = level.join(children, level["path"] == children["of"], "left").drop("of")
        else:
            level = level.withColumn("inside", F.lit(None).cast("string"))
        own = F.when(F.col("type") == "dir", F.sha2(F.coalesce("inside", F.lit("")), 256)).otherwise(F.col("file_hash"))
        below = staged(level.select("path", "parent", "name", "type", own.alias("hash")), "level")
        done = below if done is None else done.unionByName(below)
    return done.select("path", "type", "hash")


def tree_rows(files: DataFrame, dirs: DataFrame | None = None) -> DataFrame:
    """One row per node below the root: path, depth, name, is_last, line (as drawn, with its prefix) and sort key `place`. Directories come first, then by lower-case name."""
    nodes = path_nodes(files.select("file_path"))
    if dirs is not None:
        more = path_nodes(dirs.select("file_path")).withColumn("is_file", F.lit(False))
        nodes = nodes.unionByName(more).groupBy("path", "parent", "name", "depth").agg(F.min("is_file").alias("is_file"))
    order = [F.col("is_file"), F.lower("name"), F.col("name")]
    among = Window.partitionBy("parent")
    ranked = nodes.withColumn("nth", F.row_number().over(among.orderBy(*order))).withColumn("is_last", F.col("nth") == F.count(F.lit(1)).over(among))
    steps = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(F.split("path", "/"), 1, i), "/").alias("step")))
    walk = ranked.select("path", "depth", "name", "is_file", "is_last", F.explode(steps).alias("s")).select("*", "s.i", "s.step").drop("s")
    lookup = ranked.select(F.col("path").alias("step"), F.col("nth").alias("step_nth"), F.col("is_last").alias("step_last"))
    walk = walk.join(lookup, "step").groupBy("path", "depth", "name", "is_file", "is_last").agg(F.array_sort(F.collect_list(F.struct("i", "step_nth", "step_last"))).alias("w"))
    bar = F.array_join(F.transform(F.slice("w", 1, F.col("depth") - 1), lambda x: F.when(x["step_last"], "    ").otherwise("│   ")), "")
    line = F.concat(bar, F.when(F.col("is_last"), "└── ").otherwise("├── "), "name", F.when(F.col("is_file"), "").otherwise("/"))
    place = F.array_join(F.transform("w", lambda x: F.lpad(x["step_nth"].cast("string"), 9, "0")), "/")
    return walk.select("path", "depth", "name", "is_file", "is_last", line.alias("line"), place.alias("place"))


def tree_text(files: DataFrame, root: str, dirs: DataFrame | None = None) -> DataFrame:
    """One row (text): the drawn tree below its root's name; just "name/" for an empty tree."""
    rows = tree_rows(files, dirs)
    drawn = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return drawn.select(F.when(F.col("body") == "", F.lit(root + "/")).otherwise(F.concat(F.lit(root + "\n"), "body")).alias("text"))


def repository_stats(entities: DataFrame) -> DataFrame:
    """One row: files scanned, files that could be read as code, lines of their top entities, distinct languages in order. entities: as sources/code.py gives them."""
    top = F.col("parent").isNull()
    return entities.agg(
        F.countDistinct("file_path").alias("files_scanned"),
        F.countDistinct(F.when(F.col("parse_ok"), F.col("file_path"))).alias("files_processed"),
        F.coalesce(F.sum(F.when(top, F.col("end_line") - F.col("start_line") + 1)), F.lit(0)).alias("n_lines"),
        F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"),
    )
