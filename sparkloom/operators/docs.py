"""Documentation of a repository as markdown: statistics, tree, contents, one section per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunks, tree
from .components import staged


def file_sections(entities: DataFrame, level: int = chunks.DOCS) -> DataFrame:
    """(file_path, anchor, section): markdown of each file's entities at a level of detail, in preorder."""
    e = chunks.detail(entities, level).filter(~F.col("entity_type").isin("UNKNOWN", "IMPORT"))
    pad = F.repeat(F.lit("  "), F.col("depth"))
    title = F.concat(pad, F.lit("- **"), F.initcap(F.lower("entity_type")), F.lit("**: `"), F.coalesce("name", F.lit("")), F.lit("`"))
    lines = F.concat_ws("\n", title, F.when(F.col("signature") != "", F.concat(pad, F.lit("  `"), "signature", F.lit("`"))), F.when(F.coalesce("docstring", F.lit("")) != "", F.concat(pad, F.lit("  "), F.regexp_replace("docstring", "\n", "\n  "))), F.when(F.coalesce("content", F.lit("")) != "", F.concat(F.lit("\n```"), F.coalesce("language", F.lit("")), F.lit("\n"), "content", F.lit("\n```"))))
    g = e.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", lines.alias("text")))), lambda x: x["text"]), "\n").alias("body"))
    return g.select("file_path", T.anchor(F.col("file_path")).alias("anchor"), F.concat(F.lit("### "), "file_path", F.lit("\n\n"), "body").alias("section"))


def table_of_contents(sections: DataFrame) -> DataFrame:
    """(file_path, line) in path order."""
    return sections.select("file_path", F.concat(F.lit("- ["), "file_path", F.lit("](#"), "anchor", F.lit(")")).alias("line")).orderBy("file_path")


def document(entities: DataFrame, root: str, level: int = chunks.DOCS, drawing: DataFrame | None = None) -> DataFrame:
    """(part, place, line): the whole documentation as lines in order: header, statistics, directory tree, graph (drawing: one row with text), contents by path, a section per file."""
    entities = staged(entities, "entities")
    spark = entities.sparkSession
    stats = tree.repository_stats(entities)
    labels = {"files_scanned": "Files scanned", "files_processed": "Files processed", "n_lines": "Lines of code", "languages": "Languages"}
    files = entities.select("file_path").distinct()
    sections = file_sections(entities, level)

    def texts(part: int, rows: DataFrame, place: str, line: str) -> DataFrame:
        return rows.select(F.lit(part).alias("part"), F.col(place).cast("string").alias("place"), F.col(line).alias("line"))

    head = spark.createDataFrame([(0, "0", f"# Documentation of {root}"), (1, "", "## Statistics"), (2, "", "## Structure"), (2, "0", f"{root}/"), (4, "", "## Contents"), (5, "", "## Files")], "part int, place string, line string")
    facts = stats.select(F.explode(F.array(*[F.struct(F.lit(str(i)).alias("place"), F.concat(F.lit(f"- {label}: "), F.col(c).cast("string")).alias("line")) for i, (c, label) in enumerate(labels.items())])).alias("x")).select("x.*")
    out = head.unionByName(texts(1, facts, "place", "line")).unionByName(texts(2, tree.tree_rows(files), "place", "line"))
    if drawing is not None:
        out = out.unionByName(texts(3, drawing.select(F.lit("").alias("place"), F.concat(F.lit("```mermaid\n"), "text", F.lit("\n```")).alias("line")), "place", "line"))
    contents = sections.select("file_path", F.concat(F.lit("- ["), "file_path", F.lit("](#"), "anchor", F.lit(")")).alias("line"))
    return out.unionByName(texts(4, contents, "file_path", "line")).unionByName(texts(5, sections, "file_path", "section"))


def write_document(lines: DataFrame, folder: str, stamp: str) -> str:
    """Write the lines of `document` in order to documentation_<stamp>.md in the folder, as text files by range, and return the path."""
    path = f"{folder}/documentation_{stamp}.md"
    lines.repartitionByRange("part", "place").sortWithinPartitions("part", "place").select("line").write.text(path)
    return path


def write_documentation(sections: DataFrame, path: str) -> None:
    """Write the sections as text files in path order, one part per range of paths."""
    sections.repartitionByRange("file_path").sortWithinPartitions("file_path").select("section").write.mode("overwrite").text(path)
