"""Levels of detail and chunks of code entities (see sources/code.py for their columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .components import staged

SIGNATURES, STRUCTURE, DOCS, FULL = 1, 2, 3, 4
PRIMARY, SECONDARY = ["MODULE", "CLASS", "INTERFACE", "STRUCT"], ["FUNCTION", "METHOD"]
#: Depth of the overview in a chunk, and lines from which a file has no chunk of its own.
OVERVIEW_DEPTH, MAX_FILE_LINES = 2, 1000


def signature(content: Column, kind: Column) -> Column:
    """First line of functions, methods, classes and interfaces without colons and braces at its end; empty for others."""
    line = F.regexp_replace(F.element_at(F.split(content, "\n"), 1), r"[:{]+$", "")
    return F.when(kind.isin("FUNCTION", "METHOD", "CLASS", "INTERFACE"), line).otherwise("")


def detail(entities: DataFrame, level: int) -> DataFrame:
    """Entities with signature always, docstring from DOCS on, content when FULL or a comment; columns that are not asked for are never read."""
    kind = F.col("entity_type")
    return entities.select(
        "file_path", "ord", "parent", "depth", "entity_type", "name", "start_line", "end_line", "language", "hierarchy_path", "dependencies", "calls",
        signature(F.col("content"), kind).alias("signature"),
        (F.col("docstring") if level >= DOCS else F.lit(None).cast("string")).alias("docstring"),
        (F.col("content") if level >= FULL else F.when(kind == "COMMENT", F.col("content"))).alias("content"),
    )


def _known(entities: DataFrame) -> DataFrame:
    """Entities outside UNKNOWN subtrees: an UNKNOWN one hides what its path begins with."""
    hidden = entities.filter("entity_type = 'UNKNOWN'").select(F.col("file_path").alias("f"), F.col("hierarchy_path").alias("h"))
    under = (F.col("file_path") == F.col("f")) & ((F.col("hierarchy_path") == F.col("h")) | F.startswith("hierarchy_path", F.concat("h", F.lit("."))))
    return entities.join(hidden, under, "left_anti")


def overview(entities: DataFrame, depth: int = OVERVIEW_DEPTH) -> DataFrame:
    """(file_path, ord, contains): lines about the entities up to `depth` below each one, in preorder."""
    e = _known(entities).select("file_path", "ord", "parent", "entity_type", "name", "start_line", "end_line", signature(F.col("content"), F.col("entity_type")).alias("signature"))
    step = e.select("file_path", F.col("parent").alias("of"), "ord", "entity_type", "name", "start_line", "end_line", "signature").filter("of IS NOT NULL").withColumn("below", F.lit(1))
    found, last = step, step
    for d in range(2, depth + 1):
        up = e.select("file_path", F.col("ord").alias("of"), F.col("parent").alias("next"))
        last = last.join(up, ["file_path", "of"]).filter("next IS NOT NULL").drop("of").withColumnRenamed("next", "of").withColumn("below", F.lit(d))
        found = found.unionByName(last)
    name = F.when(F.col("name") != "", F.col("name")).otherwise(F.concat(F.lit("<"), F.lower("entity_type"), F.lit(">")))
    line = F.concat(F.repeat(F.lit("  "), F.col("below")), F.lit("- "), "entity_type", F.lit(": "), name, F.lit(" "), "signature", F.lit(" (lines "), "start_line", F.lit("-"), "end_line", F.lit(")"))
    g = found.groupBy("file_path", F.col("of").alias("ord")).agg(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("o"), line.alias("line")))).alias("c"))
    return g.select("file_path", "ord", F.transform("c", lambda x: x["line"]).alias("contains"))


def chunked(files: DataFrame, entities: DataFrame, max_lines: int = MAX_FILE_LINES) -> DataFrame:
    """Chunks (file_path, place, content, content_hash, metadata) of files: the whole file where it is shorter than max_lines, then one per chunkable entity in preorder."""
    entities = staged(entities, "entities")  # read several times below, parsed once
    f = files.withColumn("file_content_hash", T.content_hash(F.col("content"))).withColumn("language", F.coalesce(T.language_of(F.col("file_path")), F.lit("unknown")))
    body = F.col("content")
    name = T.base_name(F.col("file_path"))
    whole = f.filter(F.size(T.lines(body)) < max_lines).select(
        "file_path", F.lit(-1).alias("place"), "file_content_hash", "language", F.lit("FILE").alias("entity_type"), name.alias("entity_name"), F.lit("").alias("hierarchy_path"), F.lit(1).alias("start_line"), F.greatest(F.size(T.lines(body)), F.lit(1)).alias("end_line"),
        F.concat_ws("\n\n", F.lit("Type: FILE"), F.concat(F.lit("Path: "), "file_path"), F.concat(F.lit("Name: "), name), F.concat(F.lit("Code:\n```"), "language", F.lit("\n"), body, F.lit("\n```"))).alias("text"),
    )
    e = _known(entities).filter(F.col("entity_type").isin(PRIMARY + SECONDARY) & (F.coalesce(F.col("content"), F.lit("")) != ""))
    e = e.join(overview(entities), ["file_path", "ord"], "left").join(f.select("file_path", "file_content_hash", F.col("language").alias("lang")), "file_path")
    sign = signature(F.col("content"), F.col("entity_type"))
    second = F.col("entity_type").isin(SECONDARY)
    head = F.concat(F.when(second, F.concat(F.lit("File: "), F.regexp_replace(T.base_name(F.col("file_path")), r"\.[^.]*$", ""), F.lit("\n"))).otherwise(""), F.lit("Type: "), "entity_type")
    some = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    text = F.concat_ws(
        "\n\n", head, F.concat(F.lit("Path: "), "hierarchy_path"), some("Name: ", F.col("name")), some("Signature: ", sign), some("Docstring:\n", F.col("docstring")),
        F.when(~second & (F.size("contains") > 0), F.concat(F.lit("Contains:\n\n"), F.array_join("contains", "\n\n"))),
        F.concat(F.lit("Code:\n```"), "lang", F.lit("\n"), "content", F.lit("\n```")), F.concat(F.lit("Raw:\n"), "content"),
    )
    own = e.select("file_path", F.col("ord").alias("place"), "file_content_hash", F.col("lang").alias("language"), "entity_type", F.col("name").alias("entity_name"), "hierarchy_path", "start_line", "end_line", text.alias("text"))
    rows = whole.unionByName(own)
    key = F.sha2(F.concat_ws("|", "file_path", "hierarchy_path", "start_line", "entity_type"), 256)
    hashed = T.content_hash(F.col("text"))
    return rows.select(
        "file_path", "place", F.col("text").alias("content"), hashed.alias("content_hash"),
        F.struct(key.alias("chunk_id"), hashed.alias("content_hash"), "start_line", "end_line", "entity_type", "entity_name", "hierarchy_path", F.struct("file_path", "language", "file_content_hash").alias("file_metadata")).alias("metadata"),
    )


def resolved_paths(names: DataFrame, known: DataFrame) -> DataFrame:
    """(path, resolved): a path among the known ones (path) as it is, else the known path of the same file name that agrees with it in most character positions."""
    k = known.select(F.col("path").alias("known_path"), T.base_name(F.col("path")).alias("name"))
    n = names.select("path", T.base_name(F.col("path")).alias("name")).distinct()
    same = F.size(F.filter(F.zip_with(F.split("path", ""), F.split("known_path", ""), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    scored = n.join(k, "name", "left").withColumn("score", F.when(F.col("path") == F.col("known_path"), 2**30).otherwise(same))
    row = F.row_number().over(Window.partitionBy("path").orderBy(F.desc_nulls_last("score"), "known_path"))
    return scored.withColumn("n", row).filter("n = 1").select("path", F.col("known_path").alias("resolved"))


def priority(files: Column, content: Column) -> Column:
    """0.6 for a code file, 0.2 each for up to 3 files and 1000 characters."""
    code = F.exists(files, lambda f: F.regexp_like(f, F.lit(r"\.(py|js|ts|java|c|cpp|go)$")))
    return F.when(code, 0.6).otherwise(0.0) + F.least(F.size(files), F.lit(3)) / 3 * 0.2 + F.least(F.length(content), F.lit(1000)) / 1000 * 0.2


def prioritized(chunks: DataFrame, most: int) -> DataFrame:
    """The `most` chunks (ord, files, content) of highest priority: 0.6 for a code file, 0.2 each for up to 3 files and 1000 characters; ties keep their order."""
    return chunks.withColumn("priority", priority(F.col("files"), F.col("content"))).orderBy(F.desc("priority"), "ord").limit(most)


def fitted_context(structure: Column, signatures: Column, max_tokens: int = 4000) -> Column:
    """The fuller rendering if its token estimate fits, else the shorter one."""
    return F.when(T.token_estimate(structure) <= max_tokens, structure).otherwise(signatures)


#: Chunks up to which no levels are needed, most chunks of a context, and tokens that a chunk is taken to need.
SIMPLE_CHUNKS, MOST_CHUNKS, CHUNK_TOKENS = 3, 6, 500


def context_levels(chunks: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """(change_id, context, level) of chunks (change_id, ord, files, content, structure, signatures), one row a change.

    Up to SIMPLE_CHUNKS chunks are taken as they are (level plain). Else the
    min(max_tokens / CHUNK_TOKENS, MOST_CHUNKS) of highest priority are
    rendered by structure, or by signatures where that exceeds the tokens; what
    still exceeds them is cut.
    """
    most = min(max_tokens // CHUNK_TOKENS, MOST_CHUNKS)
    c = chunks.withColumn("priority", priority(F.col("files"), F.col("content"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("change_id")))
    c = c.withColumn("nth", F.row_number().over(Window.partitionBy("change_id").orderBy(F.when(F.col("n") > SIMPLE_CHUNKS, -F.col("priority")).otherwise(0.0), "ord")))
    c = c.filter((F.col("n") <= SIMPLE_CHUNKS) | (F.col("nth") <= most))
    text = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col(name).alias("text")))), lambda x: x["text"]), "\n\n")
    g = c.groupBy("change_id").agg(F.first("n").alias("n"), text("content").alias("plain"), text("structure").alias("structure"), text("signatures").alias("signatures"))
    full = T.token_estimate(F.col("structure")) <= max_tokens
    level = F.when(F.col("n") <= SIMPLE_CHUNKS, "plain").when(full, "structure").otherwise("signatures")
    out = F.when(F.col("n") <= SIMPLE_CHUNKS, F.col("plain")).otherwise(F.when(full, F.col("structure")).otherwise(F.substring("signatures", 1, 4 * max_tokens)))
    return g.select("change_id", out.alias("context"), level.alias("level"))


def entity_markdown(content: Column, kind: Column, name: Column, sign: Column, docstring: Column, language: Column) -> Column:
    """An entity as markdown: heading, signature or code in a fence, docstring."""
    code = F.coalesce(F.when(content != "", content), F.when(sign != "", sign))
    return F.concat_ws("\n\n", F.concat(F.lit("### "), F.initcap(F.lower(kind)), F.lit(": `"), F.coalesce(name, F.lit("")), F.lit("`")), docstring, F.concat(F.lit("```"), F.coalesce(language, F.lit("")), F.lit("\n"), code, F.lit("\n```")))
