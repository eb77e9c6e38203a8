"""Files written and listed, script entities, incremental parsing and exclusive triggers over texts built from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import chunks, components, diffs, docs
from ..sources import code
from ..streaming import exclusive, watch
from .code_queries import _sources
from .tables import table


def _folder(spark) -> str:
    return f"{components.staging_folder(spark)}/made-{uuid.uuid4().hex}"


def file_listing(spark, sf_dir):
    """The lines of a section for each document, written as text files below two folders and found again by listing."""
    folder = _folder(spark)
    d = table(spark, sf_dir, "documents")
    for half in (0, 1):
        own = d.filter(F.col("doc_id") % 2 == half)
        docs.write_documentation(own.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"), F.concat(F.lit("### "), "doc_id", F.lit("\n\n- "), "lang").alias("section")), f"{folder}/deep/half{half}")
    found = code.files(spark, folder).filter("ext = '.txt' AND NOT is_binary")
    lines = found.select(F.regexp_extract("file_path", r"(half\d)/[^/]*$", 1).alias("folder"), F.explode(F.split("content", "\n")).alias("line")).filter("line <> ''")
    return lines.groupBy("folder", "line").agg(F.count(F.lit(1)).alias("n"))


def whole_file_limit(spark, sf_dir):
    """Files of 990 lines and more: those below the limit are a chunk, longer ones are not."""
    n = F.col("n_nationkey") + 987
    body = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n")
    f = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey", F.lit(".txt")).alias("file_path"), body.alias("content"))
    return chunks.chunked(f, code.entities(f)).filter("metadata.entity_type = 'FILE'").select("file_path", F.col("metadata.end_line").alias("end_line"), F.sha2("content", 256).alias("text_sha"))


_TS = """import {{ a }} from './m{0}';

export interface Shape{0}<T> {{
  area(x: T): number;
}}

type Name{0} = string | 'p';

/** Box of things. */
export class Box{0}<T extends Shape{0}<number>> extends Base {{
  size(n: number): string {{
    return `a ${{n > 1 ? `b ${{n}}` : '}}'}} c`;
  }}
}}

export const make{0} = (x: number): Box{0} => {{
  return build(x);
}};
"""
_JS = """import fs from 'fs';

function load{0}(path) {{
  return `x ${{read(path)}} {{`;
}}

class Store{0} extends Base {{
  get(key) {{
    return /[{{/]/.test(key);
  }}
}}

const LIMIT_{0} = 3;

describe('store', () => {{
  it('works', () => {{
    load{0}('}}');
  }});
}});
"""
#: (kind, name with {0} for the document, parent, first line, last line) of the entities of the two sources, in order.
_OF_TS = [("IMPORT", "", 0, 1, 1), ("INTERFACE", "Shape{0}", 0, 3, 5), ("TYPE_ALIAS", "Name{0}", 0, 7, 7), ("CLASS", "Box{0}", 0, 10, 14), ("METHOD", "size", 4, 11, 13), ("FUNCTION", "make{0}", 0, 16, 18)]
_OF_JS = [("IMPORT", "", 0, 1, 1), ("FUNCTION", "load{0}", 0, 3, 5), ("CLASS", "Store{0}", 0, 7, 11), ("METHOD", "get", 3, 8, 10), ("CONSTANT", "LIMIT_{0}", 0, 13, 13), ("TEST_SUITE", "describe", 0, 15, 19), ("TEST_CASE", "", 6, 16, 18)]


def script_entities(spark, sf_dir):
    """A JavaScript or TypeScript file for each document, with nested templates, generics, arrow functions and a pattern that holds a brace."""
    def filled(text: str):
        parts = [F.lit(p.replace("{{", "{").replace("}}", "}")) for p in text.split("{0}")]
        out = [parts[0]]
        for p in parts[1:]:
            out += [F.col("doc_id").cast("string"), p]
        return F.concat(*out)

    ts = F.col("doc_id") % 2 == 0
    f = table(spark, sf_dir, "documents").select(F.concat(F.lit("web/d"), "doc_id", F.when(ts, ".ts").otherwise(".js")).alias("file_path"), F.when(ts, filled(_TS)).otherwise(filled(_JS)).alias("content"))
    return code.entities(f).select("file_path", "ord", "parent", "entity_type", "name", "start_line", "end_line")


def incremental_entities(spark, sf_dir):
    """Two loads: of the second, files with a new line are parsed, others keep their entities, and every eleventh is gone."""
    first = _sources(spark, sf_dir)
    known = components.staged(code.incremental(first), "known")
    number = F.regexp_extract("file_path", r"d(\d+)\.py$", 1).cast("long")
    second = first.filter(number % 11 != 0).withColumn("content", F.when(number % 5 == 0, F.concat("content", F.lit("\n\nEXTRA = 1\n"))).otherwise(F.col("content")))
    e = code.incremental(second, known)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ",")
    return e.groupBy("file_path", "parsed").agg(F.count(F.lit(1)).alias("n_entities"), names.alias("names"))


def exclusive_triggers(spark, sf_dir):
    """Every event triggers a synchronisation of one of 20 repositories, which takes two hours; the stream tells which ran."""
    source = table(spark, sf_dir, "events")
    folder = _folder(spark)
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    triggers = watch.changes(stream.withColumn("is_directory", F.col("event_id") % 9 == 0)).select((F.col("user_id") % 20).alias("repository"), F.col("ts").cast("timestamp").alias("moment"))
    out = exclusive.exclusive(triggers, "repository", "moment", 7200)
    query = out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select("repository", F.unix_micros("moment").alias("moment"), "ran")


def split_driver(spark, sf_dir):
    """For each document a diff with a moved file, a Python file of two sections, a file above the limit, one that the diff doesn't hold, and for every fourth document nine more."""
    k = F.col("doc_id").cast("string")

    def change(old: str, new: str, *hunks: str):
        return F.concat(F.lit(f"diff --git a/{old} b/{new}\n--- a/{old}\n+++ b/{new}"), *[x for h in hunks for x in (F.lit("\n@@ -1 +1 @@\n"), F.lit(h), k)], F.lit("\n"))

    many = [change(f"m/{i}.md", f"m/{i}.md", "+") for i in range(9)]
    few = [change("old/a.txt", "new/a.txt", "-", "+"), change("x.py", "x.py", "+import a", " y", "+def f"), change("big.txt", "big.txt", "+" + "a" * 400, "+" + "b" * 400)]
    d = table(spark, sf_dir, "documents")
    rest = F.col("doc_id") % 4 == 0
    content = F.concat(*few, F.when(rest, F.concat(*many)).otherwise(""))
    names = F.concat(F.array(*[F.lit(x) for x in ("old/a.txt", "new/a.txt", "x.py", "big.txt", "u.txt")]), F.when(rest, F.array(*[F.lit(f"m/{i}.md") for i in range(9)])).otherwise(F.array().cast("array<string>")))
    files = d.select(F.col("doc_id").alias("diff_id"), F.posexplode(names).alias("nth", "file_path"))
    moved = d.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("diff_id"), F.lit("old/a.txt").alias("source"), F.lit("new/a.txt").alias("target"))
    out = diffs.split_whole(d.select(F.col("doc_id").alias("diff_id"), content.alias("content")), files, moved, 500)
    return out.select("diff_id", "kind", "batch", "file_path", F.col("part").cast("long").alias("part"), F.array_join("files", ",").alias("files"), F.sha2("content", 256).alias("content_sha"), "description")


def _rows_sql(suffix: str, rows: list[tuple]) -> str:
    values = ", ".join(f"({i}, {'NULL' if parent is None else parent}, '{kind}', '{name}', {a}, {b})" for i, (kind, name, parent, a, b) in enumerate(rows))
    odd = 0 if suffix == ".ts" else 1
    return f"""SELECT concat('web/d', doc_id, '{suffix}') AS file_path, ord, parent, kind AS entity_type, replace(name, '{{0}}', doc_id::varchar) AS name, a AS start_line, b AS end_line
FROM documents, (VALUES {values}) t(ord, parent, kind, name, a, b) WHERE doc_id % 2 = {odd}"""


QUERIES = {f.__name__: f for f in (file_listing, whole_file_limit, script_entities, incremental_entities, exclusive_triggers, split_driver)}
SQL = {
    "file_listing": """
SELECT folder, line, count(*) AS n FROM (SELECT concat('half', doc_id % 2) AS folder, unnest([concat('### ', doc_id), concat('- ', lang)]) AS line FROM documents) GROUP BY ALL""",
    "whole_file_limit": """
WITH f AS (SELECT concat('n', n_nationkey, '.txt') AS file_path, n_nationkey + 987 AS n FROM nation),
b AS (SELECT file_path, n, string_agg(concat('line ', i), chr(10) ORDER BY i) AS body FROM f, range(1, 1012) r(i) WHERE i <= n GROUP BY ALL)
SELECT file_path, n::int AS end_line, sha256(concat('Type: FILE', chr(10), chr(10), 'Path: ', file_path, chr(10), chr(10), 'Name: ', file_path, chr(10), chr(10), 'Code:', chr(10), '```unknown', chr(10), body, chr(10), '```')) AS text_sha FROM b WHERE n < 1000""",
    "script_entities": _rows_sql(".ts", [("MODULE", "d{0}", None, 1, 18), *_OF_TS]) + "\nUNION ALL " + _rows_sql(".js", [("MODULE", "d{0}", None, 1, 19), *_OF_JS]),
    "incremental_entities": """
SELECT concat(source, '/', lang, '/d', doc_id, '.py') AS file_path, doc_id % 5 = 0 AS parsed, CASE WHEN doc_id % 5 = 0 THEN 8 ELSE 7 END::bigint AS n_entities,
  concat('d', doc_id, ',,,LIMIT_', doc_id, ',C', doc_id, ',m', doc_id % 5, ',f', doc_id % 7, CASE WHEN doc_id % 5 = 0 THEN ',EXTRA' ELSE '' END) AS names
FROM documents WHERE doc_id % 11 <> 0""",
    "split_driver": """
WITH k AS (SELECT doc_id, doc_id % 3 = 0 AS moved, doc_id % 4 = 0 AS many, chr(10) AS n, concat(chr(10), '@@ -1 +1 @@', chr(10)) AS h FROM documents),
f AS (
  SELECT *, 'hunk' AS kind, unnest([1, 2]) AS part, 'new/a.txt' AS file_path, 'diff --git a/old/a.txt b/new/a.txt' AS head, '--- a/old/a.txt' AS minus, unnest(['-', '+']) AS body FROM k WHERE NOT moved
  UNION ALL SELECT *, 'large', unnest([1, 2]), 'big.txt', NULL, NULL, unnest([concat('+', repeat('a', 400)), concat('+', repeat('b', 400))]) FROM k
  UNION ALL SELECT *, 'section', unnest([1, 2]), 'x.py', NULL, NULL, unnest([concat('+import a', doc_id, h, ' y'), '+def f']) FROM k
  UNION ALL SELECT *, 'hunk', 1, concat('m/', unnest(range(9)), '.md'), NULL, NULL, '+' FROM k WHERE many),
t AS (
  SELECT doc_id, many, kind, file_path, part, concat(coalesce(head, concat('diff --git a/', file_path, ' b/', file_path)), n, coalesce(minus, concat('--- a/', file_path)), n, '+++ b/', file_path, h, body, doc_id) AS content FROM f
  UNION ALL SELECT doc_id, many, 'missing', 'u.txt', 1, '' FROM k
  UNION ALL SELECT doc_id, many, 'missing', 'old/a.txt', 1, '' FROM k WHERE NOT moved)
SELECT doc_id AS diff_id, kind, CASE WHEN NOT many THEN 'all' WHEN contains(file_path, '/') THEN concat(split_part(file_path, '/', 1), '#', CASE WHEN file_path LIKE 'm/%' THEN file_path[3:3]::int // 3 ELSE 0 END) ELSE '#0' END AS batch,
  file_path, part::bigint AS part, file_path AS files, sha256(content) AS content_sha, concat('Changes in ', file_path) AS description FROM t
UNION ALL SELECT doc_id, 'move', NULL, NULL, 1, 'old/a.txt,new/a.txt', sha256(concat('diff --git a/old/a.txt b/new/a.txt', n, '--- a/old/a.txt', n, '+++ b/new/a.txt', h, '-', doc_id, h, '+', doc_id, n, n)), 'chore: move a.txt from old to new' FROM k WHERE moved""",
    "exclusive_triggers": """
WITH RECURSIVE e AS (SELECT user_id % 20 AS repository, epoch_us(ts::timestamp) AS moment FROM events WHERE event_id % 9 <> 0),
r AS (
  SELECT repository, min(moment) AS moment FROM e GROUP BY 1
  UNION ALL SELECT r.repository, (SELECT min(e.moment) FROM e WHERE e.repository = r.repository AND e.moment >= r.moment + 7200000000) FROM r WHERE r.moment IS NOT NULL)
SELECT e.repository, e.moment, r.moment IS NOT NULL AND row_number() OVER (PARTITION BY e.repository, e.moment) = 1 AS ran FROM e LEFT JOIN r ON r.repository = e.repository AND r.moment = e.moment""",
}
