"""Code entities, graphs, chunk priorities, embeddings and change streams over sources and paths built from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, clusters, components, docs, embed, graph, search
from ..sources import code
from ..streaming import watch
from .tables import table


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small Python file for each document."""
    content = F.concat(
        F.lit("import os\nfrom a.b import c\n\n\nLIMIT_"), "doc_id", F.lit(" = "), "n_chars", F.lit("\n\n\nclass C"), "doc_id", F.lit(':\n    """Doc in '), "lang",
        F.lit('."""\n\n    def m'), F.col("doc_id") % 5, F.lit("(self):\n        return f"), F.col("doc_id") % 7, F.lit("()\n\n\ndef f"), F.col("doc_id") % 7, F.lit("(x):\n    return C"), "doc_id", F.lit("().m"), F.col("doc_id") % 5, F.lit("()\n"),
    )
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), "doc_id", F.lit(".py"))).alias("file_path"), content.alias("content"))


_F = """f AS (SELECT doc_id, n_chars, lang, concat(source, '/', lang, '/d', doc_id, '.py') AS file_path, concat('d', doc_id) AS stem, concat('C', doc_id) AS c, concat('m', doc_id % 5) AS m, concat('f', doc_id % 7) AS fn FROM documents),
e AS (
  SELECT file_path, 0 AS ord, NULL AS parent, 'MODULE' AS entity_type, stem AS name, 1 AS start_line, 16 AS end_line, '' AS signature, NULL AS docstring FROM f
  UNION ALL SELECT file_path, 1, 0, 'IMPORT', '', 1, 1, '', NULL FROM f
  UNION ALL SELECT file_path, 2, 0, 'IMPORT', '', 2, 2, '', NULL FROM f
  UNION ALL SELECT file_path, 3, 0, 'CONSTANT', concat('LIMIT_', doc_id), 5, 5, '', NULL FROM f
  UNION ALL SELECT file_path, 4, 0, 'CLASS', c, 8, 12, concat('class ', c), concat('Doc in ', lang, '.') FROM f
  UNION ALL SELECT file_path, 5, 4, 'METHOD', m, 11, 12, concat('    def ', m, '(self)'), NULL FROM f
  UNION ALL SELECT file_path, 6, 0, 'FUNCTION', fn, 15, 16, concat('def ', fn, '(x)'), NULL FROM f)"""


def entity_rows(spark, sf_dir):
    e = code.entities(_sources(spark, sf_dir))
    return chunks.detail(e, chunks.DOCS).select("file_path", "ord", "parent", "entity_type", "name", "start_line", "end_line", "signature", "docstring")


def chunk_rows(spark, sf_dir):
    f = _sources(spark, sf_dir)
    c = chunks.chunked(f, code.entities(f))
    return c.select("file_path", "place", "metadata.entity_type", "metadata.hierarchy_path", "metadata.start_line", "metadata.end_line", F.when(F.col("metadata.entity_type").isin("FUNCTION", "FILE"), F.col("content_hash")).alias("content_hash"))


def entity_edges(spark, sf_dir):
    return graph.edge_counts(code.entities(_sources(spark, sf_dir)))


def doc_sections(spark, sf_dir):
    s = docs.file_sections(code.entities(_sources(spark, sf_dir)), chunks.SIGNATURES)
    return s.select("file_path", "anchor", F.length("section").cast("long").alias("size"))


def call_edges(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("s"), F.col("s_nationkey") % 10, F.when(F.col("s_suppkey") % 4 == 0, F.lit(".x")).otherwise("")).alias("name"))
    own = F.concat(F.lit("s"), F.col("c_nationkey") % 12)
    calls = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 300).alias("src"), F.when(F.col("c_custkey") % 3 == 0, own).when(F.col("c_custkey") % 3 == 1, F.concat(own, F.lit(".x"))).otherwise(F.concat(F.lit("m.q."), own)).alias("called"))
    return graph.call_edges(calls, names)


def import_edges(spark, sf_dir):
    paths = table(spark, sf_dir, "region").select(F.lower(F.substring("r_name", 1, 2)).alias("path"))
    imports = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("src"), F.concat(F.when(F.col("n_nationkey") % 4 == 0, ".").otherwise(""), F.lower("n_name"), F.lit(".pkg")).alias("dependency"))
    return graph.import_edges(imports, paths)


def chunk_priority(spark, sf_dir):
    exts = F.array(*[F.lit(x) for x in (".py", ".md", ".go")])
    files = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int")), lambda i: F.concat(F.lit("f"), i, F.get(exts, ((F.col("doc_id") + i) % 3).cast("int"))))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), files.alias("files"), F.col("text").alias("content"))
    return chunks.prioritized(d, 50).select("ord", F.round("priority", 9).alias("priority"))


def debounce_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return watch.debounced(e, "30 minutes", "user_id").select("user_id", F.unix_seconds("started").alias("started"), F.unix_seconds("last").alias("last"), "n_events")


def debounce_stream(spark, sf_dir):
    """The finished sessions that the streaming form gives out over the same events, read back from its sink."""
    source = table(spark, sf_dir, "events")
    folder = f"{components.staging_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    out = watch.debounced(stream, "30 minutes", "user_id", late="1 hour").select("user_id", "n_events", "last")
    query = out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("user_id long, n_events long, last timestamp").parquet(f"{folder}/out").select("user_id", "n_events", F.unix_seconds("last").alias("last"))


def related_files(spark, sf_dir):
    """All pairs of one path for each nation (a table of 25 rows)."""
    shapes = F.array(*[F.lit(x) for x in ("src/a{}.py", "tests/test_a{}.py", "package{}.json", "docs/n{}.md", "lib/x/y{}.rb")])
    p = table(spark, sf_dir, "nation").select("n_nationkey", F.replace(F.get(shapes, (F.col("n_nationkey") % 5).cast("int")), F.lit("{}"), (F.col("n_nationkey") % 3).cast("string")).alias("path"))
    a, b = p.select(F.col("n_nationkey").alias("a"), F.col("path").alias("pa")), F.broadcast(p.select(F.col("n_nationkey").alias("b"), F.col("path").alias("pb")))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", clusters.test_names_match(F.element_at(F.split("pa", "/"), -1), F.element_at(F.split("pb", "/"), -1)).alias("test_pair"), clusters.related(F.col("pa"), F.col("pb")).alias("related"))


def token_vectors(spark, sf_dir):
    b = embed.token_buckets(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return b.select("id", "bucket", F.round("value", 9).alias("value"))


def leader_clusters(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return clusters.leader_clusters(p, "label", 0.2)


def linkage_clusters(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return clusters.linkage_clusters(p, "label", threshold=0.7)


def context_pack(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    top = search.top_k(p, p.filter("id = 0").select("vector").first()[0], 10)
    ranked = top.select(F.col("id").cast("string").alias("file_path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.col("id").alias("rank"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content"))
    c = search.context(ranked, files, limit=600, suffix="...")
    return c.select("rank", F.sha2("code", 256).alias("code_hash"))


QUERIES = {f.__name__: f for f in (entity_rows, chunk_rows, entity_edges, doc_sections, call_edges, import_edges, chunk_priority, debounce_sessions, debounce_stream, related_files, token_vectors, leader_clusters, linkage_clusters, context_pack)}
SQL = {
    "entity_rows": f"WITH {_F} SELECT file_path, ord, parent, entity_type, name, start_line, end_line, signature, docstring FROM e",
    "chunk_rows": f"""WITH {_F},
code AS (SELECT *, concat('def ', fn, '(x):', chr(10), '    return ', c, '().', m, '()') AS body,
  concat('import os', chr(10), 'from a.b import c', chr(10), chr(10), chr(10), 'LIMIT_', doc_id, ' = ', n_chars, chr(10), chr(10), chr(10), 'class ', c, ':', chr(10), '    \"\"\"Doc in ', lang, '.\"\"\"', chr(10), chr(10), '    def ', m, '(self):', chr(10), '        return ', fn, '()', chr(10), chr(10), chr(10), 'def ', fn, '(x):', chr(10), '    return ', c, '().', m, '()', chr(10)) AS text FROM f)
SELECT e.file_path, e.ord AS place, e.entity_type, CASE e.entity_type WHEN 'MODULE' THEN f.stem WHEN 'METHOD' THEN concat(f.stem, '.', f.c, '.', f.m) ELSE concat(f.stem, '.', e.name) END AS hierarchy_path, start_line, end_line,
  CASE WHEN e.entity_type = 'FUNCTION' THEN sha256(concat('File: ', f.stem, chr(10), 'Type: FUNCTION', chr(10), chr(10), 'Path: ', f.stem, '.', f.fn, chr(10), chr(10), 'Name: ', f.fn, chr(10), chr(10), 'Signature: ', e.signature, chr(10), chr(10), 'Code:', chr(10), '```python', chr(10), body, chr(10), '```', chr(10), chr(10), 'Raw:', chr(10), body)) END AS content_hash
FROM e JOIN code f ON e.file_path = f.file_path WHERE entity_type IN ('MODULE', 'CLASS', 'METHOD', 'FUNCTION')
UNION ALL SELECT file_path, -1, 'FILE', '', 1, 16, sha256(concat('Type: FILE', chr(10), chr(10), 'Path: ', file_path, chr(10), chr(10), 'Name: ', stem, '.py', chr(10), chr(10), 'Code:', chr(10), '```python', chr(10), text, chr(10), '```')) FROM code""",
    "entity_edges": """
WITH f AS (SELECT doc_id, doc_id % 7 AS k, doc_id % 5 AS m FROM documents),
c AS (SELECT a.doc_id AS src, 'm' AS side, b.doc_id AS dst FROM f a JOIN f b ON a.k = b.k UNION ALL SELECT a.doc_id, 'f', b.doc_id FROM f a JOIN f b ON a.m = b.m)
SELECT 'call' AS type, count(*) AS n_edges, count(DISTINCT concat(src, side)) AS n_sources FROM c
UNION ALL SELECT 'declare', count(*) * 4, count(*) * 2 FROM f
UNION ALL SELECT 'import', count(*) * 2, count(*) FROM f""",
    "doc_sections": f"""WITH {_F},
l AS (SELECT file_path, ord, CASE entity_type WHEN 'MODULE' THEN 0 WHEN 'METHOD' THEN 2 ELSE 1 END AS d, entity_type, name, signature FROM e WHERE entity_type <> 'IMPORT'),
t AS (SELECT file_path, sum(d * 2 + length('- **') + length(entity_type) + length('**: `') + length(name) + 1 + CASE WHEN signature <> '' THEN 1 + d * 2 + 3 + length(signature) + 1 ELSE 0 END + 1) - 1 AS body FROM l GROUP BY 1)
SELECT f.file_path, concat(lang, '-', stem, 'py') AS anchor, (length(concat('### ', f.file_path, chr(10), chr(10))) + body)::bigint AS size FROM f JOIN t ON t.file_path = f.file_path""",
    "call_edges": """
WITH n AS (SELECT s_suppkey AS id, concat('s', s_nationkey % 10, CASE WHEN s_suppkey % 4 = 0 THEN '.x' ELSE '' END) AS name FROM supplier),
c AS (SELECT DISTINCT c_custkey % 300 AS src, CASE c_custkey % 3 WHEN 0 THEN concat('s', c_nationkey % 12) WHEN 1 THEN concat('s', c_nationkey % 12, '.x') ELSE concat('m.q.s', c_nationkey % 12) END AS called FROM customer)
SELECT DISTINCT src, id AS dst FROM (
  SELECT src, id FROM c JOIN n ON called = name
  UNION ALL SELECT src, id FROM c JOIN n ON regexp_extract(called, '[^.]*$') = name WHERE called NOT IN (SELECT name FROM n)) WHERE src <> id""",
    "import_edges": """
WITH i AS (SELECT DISTINCT n_regionkey AS src, concat(CASE WHEN n_nationkey % 4 = 0 THEN '.' ELSE '' END, lower(n_name), '.pkg') AS dependency FROM nation)
SELECT src, dependency, NOT starts_with(dependency, '.') AND NOT EXISTS (SELECT 1 FROM region WHERE starts_with(dependency, lower(left(r_name, 2)))) AS is_external FROM i""",
    "chunk_priority": """
WITH d AS (SELECT doc_id AS ord, len(text) AS size, doc_id % 4 + 1 AS n, list_bool_or([(doc_id + i) % 3 <> 1 FOR i IN range(doc_id % 4 + 1)]) AS code FROM documents),
p AS (SELECT ord, CASE WHEN code THEN 0.6::double ELSE 0.0::double END + least(n, 3)::double / 3 * 0.2::double + least(size, 1000)::double / 1000 * 0.2::double AS priority FROM d)
SELECT ord, round(priority, 9) AS priority FROM p ORDER BY p.priority DESC, ord LIMIT 50""",
    "debounce_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, floor(epoch(min(ts)))::bigint AS started, floor(epoch(max(ts)))::bigint AS last, count(*) AS n_events FROM s GROUP BY user_id, k""",
    "debounce_stream": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS n_events, floor(epoch(max(ts)))::bigint AS last FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "token_vectors": r"""
WITH t AS (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '\w+')) AS t FROM benchmark),
n AS (SELECT id, (concat('0x', left(sha256(t), 8))::bigint % 256)::int AS bucket, count(*) AS n FROM t GROUP BY 1, 2)
SELECT id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 9) AS value FROM n""",
    "context_pack": """
WITH q AS (SELECT embedding::double[] AS v FROM embeddings WHERE vec_id = 0),
top AS (SELECT vec_id AS rank FROM embeddings, q ORDER BY list_cosine_similarity(embedding::double[], v) DESC, vec_id LIMIT 5),
t AS (SELECT vec_id AS rank FROM embeddings, q ORDER BY list_cosine_similarity(embedding::double[], v) DESC, vec_id LIMIT 10),
l AS (SELECT rank, string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, -1) ELSE text END, chr(10)) AS lines, string_split(text, chr(10)) AS raw FROM t LEFT JOIN documents ON doc_id = rank),
c AS (SELECT rank, CASE WHEN len(raw) >= 1 THEN array_to_string(raw[1:2], chr(10)) END AS code FROM l),
a AS (SELECT *, 600 - coalesce(sum(length(coalesce(code, ''))) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM c)
SELECT rank, sha256(CASE WHEN length(code) > room THEN concat(left(code, room::bigint), '...') ELSE code END) AS code_hash FROM a WHERE room > 0""",
    "related_files": """
WITH p AS (SELECT n_nationkey AS k, replace(['src/a{}.py', 'tests/test_a{}.py', 'package{}.json', 'docs/n{}.md', 'lib/x/y{}.rb'][n_nationkey % 5 + 1], '{}', (n_nationkey % 3)::varchar) AS path FROM nation),
x AS (SELECT a.k AS a, b.k AS b, a.path AS pa, b.path AS pb, regexp_replace(a.path, '/[^/]*$', '') AS da, regexp_replace(b.path, '/[^/]*$', '') AS db, regexp_extract(a.path, '[^/]*$') AS na, regexp_extract(b.path, '[^/]*$') AS nb FROM p a JOIN p b ON a.k < b.k),
y AS (SELECT *, contains(pa, '/') AND contains(pb, '/') AS dirs, concat('test_', na) = nb OR concat('test_', nb) = na AS test_pair, regexp_replace(na, '\\.[^.]*$', '') AS sa, regexp_replace(nb, '\\.[^.]*$', '') AS sb FROM x)
SELECT a, b, test_pair, (dirs AND string_split(pa, '/')[1] = string_split(pb, '/')[1]) OR test_pair OR ((contains(sa, sb) OR contains(sb, sa)) AND least(length(sa), length(sb)) >= 3)
  OR (regexp_matches(pa, '^docs/.*\\.md$') AND starts_with(pb, 'src/')) OR (regexp_matches(pb, '^docs/.*\\.md$') AND starts_with(pa, 'src/')) AS related FROM y""".replace("\\\\", "\\"),
}
