"""Diff, history and conversation operators over lines of `documents`, `lineitem`, `embeddings`, `conversations` and `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diffs, history
from .tables import table


def _lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(T.lines(F.col("text"))).alias("n", "line"))
    return d.withColumn("n", F.col("n") + 1)


_L = """l AS (SELECT doc_id, source, n, lines[n] AS line FROM (
  SELECT doc_id, source, lines, unnest(range(1, len(lines) + 1)) AS n FROM (
    SELECT doc_id, source, string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, -1) ELSE text END, chr(10)) AS lines FROM documents WHERE text <> '')))"""


def _diff_table(spark, sf_dir):
    """A diff for each document: two files whose hunks are its lines, added, kept or removed in turn."""
    lines = T.lines(F.col("text"))
    tagged = F.transform(lines, lambda x, i: F.concat(F.when(i % 5 == 0, F.concat(F.lit("@@ -1,3 +"), (i + 1).cast("string"), F.lit(",3 @@\n"))).otherwise(""), F.element_at(F.array(F.lit("+"), F.lit(" "), F.lit("-")), (i % 3 + 1).cast("int")), x))
    body = F.array_join(tagged, "\n")
    content = F.concat(F.lit("diff --git a/x"), "doc_id", F.lit(".py b/x"), "doc_id", F.lit(".py\n--- a\n+++ b\n"), body, F.lit("\ndiff --git a/y.md b/y.md\n@@ -1 +7 @@\n+"), "lang")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("diff_id"), content.alias("content"))


def diff_files(spark, sf_dir):
    f = diffs.file_diffs(_diff_table(spark, sf_dir))
    return f.select("diff_id", "file_path", F.length("content").cast("long").alias("size"))


def diff_hunks(spark, sf_dir):
    h = diffs.hunks(diffs.file_diffs(_diff_table(spark, sf_dir)))
    return h.select("diff_id", "file_path", F.col("hunk_no").cast("long").alias("hunk_no"), "target_start", F.size("added").cast("long").alias("n_added"), F.sha2(F.array_join("added", "\n"), 256).alias("added_sha"), F.sha2("body", 256).alias("body_sha"))


def hunk_sections(spark, sf_dir):
    rows = diffs.islands(_lines(spark, sf_dir), ["doc_id"], "n", F.col("line").rlike("^[A-Z]"))
    return rows.groupBy("doc_id", "section").agg(F.min("n").cast("long").alias("first_line"), F.count(F.lit(1)).alias("n_lines"))


def greedy_pack(spark, sf_dir):
    p = diffs.packed(_lines(spark, sf_dir), ["doc_id"], "n", F.length("line") + 1, 400)
    return p.select("doc_id", F.col("n").cast("long").alias("n"), F.col("part").cast("long").alias("part"))


def budget_truncation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("n_lines", F.size(T.lines(F.col("text"))))
    out = diffs.cut_to_budget(d, ["source"], "doc_id", F.col("n_lines"), 10, 100)
    return out.select("doc_id", F.col("taken").cast("long").alias("taken"), "cut")


def keep_leading(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    out = diffs.keep_leading(d, ["source"], "doc_id", F.length("text"), 8000)
    return out.select("doc_id", "source", "dropped")


def move_detection(spark, sf_dir):
    """All files with an even vec_id count as deleted, the others as added."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.concat(F.lit("d"), F.col("vec_id") % 7, F.lit("/f"), F.col("label")).alias("path"))
    gone = e.filter("vec_id % 2 = 0").select(F.concat(F.lit("v"), "vec_id", F.lit("/"), "path").alias("path"), "vector")
    new = e.filter("vec_id % 2 = 1").select(F.concat(F.lit("v"), "vec_id", F.lit("/"), "path").alias("path"), "vector")
    return diffs.moves(gone, new, 0.25).select("source", "target", F.round("similarity", 9).alias("similarity"))


def move_groups(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pairs = e.select(F.concat(F.lit("a"), F.col("user_id") % 20, F.lit("/f"), "event_id").alias("source"), F.concat(F.lit("a"), F.col("event_id") % 20, F.lit("/g"), "event_id").alias("target"))
    return diffs.move_groups(pairs).select("source_dir", "target_dir", "n_moves", F.array_join("files", ",").alias("files"), "description")


def blame_spans(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_path"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("commit_id"))
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("file_path"), F.lit(1).alias("start_line"), F.lit(5).alias("end_line"))
    return history.blame_spans(l, r).select("chunk_id", "commit_id", "start_line", "end_line", F.col("place").cast("long").alias("place"))


def chat_history(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("turn").alias("id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("timestamp"), F.col("text").alias("user_query"))
    return history.chat_history(c, "3", 5).select("id", "session_id", F.sha2("user_query", 256).alias("query_hash"))


def chat_update(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.lit(None).cast("string").alias("ai_response"))
    u = c.filter("id % 3 = 0").select("id", F.concat(F.lit("r"), "id").alias("ai_response"))
    return history.set_response(c, u)


def integrity(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("group_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_partkey").alias("file_path"))
    return history.violations(m).join(history.primary_group(m), "file_path").select("file_path", "n_groups", "group_id")


def file_precedence(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 500).alias("file_path"), F.col("o_orderkey").alias("k"), "o_orderstatus")
    pick = lambda s: o.filter(F.col("o_orderstatus") == s).groupBy("file_path").agg(F.min("k").alias("k"))
    return diffs.by_precedence(pick("F"), pick("O"), pick("P")).withColumn("precedence", F.col("precedence").cast("long"))


QUERIES = {f.__name__: f for f in (diff_files, diff_hunks, hunk_sections, greedy_pack, budget_truncation, keep_leading, move_detection, move_groups, blame_spans, chat_history, chat_update, integrity, file_precedence)}
_TAGGED = f"""{_L},
t AS (SELECT doc_id, n, concat(['+', ' ', '-'][cast((n - 1) % 3 + 1 AS int)], line) AS raw, (n - 1) % 5 = 0 AS opens, (n - 1) // 5 + 1 AS hunk_no FROM l)"""
_DIR = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '' END"
SQL = {
    "diff_files": f"""WITH {_TAGGED},
b AS (SELECT doc_id, sum(length(raw) + 1 + CASE WHEN opens THEN length(concat('@@ -1,3 +', n, ',3 @@', chr(10))) ELSE 0 END) - 1 AS size FROM t GROUP BY doc_id)
SELECT doc_id AS diff_id, concat('x', doc_id, '.py') AS file_path, (length(concat('diff --git a/x', doc_id, '.py b/x', doc_id, '.py', chr(10), '--- a', chr(10), '+++ b', chr(10), chr(10))) + coalesce(size, 0))::bigint AS size FROM documents LEFT JOIN b USING (doc_id)
UNION ALL SELECT doc_id, 'y.md', length(concat('diff --git a/y.md b/y.md', chr(10), '@@ -1 +7 @@', chr(10), '+', lang)) FROM documents""",
    "diff_hunks": f"""WITH {_TAGGED}
SELECT doc_id AS diff_id, concat('x', doc_id, '.py') AS file_path, hunk_no, min(n)::int AS target_start, count(*) FILTER (WHERE (n - 1) % 3 = 0) AS n_added,
  sha256(coalesce(string_agg(raw[2:], chr(10) ORDER BY n) FILTER (WHERE (n - 1) % 3 = 0), '')) AS added_sha, sha256(concat('@@ -1,3 +', min(n), ',3 @@', chr(10), string_agg(raw, chr(10) ORDER BY n))) AS body_sha FROM t GROUP BY doc_id, hunk_no
UNION ALL SELECT doc_id, 'y.md', 1, 7, 1, sha256(coalesce(lang, '')), sha256(concat('@@ -1 +7 @@', chr(10), '+', lang)) FROM documents""",
    "hunk_sections": f"""WITH {_L},
b AS (SELECT *, sum(CASE WHEN n > 1 AND regexp_matches(line, '^[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) + 1 AS section FROM l)
SELECT doc_id, section::bigint AS section, min(n) AS first_line, count(*) AS n_lines FROM b GROUP BY 1, 2""",
    "greedy_pack": f"""WITH RECURSIVE {_L},
s AS (SELECT doc_id, n, length(line) + 1 AS size FROM l),
r AS (
  SELECT doc_id, n, 1 AS part, CASE WHEN size > 400 THEN 0 ELSE size END AS used, size <= 400 AS is_open FROM s WHERE n = 1
  UNION ALL
  SELECT s.doc_id, s.n, CASE WHEN r.is_open AND r.used + s.size <= 400 THEN r.part ELSE r.part + 1 END,
    CASE WHEN r.is_open AND r.used + s.size > 400 THEN s.size WHEN NOT r.is_open AND s.size > 400 THEN 0 ELSE r.used + s.size END, r.is_open OR s.size <= 400
  FROM r JOIN s ON s.doc_id = r.doc_id AND s.n = r.n + 1)
SELECT doc_id, n, part::bigint AS part FROM r""",
    "budget_truncation": f"""WITH {_L},
c AS (SELECT d.doc_id, d.source, coalesce(k, 0) AS k FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS k FROM l GROUP BY 1) USING (doc_id)),
o AS (SELECT *, CASE WHEN k > 10 THEN 11 ELSE k END AS own FROM c),
a AS (SELECT *, 100 - coalesce(sum(own) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM o)
SELECT doc_id, least(own, room)::bigint AS taken, k > 10 OR own > room AS cut FROM a WHERE room > 0""",
    "keep_leading": """
WITH a AS (SELECT doc_id, source, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run, sum(length(text)) OVER (PARTITION BY source) AS whole FROM documents)
SELECT doc_id, source, whole > 8000 AS dropped FROM a WHERE whole <= 8000 OR run <= 7900""",
    "move_detection": """
WITH e AS (SELECT vec_id, embedding::double[] AS v, concat('v', vec_id, '/d', vec_id % 7, '/f', label) AS path, label FROM embeddings),
p AS (SELECT d.path AS source, a.path AS target, greatest(0.0, list_cosine_similarity(d.v, a.v)) AS similarity FROM e d JOIN e a ON d.label = a.label WHERE d.vec_id % 2 = 0 AND a.vec_id % 2 = 1)
SELECT source, target, round(similarity, 9) AS similarity FROM p WHERE similarity >= 0.25 QUALIFY row_number() OVER (PARTITION BY source ORDER BY similarity DESC, target) = 1""",
    "move_groups": f"""
WITH p AS (SELECT concat('a', user_id % 20) AS source_dir, concat('a', event_id % 20) AS target_dir, concat('a', user_id % 20, '/f', event_id) AS source, concat('a', event_id % 20, '/g', event_id) AS target FROM events),
g AS (SELECT source_dir, target_dir, count(*) AS n_moves, string_agg(concat(source, ',', target), ',' ORDER BY source, target) AS files, min(source) AS s, min(target) AS t FROM p GROUP BY 1, 2)
SELECT source_dir, target_dir, n_moves, files, CASE
  WHEN source_dir = target_dir AND n_moves = 1 THEN concat('chore: rename ', regexp_extract(s, '[^/]*$'), ' to ', regexp_extract(t, '[^/]*$'))
  WHEN source_dir = target_dir THEN concat('chore: rename ', n_moves, ' files in ', source_dir)
  WHEN n_moves = 1 THEN concat('chore: move ', regexp_extract(s, '[^/]*$'), ' from ', source_dir, ' to ', target_dir)
  ELSE concat('chore: move ', n_moves, ' files from ', source_dir, ' to ', target_dir) END AS description FROM g""",
    "blame_spans": """
SELECT chunk_id, commit_id, start_line, end_line, row_number() OVER (PARTITION BY chunk_id ORDER BY start_line, commit_id) AS place FROM (
  SELECT l_orderkey AS chunk_id, l_suppkey AS commit_id, min(l_linenumber) AS start_line, max(l_linenumber) AS end_line FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber BETWEEN 1 AND 5 GROUP BY 1, 2)""",
    "chat_history": "SELECT turn AS id, cast(conv_id AS varchar) AS session_id, sha256(text) AS query_hash FROM conversations WHERE conv_id = 3 ORDER BY turn LIMIT 5",
    "chat_update": "SELECT conv_id * 1000 + turn AS id, role, CASE WHEN (conv_id * 1000 + turn) % 3 = 0 THEN concat('r', conv_id * 1000 + turn) END AS ai_response FROM conversations",
    "integrity": """
WITH m AS (SELECT l_suppkey % 50 AS group_id, concat(l_orderkey, '-', l_linenumber) AS chunk_id, l_partkey AS file_path FROM lineitem),
n AS (SELECT file_path, group_id, count(DISTINCT chunk_id) AS k FROM m GROUP BY 1, 2)
SELECT file_path, count(*) AS n_groups, arg_max(group_id, k * 1000 - group_id) AS group_id FROM n GROUP BY 1 HAVING count(*) > 1""",
    "file_precedence": """
WITH o AS (SELECT o_custkey % 500 AS file_path, min(o_orderkey) AS k, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS precedence FROM orders GROUP BY 1, 3)
SELECT file_path, k, precedence::bigint AS precedence FROM o QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY precedence) = 1""",
}
