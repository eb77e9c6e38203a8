"""Text scalars, deduplication, synchronisation and trees over `documents`, `labels` and `pages`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ignore, sync, tree
from .tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _path() -> Column:
    """A file path for a document: source, lang, doc_id and an extension by remainder."""
    return F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id"), F.element_at(F.array(*[F.lit(x) for x in (".py", ".ts", ".md", ".pyc")]), (F.col("doc_id") % 4 + 1).cast("int"))))


_PATH = "concat_ws('/', source, lang, concat('doc_', doc_id, ['.py', '.ts', '.md', '.pyc'][cast(doc_id % 4 + 1 AS int)]))"


def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.token_estimate(F.col("text")).alias("estimate"), T.token_count(F.col("text")).alias("n_tokens"))


def content_dedup(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("hash", T.content_hash(F.col("text")))
    return sync.first_of(rows, ["hash"], ["doc_id"]).select("doc_id", "hash")


def distinct_hashes(spark, sf_dir):
    payload = F.struct(F.when(F.col("doc_id") % 5 != 0, T.content_hash(F.col("text"))).alias("content_hash"), F.struct(T.content_hash(F.col("source")).alias("file_content_hash")).alias("file_metadata"))
    return sync.content_hashes(_docs(spark, sf_dir).select(payload.alias("payload")))


def path_info(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "source", "lang", "n_chars", _path().alias("path"))
    info = T.file_info(F.col("path"))
    return d.select("doc_id", T.base_name(F.col("path")).alias("name"), info["extension"].alias("extension"), info["directory"].alias("directory"), T.language_of(F.col("path")).alias("language"), T.safe_branch(F.col("path")).alias("branch"), T.collection_name(F.col("path"), F.col("source")).alias("collection"), T.diagram_id(F.col("path"), F.col("n_chars"), F.col("lang")).alias("node"), T.anchor(F.col("path")).alias("anchor"))


def line_slice(spark, sf_dir):
    start = (F.col("doc_id") % 3).cast("int")
    return _docs(spark, sf_dir).select("doc_id", F.size(T.lines(F.col("text"))).cast("long").alias("n_lines"), T.content_hash(T.line_slice(F.col("text"), start, start + 2)).alias("slice_hash"))


def lines_explode(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("at", "line")).select("doc_id", (F.col("at") + 1).cast("long").alias("n"), F.length("line").cast("long").alias("size"))


def _states(spark, sf_dir):
    d = _docs(spark, sf_dir).select(_path().alias("file_path"), "doc_id", T.content_hash(F.col("text")).alias("hash"))
    previous = d.filter("doc_id % 10 <> 0").select("file_path", F.when(F.col("doc_id") % 11 == 0, "dir").otherwise("file").alias("type"), F.when(F.col("doc_id") % 7 == 0, F.reverse("hash")).otherwise(F.col("hash")).alias("hash"))
    current = d.filter("doc_id % 13 <> 0").select("file_path", "hash")
    index = d.filter("doc_id % 3 <> 0").select("file_path", F.concat(F.lit("c"), "doc_id").alias("chunk_id")).unionByName(spark.range(5).select(F.concat(F.lit("gone/"), "id").alias("file_path"), F.concat(F.lit("g"), "id").alias("chunk_id")))
    return current, previous, index


_STATES = f"""
d AS (SELECT {_PATH} AS file_path, doc_id, sha256(text) AS hash FROM documents),
previous AS (SELECT file_path, CASE WHEN doc_id % 11 = 0 THEN 'dir' ELSE 'file' END AS type, CASE WHEN doc_id % 7 = 0 THEN reverse(hash) ELSE hash END AS hash FROM d WHERE doc_id % 10 <> 0),
current AS (SELECT file_path, hash FROM d WHERE doc_id % 13 <> 0),
idx AS (SELECT file_path, concat('c', doc_id) AS chunk_id FROM d WHERE doc_id % 3 <> 0 UNION ALL SELECT concat('gone/', i), concat('g', i) FROM range(5) r(i)),
status AS (
  SELECT coalesce(c.file_path, p.file_path) AS file_path,
         CASE WHEN p.file_path IS NULL THEN 'new' WHEN c.file_path IS NULL THEN 'deleted' WHEN c.hash = p.hash THEN 'unchanged' ELSE 'changed' END AS status
  FROM current c FULL JOIN (SELECT * FROM previous WHERE type = 'file') p ON c.file_path = p.file_path)"""


def sync_status(spark, sf_dir):
    current, previous, _ = _states(spark, sf_dir)
    return sync.file_status(current, previous)


def sync_plan(spark, sf_dir):
    process, delete = sync.sync_plan(*_states(spark, sf_dir))
    return process.select("file_path", F.lit("process").alias("action"), F.lit(None).cast("string").alias("chunk_id")).unionByName(delete.select("file_path", F.lit("delete").alias("action"), "chunk_id"))


def compare_states(spark, sf_dir):
    current, previous, _ = _states(spark, sf_dir)
    more = previous.filter("length(file_path) % 2 = 0").select("file_path", F.reverse("hash").alias("hash"))
    return sync.compare_states(current, previous.select("file_path", "hash").unionByName(more))


def metadata_drift(spark, sf_dir):
    d, l = _docs(spark, sf_dir), table(spark, sf_dir, "labels")
    chunks = d.join(l, "doc_id").select(_path().alias("file_path"), F.col("doc_id").alias("chunk_id"), (F.col("quality") == 1).alias("tracked"), F.when(F.col("toxic") == 1, F.col("lang")).alias("branch"))
    current = d.select(_path().alias("file_path"), F.lit(True).alias("tracked"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("branch"))
    out = sync.metadata_drift(chunks, current, ["tracked", "branch"])
    return out.select("values.tracked", "values.branch", F.array_join("chunk_ids", ",").alias("chunk_ids"))


def _points(spark, sf_dir):
    d = _docs(spark, sf_dir)
    git = F.struct((F.col("doc_id") % 2 == 0).alias("tracked"), F.col("lang").alias("branch"))
    return d.select(F.col("doc_id").alias("id"), F.struct(F.col("source").alias("entity"), F.col("n_chars").alias("size"), git.alias("git")).alias("payload"))


def _flat(points):
    return points.select("id", F.col("payload.entity").alias("entity"), F.col("payload.size").alias("size"), F.col("payload.git.tracked").alias("tracked"), F.col("payload.git.branch").alias("branch"))


def payload_set(spark, sf_dir):
    p = sync.set_payload(_points(spark, sf_dir), F.col("payload.size") > 1000, {"entity": F.lit("large")})
    return _flat(sync.set_payload(p, F.col("id") % 3 == 0, {"branch": F.lit("main")}, key="git"))


def payload_drop(spark, sf_dir):
    p = sync.drop_payload_keys(_points(spark, sf_dir), F.col("payload.git.branch") == "de", ["size"])
    return _flat(sync.clear_payload(p, F.col("id") % 50 == 0))


def point_upsert(spark, sf_dir):
    p = _points(spark, sf_dir)
    new = p.filter("id % 20 = 0").select((F.col("id") + 10).alias("id"), "payload")
    return _flat(sync.delete_where(sync.upsert(p, new), F.col("payload.git.branch") == "fr"))


def _page_files(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$|/+$", "")
    rows = table(spark, sf_dir, "pages").select(F.concat(path, F.lit("/p"), F.col("page_id"), F.lit(".html")).alias("file_path"), T.content_hash(F.col("html")).alias("hash"))
    return rows.withColumn("file_path", F.regexp_replace("file_path", "/+", "/"))


_FILES = r"""files AS (
  SELECT regexp_replace(concat(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$|/+$', '', 'g'), '/p', page_id, '.html'), '/+', '/', 'g') AS file_path, sha256(html) AS hash FROM pages)"""


def merkle_dirs(spark, sf_dir):
    return tree.tree_hashes(_page_files(spark, sf_dir))


def _merkle_sql(levels: int = 12) -> str:
    out = f"""WITH {_FILES},
s AS (SELECT string_split(file_path, '/') AS parts, file_path, hash FROM files),
n AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS path, i AS depth, i = len(parts) AS is_file FROM s, range(1, {levels}) r(i) WHERE i <= len(parts)),
h{levels} AS (SELECT n.path, depth, CASE WHEN is_file THEN 'file' ELSE 'dir' END AS type, f.hash FROM n LEFT JOIN files f ON is_file AND f.file_path = n.path)"""
    for i in range(levels - 1, -1, -1):
        out += f""",
c{i} AS (SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, sha256(string_agg(concat(regexp_extract(path, '[^/]*$'), ':', hash), '' ORDER BY regexp_extract(path, '[^/]*$'))) AS hash FROM h{i + 1} WHERE depth = {i + 1} GROUP BY 1),
h{i} AS (SELECT path, depth, type, CASE WHEN type = 'dir' AND depth = {i} THEN coalesce(c{i}.hash, h{i + 1}.hash) ELSE h{i + 1}.hash END AS hash FROM h{i + 1} LEFT JOIN c{i} ON c{i}.parent = path)"""
    return out + " SELECT path, type, hash FROM h0 UNION ALL SELECT '', 'dir', hash FROM c0"


def dir_tree(spark, sf_dir):
    return tree.tree_rows(_page_files(spark, sf_dir)).select("path", F.col("depth").cast("long").alias("depth"), "is_last", "line")


_DIR_SQL = f"""WITH {_FILES},
s AS (SELECT string_split(file_path, '/') AS parts FROM files),
n AS (SELECT path, max(depth) AS depth, bool_and(is_file) AS is_file FROM (SELECT array_to_string(parts[1:i], '/') AS path, i AS depth, i = len(parts) AS is_file FROM s, range(1, 12) r(i) WHERE i <= len(parts)) GROUP BY path),
m AS (SELECT *, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, regexp_extract(path, '[^/]*$') AS name FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY is_file, lower(name), name) = count(*) OVER (PARTITION BY parent) AS is_last FROM m),
b AS (SELECT k.path, string_agg(CASE WHEN a.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY a.depth) AS bar FROM k JOIN k a ON starts_with(k.path, a.path || '/') GROUP BY k.path)
SELECT k.path, depth, is_last, concat(coalesce(bar, ''), CASE WHEN is_last THEN '└── ' ELSE '├── ' END, name, CASE WHEN is_file THEN '' ELSE '/' END) AS line FROM k LEFT JOIN b ON b.path = k.path"""


def repo_stats(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("n", F.size(T.lines(F.col("text"))))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").cast("long").alias("n_lines"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"))


def tracked_files(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", _path().alias("file_path"))
    kept = ignore.tracked(rows, [r"^src1/"]).withColumn("path", F.col("file_path")).withColumn("is_dir", F.lit(False))
    return ignore.kept_paths(kept, ["*.md", "!src2/**/*.md", "src3/en/"]).select("doc_id", "file_path")


_L = "string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, -1) ELSE text END, chr(10))"
_N = f"(CASE WHEN text = '' THEN 0 ELSE len({_L}) END)"
_FLAT = "doc_id AS id, source AS entity, n_chars AS size, doc_id % 2 = 0 AS tracked, lang AS branch"

QUERIES = {f.__name__: f for f in (token_estimate, content_dedup, distinct_hashes, path_info, line_slice, lines_explode, sync_status, sync_plan, compare_states, metadata_drift, payload_set, payload_drop, point_upsert, merkle_dirs, dir_tree, repo_stats, tracked_files)}
SQL = {
    "token_estimate": r"SELECT doc_id, length(text) // 4 AS estimate, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS n_tokens FROM documents",
    "content_dedup": "SELECT min(doc_id) AS doc_id, sha256(text) AS hash FROM documents GROUP BY 2",
    "distinct_hashes": "SELECT DISTINCT concat(sha256(text), ':', sha256(source)) AS hashes FROM documents WHERE doc_id % 5 <> 0",
    "path_info": f"""
WITH d AS (SELECT doc_id, source, lang, n_chars, {_PATH} AS path FROM documents)
SELECT doc_id, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '[^.]*$') AS extension, concat(source, '/', lang) AS directory,
  CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' END AS language, left(replace(path, '/', '_'), 50) AS branch,
  concat('sparkloom_', left(sha256(path), 16), '_', source) AS collection, concat(regexp_replace(path, '[^a-zA-Z0-9]', '_', 'g'), '_', n_chars, '_', lang) AS node,
  concat(lang, '-', regexp_replace(regexp_extract(path, '[^/]*$'), '[^a-zA-Z0-9]', '', 'g')) AS anchor FROM d""",
    "line_slice": f"""
SELECT doc_id, {_N}::bigint AS n_lines,
  CASE WHEN doc_id % 3 >= 1 AND doc_id % 3 + 2 <= {_N} THEN sha256(array_to_string({_L}[doc_id % 3 : doc_id % 3 + 2], chr(10))) END AS slice_hash FROM documents""",
    "lines_explode": f"SELECT doc_id, n, length(l[n]) AS size FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, {_L} AS l FROM documents WHERE text <> ''))",
    "sync_status": f"WITH {_STATES} SELECT * FROM status",
    "sync_plan": f"""WITH {_STATES}
SELECT file_path, 'process' AS action, NULL AS chunk_id FROM status WHERE status IN ('new', 'changed')
UNION ALL SELECT DISTINCT file_path, 'delete', chunk_id FROM idx WHERE file_path NOT IN (SELECT file_path FROM status WHERE status = 'unchanged')""",
    "compare_states": f"""WITH {_STATES},
stored AS (SELECT file_path, list(hash) AS hashes FROM (SELECT file_path, hash FROM previous UNION ALL SELECT file_path, reverse(hash) FROM previous WHERE length(file_path) % 2 = 0) GROUP BY 1)
SELECT * FROM (SELECT coalesce(c.file_path, s.file_path) AS file_path, CASE WHEN s.file_path IS NULL THEN 'add' WHEN c.file_path IS NULL THEN 'delete' WHEN NOT list_contains(hashes, hash) THEN 'update' END AS action
FROM current c FULL JOIN stored s ON c.file_path = s.file_path) WHERE action IS NOT NULL""",
    "metadata_drift": """
SELECT tracked, branch, string_agg(doc_id, ',' ORDER BY doc_id) AS chunk_ids FROM (
  SELECT d.doc_id, true AS tracked, CASE WHEN d.doc_id % 2 = 0 THEN lang END AS branch, quality = 1 AS old_tracked, CASE WHEN toxic = 1 THEN lang END AS old_branch FROM documents d JOIN labels USING (doc_id))
WHERE tracked IS DISTINCT FROM old_tracked OR branch IS DISTINCT FROM old_branch GROUP BY 1, 2""",
    "payload_set": "SELECT doc_id AS id, CASE WHEN n_chars > 1000 THEN 'large' ELSE source END AS entity, n_chars AS size, doc_id % 2 = 0 AS tracked, CASE WHEN doc_id % 3 = 0 THEN 'main' ELSE lang END AS branch FROM documents",
    "payload_drop": """
SELECT doc_id AS id, CASE WHEN doc_id % 50 <> 0 THEN source END AS entity, CASE WHEN doc_id % 50 <> 0 AND lang <> 'de' THEN n_chars END AS size,
  CASE WHEN doc_id % 50 <> 0 THEN doc_id % 2 = 0 END AS tracked, CASE WHEN doc_id % 50 <> 0 THEN lang END AS branch FROM documents""",
    "point_upsert": f"""
WITH p AS (SELECT {_FLAT} FROM documents), n AS (SELECT id + 10 AS id, entity, size, tracked, branch FROM p WHERE id % 20 = 0)
SELECT * FROM (SELECT * FROM p WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n) WHERE branch <> 'fr'""",
    "merkle_dirs": _merkle_sql(),
    "dir_tree": _DIR_SQL,
    "repo_stats": f"SELECT source, count(*) AS n_files, sum({_N})::bigint AS n_lines, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM documents GROUP BY source",
    "tracked_files": f"""
SELECT doc_id, file_path FROM (SELECT doc_id, source, lang, {_PATH} AS file_path FROM documents)
WHERE NOT starts_with(file_path, 'src1/') AND NOT ends_with(file_path, '.pyc') AND (NOT ends_with(file_path, '.md') OR starts_with(file_path, 'src2/')) AND NOT starts_with(file_path, 'src3/en/')""",
}
