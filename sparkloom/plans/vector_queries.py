"""Vector search and clustering over `embeddings`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components, search
from ..operators import token_table as learned
from .tables import table

EPS = 0.6


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _topk(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = _points(spark, sf_dir)
        query = points.filter("id = 0").select("vector").first()[0]
        return search.top_k(points, query, 10, metric).select("id", F.round("score", 9).alias("score"))

    return run


def _topk_sql(measure: str, order: str) -> str:
    return f"""
WITH q AS (SELECT embedding::double[] AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS id, round({measure}, 9) AS score FROM embeddings, q ORDER BY {measure} {order}, vec_id LIMIT 10"""


FILTER = {"must": [{"range": {"id": {"gte": 10, "lt": 400}}}], "should": [{"match": {"label": 1}}, {"match_any": {"label": [2, 3, 5]}}], "must_not": [{"id": 17}]}


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    query = points.filter("id = 0").select("vector").first()[0]
    return search.top_k(points, query, 10, where=FILTER).select("id", "label", F.round("score", 9).alias("score"))


def vector_topk_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every id that 20 divides, against all points."""
    points = _points(spark, sf_dir)
    return search.top_k_many(points, points.filter("id % 20 = 0"), 5)


def group_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.group_similarity(_points(spark, sf_dir), "label").select("group_a", "group_b", F.round("similarity", 9).alias("similarity"))


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.pairs_within(_points(spark, sf_dir), EPS).select("a", "b", F.round("distance", 9).alias("distance"))


def eps_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return components.density_clusters(points, components.staged(search.pairs_within(points, EPS), "pairs"))


_PAIRS = f"""p AS (
  SELECT x.vec_id AS a, y.vec_id AS b, 1 - list_cosine_similarity(x.embedding::double[], y.embedding::double[]) AS distance
  FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id
  WHERE 1 - list_cosine_similarity(x.embedding::double[], y.embedding::double[]) <= {EPS})"""


def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = learned.token_table(table(spark, sf_dir, "documents"))
    return table_.select("token", "n", "weight", F.array_join("vector", ",").alias("vector"))


def table_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns embedded by the table learnt from documents."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    found = learned.table_vectors(rows, learned.token_table(table(spark, sf_dir, "documents")))
    return found.select("id", "n_tokens", F.array_join("sums", ",").alias("sums"))


QUERIES = {f"vector_topk_{m}": _topk(m) for m in ("cosine", "dot", "euclid", "manhattan")} | {
    "vector_topk_filtered": vector_topk_filtered,
    "vector_topk_per_query": vector_topk_per_query,
    "group_similarity": group_similarity,
    "near_pairs": near_pairs,
    "eps_components": eps_components,
    "token_table": token_table,
    "table_vectors": table_vectors,
}
_LEARNT = r"""
p AS (SELECT rid, ts[i] AS t, i FROM (SELECT rid, ts, unnest(range(1, len(ts) + 1)) AS i FROM (
  SELECT row_number() OVER () AS rid, regexp_extract_all(lower(coalesce(text, '')), '\w+') AS ts FROM documents))),
near AS (SELECT a.t, ('0x' || substr(md5(b.t), 1, 8))::bigint AS h FROM p a CROSS JOIN (VALUES (-2), (-1), (1), (2)) o(k) JOIN p b ON b.rid = a.rid AND b.i = a.i + k),
v AS (SELECT t, j, sum(2 * ((h >> j) & 1) - 1)::bigint AS s FROM near, range(32) r(j) GROUP BY ALL),
n AS (SELECT t, count(*) AS n FROM p GROUP BY t),
w AS (SELECT t, n, (1000 * total) // (total + 999 * n) AS weight FROM n, (SELECT sum(n)::bigint AS total FROM n)),
tab AS (
  SELECT t, n, weight, j, CASE WHEN s < 0 THEN -1 ELSE 1 END * ((abs(s) * 1000) // greatest(sum(abs(s)) OVER (PARTITION BY t), 1)::bigint) AS x FROM (
    SELECT w.t, n, weight, r.j, coalesce(s, 0) AS s FROM w CROSS JOIN range(32) r(j) LEFT JOIN v ON v.t = w.t AND v.j = r.j))"""
SQL = {
    "vector_topk_cosine": _topk_sql("list_cosine_similarity(embedding::double[], v)", "DESC"),
    "vector_topk_dot": _topk_sql("list_dot_product(embedding::double[], v)", "DESC"),
    "vector_topk_euclid": _topk_sql("list_distance(embedding::double[], v)", "ASC"),
    "vector_topk_manhattan": _topk_sql("list_sum(list_transform(list_zip(embedding::double[], v), lambda x: abs(x[1] - x[2])))", "ASC"),
    "vector_topk_filtered": """
WITH q AS (SELECT embedding::double[] AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS id, label, round(list_cosine_similarity(embedding::double[], v), 9) AS score FROM embeddings, q
WHERE vec_id >= 10 AND vec_id < 400 AND (label = 1 OR label IN (2, 3, 5)) AND vec_id <> 17
ORDER BY list_cosine_similarity(embedding::double[], v) DESC, vec_id LIMIT 10""",
    "vector_topk_per_query": """
SELECT query_id, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT q.vec_id AS query_id, p.vec_id AS id, round(list_cosine_similarity(p.embedding::double[], q.embedding::double[]), 9) AS score
    FROM embeddings p, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rank <= 5""",
    "token_table": f"""
WITH {_LEARNT}
SELECT t AS token, n, weight, string_agg(x::varchar, ',' ORDER BY j) AS vector FROM tab GROUP BY t, n, weight""",
    "table_vectors": rf"""
WITH {_LEARNT},
c AS (SELECT concat_ws(':', conv_id, turn) AS id, regexp_extract_all(lower(coalesce(text, '')), '\w+') AS ts FROM conversations),
own AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(ts) AS t FROM c) GROUP BY ALL),
sums AS (SELECT id, j, sum(own.n * weight * x)::bigint AS s FROM own JOIN tab USING (t) GROUP BY ALL),
ids AS (SELECT id, sum(len(ts))::bigint AS n_tokens FROM c GROUP BY id)
SELECT id, n_tokens, string_agg(coalesce(s, 0)::varchar, ',' ORDER BY j) AS sums
FROM (SELECT ids.id, n_tokens, r.j, s FROM ids CROSS JOIN range(32) r(j) LEFT JOIN sums ON sums.id = ids.id AND sums.j = r.j) GROUP BY id, n_tokens""",
    "group_similarity": """
SELECT x.label AS group_a, y.label AS group_b, round(avg(list_cosine_similarity(x.embedding::double[], y.embedding::double[])), 9) AS similarity
FROM embeddings x JOIN embeddings y ON x.label < y.label GROUP BY ALL""",
    "near_pairs": f"WITH {_PAIRS} SELECT a, b, round(distance, 9) AS distance FROM p",
    "eps_components": f"""
WITH RECURSIVE {_PAIRS},
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT id, min(reach) AS component FROM r GROUP BY id""",
}
