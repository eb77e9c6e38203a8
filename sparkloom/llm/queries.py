"""The queries opN_* over the driver's tables, each with the columns that its contract names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, lexical_search, license_scan, media, mixing, ngram_join, pii, quality_classifier, quality_rules, simhash, substring_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(parts: int) -> Column:
    """The remainder by which the contracts hold documents out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def _verdict(scores: DataFrame, held_out: Column) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _fold(3) != 1)
    return _verdict(scores, _fold(3) == 1)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("probability", 6).alias("probability"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = media.read_png(media.to_png(table(spark, sf_dir, "documents")))
    return images.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.spans(table(spark, sf_dir, "documents")).drop("key")


def op7_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.digest(mixing.training_order(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))
    return p.select("doc_id", F.col("mix_words").alias("size"), F.col("mix_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each pass of a document, in order of training position."""
    rows = mixing.training_order(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).filter("mix_pass IS NOT NULL")
    return rows.select("doc_id", F.col("mix_pass").alias("pass"), F.round("mix_position", 9).alias("position"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _fold(4) != 2)
    return _verdict(scores, _fold(4) == 2)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.listed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(centroids.clustered(table(spark, sf_dir, "embeddings")))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.joined(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.searched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(cast(doc_id AS varchar), '')) AS deal,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS bigint) AS size
  FROM documents),
s AS (
  SELECT source, cast(sum(size) AS bigint) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][cast(rank % 3 + 1 AS int)] AS weight FROM s),
o AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS over_weight FROM w),
l AS (SELECT *, arg_min(rest / over_weight, source_size / weight) FILTER (WHERE 3 * source_size * over_weight >= rest * weight) OVER () AS level FROM o),
t AS (SELECT source, source_size, least(3.0 * source_size, coalesce(level, 0) * weight)::double AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY deal, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       cast(CASE WHEN size > 0 THEN size * least(3, greatest(0, ceil((target - ahead) / source_size))) ELSE 0 END AS bigint) AS taken
FROM p
"""
OP8_ORDER_SQL = OP8_SQL[: OP8_SQL.rindex("SELECT doc_id, size")].rstrip() + r""",
x AS (SELECT p.*, CASE s.rank % 2 WHEN 1 THEN 0.5::double ELSE -0.5::double END AS tilt, unnest(range(least(3, greatest(0, ceil((target - ahead) / p.source_size)))::bigint)) AS pass
      FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source WHERE size > 0),
y AS (SELECT *, (ahead + pass * source_size) / target AS share FROM x)
SELECT doc_id, pass, round(2 * share / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share)), 9) AS position FROM y
"""


def _op11_sql(rounds: int = 10) -> str:
    """Each round as two tables: nearest centroids, and floors of the means."""
    nearest = """a{0} AS MATERIALIZED (
  SELECT vec_id, any_value(v.v) AS v, min({{'d': list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c.c}}) AS best
  FROM v CROSS JOIN c{0} c GROUP BY vec_id)"""
    means = """c{1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.v, c.v) AS v FROM c{0} c LEFT JOIN (
    SELECT c, list(cast((s - ((s % n) + n) % n) // n AS bigint) ORDER BY i) AS v FROM (
      SELECT best.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{0}, range(1, 65) t(i) GROUP BY ALL) GROUP BY c) m ON m.c = c.c)"""
    steps = [nearest.format(0)]
    for turn in range(1, rounds + 1):
        steps += [means.format(turn - 1, turn), nearest.format(turn)]
    return (
        """WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x AS double)) AS bigint)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT cast(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS int) AS c, v FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8),
"""
        + ",\n".join(steps)
        + f"""
SELECT vec_id, best.c AS cluster, cast(best.d AS bigint) AS distance, cast(sum(best.d) OVER (PARTITION BY best.c) AS bigint) AS cluster_inertia,
       cast(sum(best.d) OVER () AS bigint) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.c = best.c"""
    )


OP11_SQL = _op11_sql()
OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*) AS docs, sum(len(t)) AS terms FROM d WHERE len(t) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, cast(floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1))) AS bigint) AS w FROM p, s GROUP BY term),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
x AS (
  SELECT item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS bigint) AS score
  FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY item_id, r, doc_id)
SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS int) AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 10
"""
