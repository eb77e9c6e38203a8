"""Commit message operators over messages built from `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commits as C
from .tables import table

_CASE = """CASE event_type WHEN 'signup' THEN 'feat' WHEN 'view' THEN 'docs' WHEN 'error' THEN 'fix' WHEN 'click' THEN 'refactor' ELSE 'chore' END"""


def _messages(spark, sf_dir):
    """Messages with faults injected by remainder: long headers, capitals, full stops, missing spaces, bodies and footers."""
    kind = F.expr(_CASE)
    scope = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("(m"), F.col("user_id") % 5, F.lit(")"))).when(F.col("event_id") % 17 == 0, "()").otherwise("")
    word = F.when(F.col("event_id") % 11 == 0, "Handle").otherwise("handle")
    text = F.concat(word, F.lit(" item "), "user_id", F.when(F.col("event_id") % 13 == 0, F.lit(" with a very long description that goes on and on beyond the limit")).otherwise(""), F.when(F.col("event_id") % 7 == 0, ".").otherwise(""))
    colon = F.when(F.col("event_id") % 19 == 0, ":").when(F.col("event_id") % 23 == 0, " ").otherwise(": ")
    tail = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("\n\nbody of "), "event_id")).when(F.col("event_id") % 29 == 0, "\ntight body").otherwise("")
    foot = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("\n\nREFS: #"), "event_id")).when(F.col("event_id") % 35 == 0, "\n\nbreaking change: x").otherwise("")
    message = F.concat(F.when(F.col("event_id") % 31 == 0, F.initcap(kind)).otherwise(kind), scope, F.when(F.col("event_id") % 6 == 0, "!").otherwise(""), colon, text, tail, foot)
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", message.alias("message"))


_M = f"""m AS (
  SELECT event_id, user_id, event_type, concat(
    CASE WHEN event_id % 31 = 0 THEN concat(upper(left({_CASE}, 1)), substr({_CASE}, 2)) ELSE {_CASE} END,
    CASE WHEN event_id % 3 = 0 THEN concat('(m', user_id % 5, ')') WHEN event_id % 17 = 0 THEN '()' ELSE '' END,
    CASE WHEN event_id % 6 = 0 THEN '!' ELSE '' END,
    CASE WHEN event_id % 19 = 0 THEN ':' WHEN event_id % 23 = 0 THEN ' ' ELSE ': ' END,
    CASE WHEN event_id % 11 = 0 THEN 'Handle' ELSE 'handle' END, ' item ', user_id,
    CASE WHEN event_id % 13 = 0 THEN ' with a very long description that goes on and on beyond the limit' ELSE '' END,
    CASE WHEN event_id % 7 = 0 THEN '.' ELSE '' END,
    CASE WHEN event_id % 5 = 0 THEN concat(chr(10), chr(10), 'body of ', event_id) WHEN event_id % 29 = 0 THEN concat(chr(10), 'tight body') ELSE '' END,
    CASE WHEN event_id % 10 = 0 THEN concat(chr(10), chr(10), 'REFS: #', event_id) WHEN event_id % 35 = 0 THEN concat(chr(10), chr(10), 'breaking change: x') ELSE '' END) AS message
  FROM events),
p AS (
  SELECT *, string_split(message, chr(10))[1] AS header,
    regexp_matches(string_split(message, chr(10))[1], '^[a-zA-Z]+(\\([a-zA-Z0-9_-]*\\))?!?: .+') AS ok,
    regexp_extract(message, '^([a-zA-Z]+)', 1) AS kind,
    CASE WHEN event_id % 3 = 0 THEN concat('m', user_id % 5) WHEN event_id % 17 = 0 THEN '' END AS scope,
    trim(regexp_extract(string_split(message, chr(10))[1], '^[a-zA-Z]+(\\([a-zA-Z0-9_-]*\\))?!?: (.+)', 2)) AS description FROM m)"""
_M = _M.replace("\\\\", "\\")


def commit_parse(spark, sf_dir):
    p = C.parsed(F.col("message"))
    m = _messages(spark, sf_dir).withColumn("p", p)
    rest = C.body_and_footers(F.col("p.rest"))
    return m.withColumn("r", rest).select("event_id", "p.ok", "p.type", "p.scope", F.when(F.col("p.ok"), F.col("p.breaking")).alias("breaking"), "p.description", "r.body", "r.footers")


def commit_lint(spark, sf_dir):
    m = C.with_lint(_messages(spark, sf_dir), "message", "l")
    return m.select("event_id", "l.is_valid", F.array_join("l.messages", "\n").alias("messages"))


def commit_format(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = C.formatted(F.col("event_type"), F.when(F.col("user_id") % 2 == 0, F.upper(F.concat(F.lit(" s"), "user_id"))), F.col("event_id") % 3 == 0, F.concat(F.when(F.col("event_id") % 4 == 0, "Fix: ").otherwise(""), F.lit("do "), "event_id", F.lit("  ")), F.when(F.col("event_id") % 5 == 0, "  text\n"))
    return e.select("event_id", out.alias("message"))


def pr_summary(spark, sf_dir):
    c = _messages(spark, sf_dir).select("user_id", F.col("event_id").alias("ord"), "message")
    s = C.pr_summary(c, ["user_id"])
    return s.select("user_id", "title", F.sha2("description", 256).alias("description_hash"), F.col("n_commits").cast("long").alias("n_commits"))


def commit_preview(spark, sf_dir):
    c = _messages(spark, sf_dir).select("user_id", F.col("event_id").alias("ord"), "message")
    return C.preview(c, ["user_id"])


def branch_names(spark, sf_dir):
    m = _messages(spark, sf_dir).withColumn("branch", F.concat(F.element_at(F.array(*[F.lit(x) for x in ("feature/", "release/", "x-")]), (F.col("event_id") % 3 + 1).cast("int")), F.lit("a_b-"), "user_id"))
    kind = C.branch_type(F.col("branch"), "gitflow")
    return m.select("event_id", kind.alias("type"), C.valid_branch(F.col("branch")).alias("valid"), C.title_without_commits(F.col("branch"), kind).alias("title"), C.suggested_branch(F.concat(F.col("event_type"), F.lit(": Do it, now "), "user_id"), "gitflow").alias("suggested"))


def chunk_descriptions(spark, sf_dir):
    files = F.array_sort(F.collect_set(F.concat_ws("/", F.element_at(F.array(*[F.lit(x) for x in ("src", "docs", "src")]), (F.col("l_suppkey") % 3 + 1).cast("int")), F.concat(F.lit("d"), F.col("l_partkey") % 4), F.concat(F.lit("f"), "l_linenumber", F.lit(".py")))))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(files.alias("files"))
    kind = C.commit_type(F.col("files"))
    return g.select("l_orderkey", kind.alias("type"), C.chunk_description(kind, F.col("files")).alias("description"), C.fallback_message(F.col("files"), F.lit("no text"), F.lit("Changes in x")).alias("fallback"))


QUERIES = {f.__name__: f for f in (commit_parse, commit_lint, commit_format, pr_summary, commit_preview, branch_names, chunk_descriptions)}
_SECTION = lambda title, kind, strip: f"CASE WHEN count(*) FILTER (WHERE b = '{kind}') > 0 THEN concat('### {title}', chr(10), chr(10), string_agg(concat('- ', regexp_replace(message, '{strip}', ''), chr(10)), '' ORDER BY event_id) FILTER (WHERE b = '{kind}'), chr(10)) ELSE '' END"
_BODY = ", ".join(_SECTION(t, k or "other", rf"^{k}(\([^)]+\))?:\s*" if k else r"^(style|test|build|ci|chore|revert)(\([^)]+\))?:\s*") for t, k in C.SECTIONS)
_BOX = ", ".join(f"CASE WHEN bool_or(b = '{k}') THEN '- [x] ' ELSE '- [ ] ' END, '{n}', chr(10)" for n, k in C.BOXES)
SQL = {
    "commit_parse": f"""WITH {_M}
SELECT event_id, ok, CASE WHEN ok THEN kind END AS type, CASE WHEN ok THEN scope END AS scope, CASE WHEN ok THEN event_id % 6 = 0 END AS breaking, CASE WHEN ok THEN description END AS description,
  CASE WHEN ok AND event_id % 5 = 0 THEN concat('body of ', event_id) END AS body,
  CASE WHEN ok AND event_id % 10 = 0 THEN concat('REFS: #', event_id) WHEN ok AND event_id % 35 = 0 THEN 'breaking change: x' END AS footers FROM p""",
    "commit_lint": f"""WITH {_M},
e AS (SELECT *, list_filter([
    CASE WHEN length(header) > 72 THEN concat('Header line exceeds 72 characters (found ', length(header), ').') END,
    CASE WHEN ends_with(header, '.') THEN 'Header must not end with ''.''.' END,
    CASE WHEN lower(kind) <> kind THEN 'Type must be in case format: lower-case.' END,
    CASE WHEN scope = '' THEN 'Scope cannot be empty when parentheses are used.' END,
    CASE WHEN regexp_matches(description, '^[A-Z]') AND lower(description[2:]) = description[2:] THEN 'Subject must be in one of these case formats: sentence-case, start-case, pascal-case, upper-case.' END,
    CASE WHEN ends_with(description, '.') THEN 'Subject must not end with ''.''.' END], lambda x: x IS NOT NULL) AS errors,
  list_filter([
    CASE WHEN event_id % 5 <> 0 AND event_id % 29 = 0 THEN '[WARN] Body must begin with a blank line after the description.' END,
    CASE WHEN event_id % 10 <> 0 AND event_id % 35 = 0 THEN '[WARN] Footer token ''breaking change'' MUST be uppercase (''BREAKING CHANGE'' or ''BREAKING-CHANGE'').' END], lambda x: x IS NOT NULL) AS warnings FROM p)
SELECT event_id, ok AND len(errors) = 0 AS is_valid,
  CASE WHEN NOT ok AND NOT contains(header, ':') THEN 'Invalid header format: Missing '':'' after type/scope.' WHEN NOT ok AND NOT regexp_matches(header, '^[^:]*: ') THEN 'Invalid header format: Missing space after '':''.'
    WHEN NOT ok THEN 'Invalid header format: Does not match ''<type>(<scope>)!: <description>''. Check type/scope syntax.' ELSE array_to_string(list_concat(errors, warnings), chr(10)) END AS messages FROM e""",
    "commit_format": """
SELECT event_id, concat(CASE WHEN event_type IN ('feat', 'fix', 'docs', 'style', 'refactor', 'perf', 'test', 'build', 'ci', 'chore') THEN event_type ELSE 'feat' END,
  CASE WHEN user_id % 2 = 0 THEN concat('(s', user_id, ')') ELSE '' END, CASE WHEN event_id % 3 = 0 THEN '!' ELSE '' END, ': do ', event_id, CASE WHEN event_id % 5 = 0 THEN concat(chr(10), chr(10), 'text') ELSE '' END) AS message FROM events""",
    "pr_summary": f"""WITH {_M},
b AS (SELECT *, CASE WHEN starts_with(message, 'feat') THEN 'feat' WHEN starts_with(message, 'fix') THEN 'fix' WHEN starts_with(message, 'docs') THEN 'docs' WHEN starts_with(message, 'refactor') THEN 'refactor' WHEN starts_with(message, 'perf') THEN 'perf' ELSE 'other' END AS b FROM m),
g AS (SELECT user_id, arg_min(message, event_id) AS f, count(*) AS n_commits,
  sha256(concat('## What type of PR is this? (check all applicable)', chr(10), chr(10), {_BOX}, chr(10), '## Description', chr(10), chr(10), {_BODY}, '{C._TAIL}')) AS description_hash FROM b GROUP BY user_id)
SELECT user_id, CASE WHEN NOT regexp_matches(f, '^[a-z]+(\\([^)]+\\))?:') THEN f ELSE concat(
  CASE regexp_extract(f, '^([a-z]+)', 1) WHEN 'feat' THEN 'Feature:' WHEN 'fix' THEN 'Fix:' WHEN 'docs' THEN 'Docs:' WHEN 'refactor' THEN 'Refactor:' WHEN 'perf' THEN 'Optimize:' ELSE 'Update:' END, ' ',
  upper(left(regexp_replace(f, '^[a-z]+(\\([^)]+\\))?:\\s*', ''), 1)), substr(regexp_replace(f, '^[a-z]+(\\([^)]+\\))?:\\s*', ''), 2)) END AS title, description_hash, n_commits FROM g""".replace("\\\\", "\\"),
    "commit_preview": f"""WITH {_M}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM m)
SELECT user_id, concat(string_agg(concat('- ', message), chr(10) ORDER BY event_id) FILTER (WHERE k <= 3), CASE WHEN count(*) > 3 THEN concat(chr(10), '- ... and ', count(*) - 3, ' more commits') ELSE '' END) AS description FROM r GROUP BY user_id""",
    "branch_names": """
WITH b AS (SELECT event_id, user_id, event_type, concat(['feature/', 'release/', 'x-'][cast(event_id % 3 + 1 AS int)], 'a_b-', user_id) AS branch FROM events)
SELECT event_id, CASE event_id % 3 WHEN 1 THEN 'release' ELSE 'feature' END AS type, event_id % 3 = 2 AS valid,
  CASE event_id % 3 WHEN 0 THEN concat('Feature: A b ', user_id) WHEN 1 THEN concat('Release a_b-', user_id) ELSE concat('Feature: X a b ', user_id) END AS title,
  concat('feature/', event_type, '-do-it-now-', user_id) AS suggested FROM b""",
    "chunk_descriptions": """
WITH f AS (SELECT DISTINCT l_orderkey, concat(['src', 'docs', 'src'][cast(l_suppkey % 3 + 1 AS int)], '/d', l_partkey % 4, '/f', l_linenumber, '.py') AS file FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS n, min(file) AS one, bool_or(starts_with(file, 'docs/')) AS docs, min(string_split(file, '/')[1]) AS a1, max(string_split(file, '/')[1]) AS a2, min(string_split(file, '/')[2]) AS b1, max(string_split(file, '/')[2]) AS b2 FROM f GROUP BY 1),
c AS (SELECT *, CASE WHEN docs THEN 'docs' ELSE 'chore' END AS type, CASE WHEN a1 <> a2 THEN '' WHEN b1 <> b2 THEN a1 ELSE concat(a1, '/', b1) END AS folder FROM g)
SELECT l_orderkey, type, CASE WHEN n = 1 THEN concat(type, ': update ', one) WHEN folder <> '' THEN concat(type, ': update files in ', folder) ELSE concat(type, ': update ', n, ' related files') END AS description,
  CASE WHEN n = 1 THEN concat(type, ': update ', one) WHEN folder <> '' THEN concat(type, ': update files in ', folder) ELSE concat(type, ': update ', n, ' files') END AS fallback FROM c""",
}
