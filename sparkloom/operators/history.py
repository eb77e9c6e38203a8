"""Commit and line history: blame spans, logs, ancestry, branches, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ancestry import ancestors, chains, merge_bases, reach
from .components import ranked


def blame_spans(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """(chunk_id, commit_id, start_line, end_line, place): per chunk range and commit, the first and last of the commit's lines in it (gaps are covered), in order of the first.

    lines: (file_path, line, commit_id); ranges: (chunk_id, file_path,
    start_line, end_line). The join is on the file, the range is a filter.
    """
    r = ranges.select("chunk_id", "file_path", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    hit = lines.join(r, "file_path").filter(F.col("line").between(F.col("lo"), F.col("hi")))
    spans = hit.groupBy("chunk_id", "commit_id").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"))
    return spans.withColumn("place", F.row_number().over(Window.partitionBy("chunk_id").orderBy("start_line", "commit_id")))


def summary(message: Column) -> Column:
    """First line of a message, stripped."""
    return F.trim(F.element_at(F.split(message, "\n"), 1))


def log_between(commits: DataFrame, parents: DataFrame, base: str, head: str) -> DataFrame:
    """Commits (commit_id, ord, message) reachable from head and not from base, newest first by ord, with their summary."""
    heads = parents.sparkSession.createDataFrame([("head", head), ("base", base)], "head string, commit_id string")
    reach = ancestors(parents, heads)
    own = reach.filter("head = 'head'").select("commit_id").join(reach.filter("head = 'base'").select("commit_id"), "commit_id", "left_anti")
    return commits.join(own, "commit_id").withColumn("summary", summary(F.col("message"))).orderBy(F.desc("ord"))


def log_until(commits: DataFrame, stop: str) -> DataFrame:
    """Commits newer (by ord) than the commit `stop`; all if it is not there."""
    at = commits.filter(F.col("commit_id") == stop).agg(F.max("ord").alias("at"))  # one row
    return commits.join(F.broadcast(at)).filter(F.col("at").isNull() | (F.col("ord") > F.col("at"))).drop("at")


def log_until_base(commits: DataFrame, parents: DataFrame, base: str, head: str) -> DataFrame:
    """What head reaches of commits (commit_id, ord, message), newest first by ord, down to the merge base of head and base (the newest, if there are several; all if there is none)."""
    c, spark = chains(parents), parents.sparkSession
    bases = merge_bases(parents, spark.createDataFrame([(base, head)], "left string, right string"), c)
    stop = bases.join(commits, "commit_id").agg(F.max("ord").alias("stop"))  # one row
    own = ancestors(parents, spark.createDataFrame([("head", head)], "head string, commit_id string"), c).select("commit_id")
    return commits.join(own, "commit_id").join(F.broadcast(stop)).filter(F.col("stop").isNull() | (F.col("ord") > F.col("stop"))).drop("stop").withColumn("summary", summary(F.col("message"))).orderBy(F.desc("ord"))


def branch_relation(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """(branch, base, is_ancestor, ahead) for pairs (branch, base, branch_commit, base_commit): whether branch's commit is reachable from base, and how many of branch's commits base lacks. Both come from positions on chains; no commits are listed."""
    c = chains(parents)
    heads = pairs.select(F.col("branch_commit").alias("commit_id")).unionByName(pairs.select(F.col("base_commit").alias("commit_id"))).distinct().withColumn("head", F.col("commit_id"))
    r = reach(c, heads)
    own = pairs.join(r.select(F.col("head").alias("branch_commit"), "chain", F.col("at").alias("x")), "branch_commit")
    both = own.join(r.select(F.col("head").alias("base_commit"), "chain", F.col("at").alias("y")), ["base_commit", "chain"], "left").join(c.foot, "chain")
    lacks = F.greatest(F.lit(0), F.col("x") - F.greatest(F.coalesce("y", F.col("foot") - 1), F.col("foot") - 1))
    tip = c.commits.select(F.col("commit_id").alias("branch_commit"), F.col("chain").alias("tip_chain"), F.col("depth").alias("tip"))
    both = both.join(tip, "branch_commit")
    return both.groupBy("branch", "base").agg(F.coalesce(F.max((F.col("chain") == F.col("tip_chain")) & (F.col("y") >= F.col("tip"))), F.lit(False)).alias("is_ancestor"), F.sum(lacks).cast("long").alias("ahead"))


def branch_metadata(branches: DataFrame, commits: DataFrame) -> DataFrame:
    """One row per branch: last_commit_date, commit_count, is_local, is_remote. branches: (branch, is_remote); commits: (branch, commit_id, ts). HEAD is left out."""
    b = branches.filter("branch <> 'HEAD'").groupBy("branch").agg(F.max(~F.col("is_remote")).alias("is_local"), F.max("is_remote").alias("is_remote"))
    c = commits.groupBy("branch").agg(F.max("ts").alias("last_commit_date"), F.countDistinct("commit_id").alias("commit_count"))
    return b.join(c, "branch", "left").withColumn("commit_count", F.coalesce("commit_count", F.lit(0)))


def untracked(status: DataFrame, flag: int = 128) -> DataFrame:
    """Files whose status bits hold the new-in-worktree flag."""
    return status.filter(F.col("flags").bitwiseAND(flag) != 0).select("file_path")


def chat_history(rows: DataFrame, session: str, limit: int = 50) -> DataFrame:
    """The oldest `limit` turns of a session, in time order."""
    return rows.filter(F.col("session_id") == session).orderBy("timestamp", "id").limit(limit)


def add_messages(rows: DataFrame, new: DataFrame) -> DataFrame:
    """rows (id and more) and new ones without an id, which get greater ids than all there are, in order of their columns; columns that new ones lack are null."""
    last = rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))  # one row
    given = ranked(new, *new.columns, name="nth").join(F.broadcast(last)).withColumn("id", F.col("last") + F.col("nth") + 1).drop("nth", "last")
    return rows.unionByName(given, allowMissingColumns=True).select(*rows.columns)


def set_response(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """rows with ai_response from updates (id, ai_response) where there is one."""
    u = updates.select("id", F.col("ai_response").alias("new_response"), F.lit(True).alias("has_new"))
    return rows.join(u, "id", "left").withColumn("ai_response", F.when(F.col("has_new"), F.col("new_response")).otherwise(F.col("ai_response"))).select(*rows.columns)


def violations(members: DataFrame) -> DataFrame:
    """(file_path, n_groups) of files in more than one group; members: (group_id, chunk_id, file_path)."""
    return members.groupBy("file_path").agg(F.countDistinct("group_id").alias("n_groups")).filter("n_groups > 1")


def primary_group(members: DataFrame) -> DataFrame:
    """(file_path, group_id): the group with most of a file's chunks, ties to the lowest."""
    n = members.groupBy("file_path", "group_id").agg(F.countDistinct("chunk_id").alias("n"))
    return n.groupBy("file_path").agg(F.max_by("group_id", F.struct("n", -F.col("group_id"))).alias("group_id"))
