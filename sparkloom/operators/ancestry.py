"""Reachability in commit histories by chains, in rounds that grow with the logarithm of the depth.

Following one parent of each commit gives a forest. Its longest paths are the
chains: a commit goes on with that child whose line is longest. Along a chain,
whatever reaches a commit reaches all below it, so what a head reaches is one
position on each chain it meets, and all else is joins between chains: a round
for each change from chain to chain that a path makes (a branch of a branch),
however long the chains are. Depths, heights and chains come from jumps that
double in length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import Staged, ranked, staged

#: More rounds of doubling than any history without a cycle has.
_MOST = 64


@dataclass
class Chains:
    """commits: commit_id, chain, depth; exits: (chain, at, to_chain, to_at), a parent on another chain; foot: (chain, foot), the least depth on it; edges: (commit_id, parent_id)."""

    commits: DataFrame
    exits: DataFrame
    foot: DataFrame
    edges: DataFrame


def _large(rows: DataFrame) -> DataFrame:
    """rows that grow with the history: joined by sorting both sides, so that no round sends them through the driver to be broadcast, however well their files are packed."""
    return rows.hint("merge")


def chains(parents: DataFrame) -> Chains:
    """The chains of a history (commit_id, parent_id; null for none). Commits that are only named as parents count too; a commit that is its own parent has none; other cycles are an error."""
    spark = parents.sparkSession
    own = Staged(spark)
    edges = own(parents.filter("parent_id IS NOT NULL AND commit_id <> parent_id").select("commit_id", "parent_id").distinct(), "edges")
    ids = parents.select("commit_id").unionByName(edges.select(F.col("parent_id").alias("commit_id"))).filter("commit_id IS NOT NULL").distinct()
    first = edges.groupBy("commit_id").agg(F.min("parent_id").alias("up"))
    t = own(ids.join(_large(first), "commit_id", "left").select(F.col("commit_id").alias("id"), "up", F.col("up").alias("jump"), F.col("up").isNotNull().cast("long").alias("depth"), F.lit(0).cast("long").alias("tall")), "jumps")
    length, turn = 1, None
    while t.filter("jump IS NOT NULL").limit(1).count():
        if length.bit_length() > _MOST:
            raise ValueError("the history has a cycle")
        now = Staged(spark)
        above = t.groupBy(F.col("jump").alias("id")).agg((F.max("tall") + length).alias("above"))
        there = t.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("depth").alias("more"))
        t = now(t.join(_large(above), "id", "left").join(_large(there), "jump", "left").select("id", "up", F.col("next").alias("jump"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.greatest("tall", F.coalesce("above", F.lit(0))).alias("tall")), "jumps")
        if turn:
            turn.drop()
        length, turn = 2 * length, now
    on = t.filter("up IS NOT NULL").groupBy("up").agg(F.max(F.struct("tall", "id"))["id"].alias("id")).select("id", F.lit(True).alias("on"))
    c = own(t.join(_large(on), "id", "left").select("id", "depth", F.when(F.col("on"), F.col("up")).otherwise(F.col("id")).alias("chain")), "chains")
    if turn:
        turn.drop()
    turn = None
    while True:
        now = Staged(spark)
        there = c.select(F.col("id").alias("chain"), F.col("chain").alias("next"))
        c = now(c.join(_large(there), "chain").select("id", "depth", F.col("next").alias("chain"), (F.col("next") != F.col("chain")).alias("moved")), "chains")
        going = c.filter("moved").limit(1).count()
        c = c.drop("moved")
        if turn:
            turn.drop()
        turn = now
        if not going:
            break
    commits = staged(c.select(F.col("id").alias("commit_id"), "chain", "depth"), "commits")
    lower = commits.select(F.col("commit_id").alias("parent_id"), F.col("chain").alias("to_chain"), F.col("depth").alias("to_at"))
    exits = edges.join(_large(commits), "commit_id").join(_large(lower), "parent_id").filter("chain <> to_chain")
    exits = staged(exits.groupBy("chain", F.col("depth").alias("at"), "to_chain").agg(F.max("to_at").alias("to_at")), "exits")
    edges = staged(edges, "edges")
    turn.drop()
    own.drop()
    return Chains(commits, exits, commits.groupBy("chain").agg(F.min("depth").alias("foot")), edges)


def reach(c: Chains, heads: DataFrame) -> DataFrame:
    """(head, chain, at): on each chain the highest depth that heads (head, commit_id) reach; all below it on the chain are reached too."""
    found = heads.join(c.commits, "commit_id").groupBy("head", "chain").agg(F.max("depth").alias("at"))
    turn = Staged(c.commits.sparkSession)
    found = turn(found.withColumn("seen", F.lit(-1).cast("long")), "reach")
    while True:
        way = c.exits.select("chain", F.col("at").alias("exit"), "to_chain", "to_at")
        new = found.filter("at > seen").join(_large(way), "chain").filter("exit > seen AND exit <= at").groupBy("head", F.col("to_chain").alias("chain")).agg(F.max("to_at").alias("new"))
        now = Staged(c.commits.sparkSession)
        joined = found.join(new, ["head", "chain"], "full").select("head", "chain", F.greatest("at", "new").alias("at"), F.coalesce("at", F.lit(-1)).alias("seen"))
        found = now(joined, "reach")
        turn.drop()
        turn = now
        if not found.filter("at > seen").limit(1).count():
            return found.drop("seen")


def ancestors(parents: DataFrame, heads: DataFrame, c: Chains | None = None) -> DataFrame:
    """(head, commit_id): everything reachable from heads (head, commit_id), heads included."""
    c = c or chains(parents)
    named = heads.select("head", "commit_id").distinct()
    found = reach(c, named).join(_large(c.commits), "chain").filter("depth <= at").select("head", "commit_id")
    return found.unionByName(named.join(c.commits, "commit_id", "left_anti").select("head", "commit_id"))


def merge_bases(parents: DataFrame, pairs: DataFrame, c: Chains | None = None) -> DataFrame:
    """(left, right, commit_id): the common ancestors of each pair (left, right) of commits that no other common one descends from. Pairs without one have no row."""
    c = c or chains(parents)
    pairs = pairs.select("left", "right").distinct()
    heads = pairs.select(F.col("left").alias("commit_id")).unionByName(pairs.select(F.col("right").alias("commit_id"))).distinct().withColumn("head", F.col("commit_id"))
    r = reach(c, heads)
    x, y = r.select(F.col("head").alias("left"), "chain", F.col("at").alias("x")), r.select(F.col("head").alias("right"), "chain", F.col("at").alias("y"))
    common = staged(pairs.join(x, "left").join(y, ["right", "chain"]).select("left", "right", "chain", F.least("x", "y").alias("at")), "common")
    top = common.join(_large(c.commits), "chain").filter("depth = at").select("left", "right", "commit_id")
    # what is common holds all ancestors of its members, so one that another descends from has a child in it
    child = c.edges.join(_large(c.commits), "commit_id").select(F.col("parent_id").alias("commit_id"), "chain", "depth")
    under = top.join(child, "commit_id").join(common, ["left", "right", "chain"]).filter("depth <= at").select("left", "right", "commit_id").distinct()
    return top.join(under, ["left", "right", "commit_id"], "left_anti")


def generations(c: Chains) -> DataFrame:
    """(commit_id, generation): the longest way down to a commit without parents. Rounds are as many as a longest way changes chains."""
    by = Window.partitionBy("chain").orderBy("at", "exit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spark = c.commits.sparkSession
    foot = Staged(spark)
    exits = foot(c.exits.withColumn("lift", F.lit(None).cast("long")), "exits")
    feet = foot(c.foot, "foot")
    ends = c.commits.select("chain", F.col("depth").alias("at"), "commit_id")

    def risen(points: DataFrame) -> DataFrame:
        """points (chain, at and more) with generation: depth plus the highest lift of an exit below, on the chain."""
        rows = points.withColumns({"exit": F.lit(1), "lift": F.lit(None).cast("long")})
        rows = rows.unionByName(exits.select("chain", "at", "lift", F.lit(0).alias("exit")), allowMissingColumns=True)
        rows = rows.withColumn("most", F.max("lift").over(by)).filter("exit = 1").join(feet, "chain")
        return rows.withColumn("generation", F.col("at") + F.greatest(-F.col("foot"), F.coalesce("most", -F.col("foot")))).drop("exit", "lift", "most", "foot")

    turn = None
    while True:
        now = Staged(spark)
        to = risen(exits.select(F.col("to_chain").alias("chain"), F.col("to_at").alias("at")).distinct()).select(F.col("chain").alias("to_chain"), F.col("at").alias("to_at"), "generation")
        lift = F.col("generation") + 1 - F.col("at")
        new = now(exits.join(to, ["to_chain", "to_at"]).select("chain", "at", "to_chain", "to_at", lift.alias("lift"), (~lift.eqNullSafe(F.col("lift"))).alias("moved")), "exits")
        going = new.filter("moved").limit(1).count()
        exits = new.drop("moved")
        if turn:
            turn.drop()
        turn = now
        if not going:
            break
    out = staged(risen(ends).select("commit_id", "generation"), "generations")
    turn.drop()
    foot.drop()
    return out


def topological_order(parents: DataFrame) -> DataFrame:
    """(commit_id, generation, place): an order in which each commit stands before its parents, by descending generation, then id."""
    g = generations(chains(parents)).withColumn("down", -F.col("generation"))
    return ranked(g, "down", "commit_id").drop("down")
