"""Reachability, merge bases and orders of histories, against plain loops."""

import random

import pytest

from sparkloom.operators import ancestry, history

EDGES = "commit_id string, parent_id string"


def random_history(seed, n=120):
    rng = random.Random(seed)
    rows = [("c000", None)]
    for i in range(1, n):
        for p in {rng.randrange(max(0, i - 9), i) for _ in range(rng.choice([1, 1, 1, 2, 3]))}:
            rows.append((f"c{i:03}", f"c{p:03}" if rng.random() < 0.98 else None))
    return rows


def up(rows):
    out = {}
    for c, p in rows:
        out.setdefault(c, set()).update({p} - {None, c})
        if p:
            out.setdefault(p, set())
    return out


def reached(parents, head):
    seen, todo = set(), [head]
    while todo:
        c = todo.pop()
        if c not in seen:
            seen.add(c)
            todo += parents.get(c, ())
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_random_histories(spark, seed):
    rows = random_history(seed)
    parents = up(rows)
    c = ancestry.chains(spark.createDataFrame(rows, EDGES))
    rng = random.Random(seed)
    heads = [(f"h{i}", f"c{rng.randrange(120):03}") for i in range(12)] + [("none", "absent")]
    got = {(r.head, r.commit_id) for r in ancestry.ancestors(None, spark.createDataFrame(heads, "head string, commit_id string"), c).collect()}
    assert got == {(h, x) for h, y in heads for x in reached(parents, y)}
    pairs = [tuple(f"c{rng.randrange(120):03}" for _ in range(2)) for _ in range(40)]
    want = set()
    for a, b in pairs:
        both = reached(parents, a) & reached(parents, b)
        want |= {(a, b, x) for x in both if not any(x != y and x in reached(parents, y) for y in both)}
    got = {tuple(r) for r in ancestry.merge_bases(None, spark.createDataFrame(pairs, "left string, right string"), c).select("left", "right", "commit_id").collect()}
    assert got == want
    deep = {}
    for x in sorted(parents):
        deep[x] = 1 + max((deep[p] for p in parents[x]), default=-1)
    assert {r.commit_id: r.generation for r in ancestry.generations(c).collect()} == deep


def test_a_straight_history_of_20000_commits(spark):
    n, jobs = 20_000, spark.sparkContext.statusTracker()
    rows = spark.range(n).selectExpr("printf('%05d', id) AS commit_id", "IF(id > 0, printf('%05d', id - 1), NULL) AS parent_id")
    spark.sparkContext.setJobGroup("straight", "straight")
    c = ancestry.chains(rows)
    heads = spark.createDataFrame([("h", "19999"), ("m", "09999")], "head string, commit_id string")
    assert {r["head"]: r["count"] for r in ancestry.ancestors(None, heads, c).groupBy("head").count().collect()} == {"h": n, "m": n // 2}
    assert c.foot.count() == 1 and c.exits.count() == 0
    assert len(jobs.getJobIdsForGroup("straight")) < 250  # some 15 rounds twice, of a few jobs each, and not 20000
    spark.sparkContext.setJobGroup("other", "other")


def test_merge_base_and_order(spark):
    rows = spark.createDataFrame([("e", "d"), ("d", "b"), ("c", "b"), ("b", "a"), ("a", None), ("m", "e"), ("m", "c"), ("x", None)], EDGES)
    pairs = spark.createDataFrame([("e", "c"), ("m", "c"), ("a", "a"), ("e", "x")], "left string, right string")
    assert {tuple(r) for r in ancestry.merge_bases(rows, pairs).select("left", "right", "commit_id").collect()} == {("e", "c", "b"), ("m", "c", "c"), ("a", "a", "a")}
    order = [r.commit_id for r in ancestry.topological_order(rows).orderBy("place").collect()]
    assert order == ["m", "e", "d", "b", "c", "a", "x"] or all(order.index(c) < order.index(p) for c, p in [("m", "e"), ("e", "d"), ("d", "b"), ("m", "c"), ("c", "b"), ("b", "a")])
    log = spark.createDataFrame([(c, i, f"{c} first\nrest") for i, c in enumerate("abcdemx")], "commit_id string, ord int, message string")
    assert {r.commit_id for r in history.log_until_base(log, rows, "c", "e").collect()} == {"d", "e", "c"} - {"c"}
    assert {r.commit_id for r in history.log_until_base(log, rows, "x", "e").collect()} == set("abde")
    with pytest.raises(ValueError, match="cycle"):
        ancestry._MOST = 4
        try:
            ancestry.chains(spark.createDataFrame([("a", "b"), ("b", "a")], EDGES))
        finally:
            ancestry._MOST = 64


def test_histories_are_not_broadcast(spark):
    """What heads reach is joined with all commits, which grow with the history, by sorting."""
    rows = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b")], EDGES)
    found = ancestry.ancestors(rows, spark.createDataFrame([("h", "c")], "head string, commit_id string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan.split("Union")[1].split("LeftAnti")[0]
    assert {r.commit_id for r in found.collect()} == {"a", "b", "c"}
