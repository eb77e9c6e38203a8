"""The queries over whole tables, against DuckDB, and operators that worked on a part only."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import graph, search
from sparkloom.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["move_detection", "move_groups", "entity_edges", "vector_topk_per_query"])
def test_whole_tables(spark, name):
    with duckdb.connect() as db:
        for t in ("documents", "embeddings", "events"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        want = db.execute(registry.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        want = sorted(map(tuple, want.fetchall()))
    got = sorted(tuple(r) for r in registry.queries()[name](spark, SMALL).select(*columns).collect())
    assert len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert all(abs(a - b) < 1e-8 if isinstance(a, float) else a == b for a, b in zip(x, y, strict=True))


def test_queries_in_blocks(spark):
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50)], "id long, vector array<double>")
    queries = points.filter("id < 25").repartition(3)
    one, many = (sorted(map(tuple, search.top_k_many(points, queries, 3, block=b).collect())) for b in (100, 7))
    assert len(one) == 75 and one == many


def clustered(n, seed=3, dims=12, centres=40):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    v = middle[rng.integers(centres, size=n)] + rng.normal(size=(n, dims)) * 0.08
    v[: n // 10] = middle[0]  # a tenth are copies
    v[-2:] = 0
    return v


def test_pairs_within_match_a_matrix(spark):
    v = clustered(1200)
    labels = np.arange(1200) % 2
    points = spark.createDataFrame([(i, int(g), x.tolist()) for i, (g, x) in enumerate(zip(labels, v, strict=True))], "id long, label long, vector array<double>")
    size = np.linalg.norm(v, axis=1, keepdims=True)
    unit = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
    near = np.triu(1 - unit @ unit.T <= 0.05, 1)
    counts = {}
    got = {(r.a, r.b) for r in search.pairs_within(points, 0.05, block=50, counts=counts).collect()}
    assert got == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))
    assert counts["compared"] < 1200 * 1199 / 2 / 3
    got = {(r.a, r.b) for r in search.pairs_within(points, 0.05, block=50, within="label").collect()}
    assert got == set(zip(*(x.tolist() for x in np.nonzero(near & (labels[:, None] == labels))), strict=True))
    assert search.pairs_within(points, 1.2, block=400).count() == np.triu(1 - unit @ unit.T <= 1.2, 1).sum()
    assert search.pairs_within(points.filter("false"), 0.05).count() == 0


def test_a_grid_sends_a_row_as_often_as_it_has_bands(spark, monkeypatch):
    """Where all blocks meet, rows are sent once for each band and not for each block, and the pairs are those of a matrix."""
    monkeypatch.setattr(search, "GRID", 3)
    monkeypatch.setattr(search, "CELLS", 1000)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 24)).astype(np.float32)
    v[-2:] = 0
    labels = np.arange(600) % 2
    points = spark.createDataFrame([(i, int(g), x.tolist()) for i, (g, x) in enumerate(zip(labels, v, strict=True))], "id long, label long, vector array<float>")
    grid, sent = search._all_pairs, []

    def counted(c, own, eps):
        plan = grid(c, own, eps)
        sent.append(c.rows.agg(F.max("block")).first()[0] + 1)
        return plan

    monkeypatch.setattr(search, "_all_pairs", counted)
    v = v.astype(float)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    unit = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
    near = np.triu(1 - unit @ unit.T <= 0.6, 1)
    for within, want in ((None, near), ("label", near & (labels[:, None] == labels))):
        got = [(r.a, r.b) for r in search.pairs_within(points, 0.6, block=25, within=within).collect()]
        assert sorted(got) == sorted(zip(*(x.tolist() for x in np.nonzero(want)), strict=True))
    assert sent == [24, 24]
    clear = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(clustered(900, centres=45)[90:-2])], "id long, vector array<double>")
    assert search.pairs_within(clear, 0.01, block=20).count() and len(sent) == 2


def test_compared_pairs_grow_below_the_square(spark):
    """Four times the points in as dense neighbourhoods: the square would be 16 times the pairs."""
    found = []
    for n in (800, 3200):
        v = clustered(n, centres=n // 20)
        points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[n // 10 : -2])], "id long, vector array<double>")
        counts = {}
        search.pairs_within(points, 0.01, block=40, counts=counts).count()
        found.append(counts["compared"])
    assert found[1] < 9 * found[0]


def test_nearest_match_a_matrix(spark):
    v = clustered(900)
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    size = np.linalg.norm(v, axis=1, keepdims=True)
    unit = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
    score = np.round(unit @ unit.T, 9)
    counts = {}
    got = {(r.query_id, r["rank"]): r.id for r in search.top_k_many(points, points.filter("id % 7 = 0"), 4, block=40, counts=counts).collect()}
    want = {(i, n): j for i in range(0, 900, 7) for n, j in enumerate(np.lexsort((np.arange(900), -score[i]))[:4].tolist(), 1)}
    assert got == want
    assert counts["visits"] < 129 * counts["blocks"] / 2
    assert search.top_k_many(points.filter("false"), points, 4).count() == 0
    assert search.top_k_many(points.limit(2), points.filter("id < 3"), 4, block=1).count() == 6


def test_call_counts_are_those_of_the_edges(spark):
    names = spark.createDataFrame([(1, "f"), (2, "a.f"), (3, "g"), (4, "g"), (5, "h")], "id int, name string")
    calls = spark.createDataFrame([(9, "a.f"), (9, "b.f"), (9, "f"), (3, "x.g"), (3, "g"), (9, "nope"), (5, "h"), (1, "g")], "src int, called string")
    want = {r.src: r["count"] for r in graph.call_edges(calls, names).groupBy("src").count().collect()}
    assert {r.src: r.n for r in graph.call_counts(calls, names).collect()} == want
