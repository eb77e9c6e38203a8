import hashlib
import math
import random

import numpy as np
import pytest

from sparkloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, id long, v string"


def lloyd(rows, k, rounds, dims):
    """Plain rounds over Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in map(float, e)]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    c = [v for _, v in sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"3:{x[0]}".encode()).hexdigest(), x[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted((i is None, i, near(v)[1], near(v)[0]) for i, v in kept), c


def rows_of(found):
    return sorted((r.id is None, r.id, r.cluster, r.distance) for r in found.rows.collect())


@pytest.mark.parametrize("k, seed", [(8, 0), (20, 1), (1, 2)])
def test_matches_plain_rounds(spark, k, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(12)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.2))) for x in centres[i % 12]]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # a group of copies
    found = centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5), k, 6, 4)
    want, c = lloyd(rows, k, 6, 4)
    assert rows_of(found) == want
    assert found.centroids == c
    assert sum(found.inertia) == sum(w[3] for w in want)


def test_ties_go_to_the_smaller_number(spark):
    """Vectors on a grid lie at equal distances of many centroids, and several centroids are one point."""
    rows = [(i, [float(i % 3 - 1), float(i // 3 % 3 - 1)]) for i in range(90)]
    found = centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 8, 4, 2)
    want, c = lloyd(rows, 8, 4, 2)
    assert rows_of(found) == want and found.centroids == c


def test_bounds_spare_distances(spark):
    rng = random.Random(4)
    rows = [(i, [float(8 * (i % 25)) + rng.gauss(0, 0.5), rng.gauss(0, 0.5)]) for i in range(2000)]
    found = centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 25, 8, 2)
    assert found.taken[0] <= 2000 * 26 and max(found.taken[2:]) < 2000 * 25 / 3
    assert rows_of(found) == lloyd(rows, 25, 8, 2)[0]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (1, [3.0, 1.0]), (None, [0.25, 1.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, -inf]), (8, [1.0, 2.0, 3.0]), (9, [-0.0001, 1e-30]), (10, [-1.0, 1.0])]
    docs = spark.createDataFrame([(*r, None, 7, 8, "x") for r in rows], SCHEMA)
    want, _ = lloyd(rows, 3, 3, 2)
    assert rows_of(centroids.clustered(docs, 3, 3, 2)) == want
    assert len(want) == 6
    assert centroids.digest(centroids.clustered(docs.filter("false"), 3, 3, 2)).collect() == []
    assert rows_of(centroids.clustered(docs.filter("vec_id IS NULL"), 3, 3, 2)) == []


def test_great_components_are_exact(spark):
    """Products over 2^53 are taken in integers, and components are held within 2^27."""
    rows = [(i, [90000.0 + i / 1024, -90000.0 - 3 * i / 1024]) for i in range(40)] + [(99, [3e38, 0.0])]
    got = rows_of(centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 4, 3, 2))
    assert got == lloyd([*rows[:-1], (99, [centroids.MOST / 1024, 0.0])], 4, 3, 2)[0]


def test_digest(spark, small):
    from sparkloom.llm import queries

    out = queries.op11_centroids(spark, small).collect()
    assert len({r.inertia for r in out}) == 1 and out[0].inertia == sum(r.distance for r in out)
    assert {(r.cluster, r.cluster_inertia) for r in out} == {(j, sum(r.distance for r in out if r.cluster == j)) for j in {r.cluster for r in out}}
