"""Packing, hunks and moves against plain loops."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import diffs


def loop_parts(sizes, limit, begin):
    parts, used, part = [], None, 0
    for s in sizes:
        if used is None or used + s > limit:
            part, used = part + 1, begin + s
        else:
            used += s
        parts.append(part)
    return parts


@pytest.mark.parametrize("fold", [2000, 3])
def test_packing_matches_a_loop(spark, monkeypatch, fold):
    monkeypatch.setattr(diffs, "FOLD", fold)
    rng = random.Random(4)
    rows, want = [], {}
    for key in range(9):
        sizes = [rng.choice([0, 0, 1, 5, 9, 20, 40, 41, 100]) for _ in range([1, 2, 3, 4, 50, 80, 7, 120, 30][key])]
        rows += [(f"k{key}", key % 2, 10 * i, s, 3 * (key % 3)) for i, s in enumerate(sizes)]
        for i, part in enumerate(loop_parts(sizes, 40, 3 * (key % 3))):
            want[f"k{key}", 10 * i] = part
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, g int, n int, size int, head int")
    got = {(r.k, r.n): r.part for r in diffs.packed(df, ["k", "g"], "n", F.col("size"), 40, F.col("head")).collect()}
    assert got == want
    assert diffs.packed(df.filter("false"), ["k"], "n", F.col("size"), 40).count() == 0


def test_packing_of_one_long_key(spark):
    """No row holds a key: its parts come from jumps."""
    n = 200_000
    df = spark.range(n).select(F.lit("x").alias("k"), "id", (F.col("id") * 7919 % 60).alias("size"))
    got = diffs.packed(df, ["k"], "id", F.col("size"), 100).groupBy("part").agg(F.min("id").alias("first")).orderBy("part").collect()
    parts = loop_parts([i * 7919 % 60 for i in range(n)], 100, 0)
    assert [r["first"] for r in got] == [i for i in range(n) if i == 0 or parts[i] != parts[i - 1]]


def test_hunks_keep_their_lines(spark):
    texts = [
        "diff --git a/x b/x\n@@ -1,2 +3,4 @@ f\n+one\n two\n-three\n+\n++four\n\n@@ -9 +8 @@\n+last\n",
        "diff --git a/x b/x\r\n@@ -1 +1 @@\r\n+a\r\n b\r\n@@ -5 +6 @@\r\n+c\r\n\r\n",
        "diff --git a/x b/x\n@@ odd\n@@ -1 +2 @@\n",
        "diff --git a/x b/x\nno hunk",
        "@@ -1 +1 @@\n+x\n @@ inside\n-@@\n@@ -2 +2 @@",
    ]
    rows = spark.createDataFrame([(i, 1, "x", t) for i, t in enumerate(texts)], "diff_id int, nth int, file_path string, content string")
    got = {(r.diff_id, r.hunk_no): (r.header, r.target_start, r.body, r.added) for r in diffs.hunks(rows).collect()}
    want = {}
    for i, t in enumerate(texts):
        lines, n = re.split(r"\r\n|\n|\r", re.sub(r"(\r\n|\n|\r)\Z", "", t)), 0
        for line in lines:
            if line.startswith("@@"):
                n += 1
                start = re.match(r"@@ -\d+(?:,\d+)? \+(\d+)", line)
                want[i, n] = [line, int(start[1]) if start else None, [line]]
            elif n:
                want[i, n][2].append(line)
    assert got == {k: (h, s, "\n".join(b), [x[1:] for x in b if x.startswith("+")]) for k, (h, s, b) in want.items()}


def test_moves_match_all_pairs(spark, monkeypatch):
    """A name that half of the files have, blocks of three rows."""
    monkeypatch.setattr(diffs, "MEET", 3)
    rng = np.random.default_rng(8)
    files = [[(f"{side}{i}/{'index.js' if i % 2 else f'n{i % 7}.js'}", [] if i == 4 else [0.0, 0.0] if i == 9 else rng.normal(size=3 if i % 11 else 2).round(1).tolist()) for i in range(60)] for side in "da"]
    files[0].append(("z/index.js", None))
    want = {}
    for p, u in files[0]:
        best = (0.5, "")
        for q, v in sorted(files[1]):
            if p.split("/")[-1] == q.split("/")[-1] and u and v and len(u) == len(v) and np.linalg.norm(u) * np.linalg.norm(v) > 0:
                s = round(float(np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v)), 12)
                if s > best[0] or (s == best[0] and not best[1]):
                    best = (s, q)
        if best[1]:
            want[p] = (best[1], round(best[0], 9))
    d, a = (spark.createDataFrame(f, "path string, vector array<double>") for f in files)
    assert {r.source: (r.target, round(r.similarity, 9)) for r in diffs.moves(d, a, 0.5).collect()} == want
    assert diffs.moves(d.filter("false"), a).count() == 0
