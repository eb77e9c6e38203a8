"""Greedy groups, consolidation, ranks, inserts and documents, against plain loops."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import chunks, clusters, components, diffs, docs, history, tree
from sparkloom.sources import code, config

PATHS = ["src/a.py", "tests/test_a.py", "docs/x.md", "lib/q/r.rb", "package.json", "yarn.lock", "src/b/c.py", "z.go", "src/a.py"]


def test_leaders_match_a_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(3)), rng.normal(size=4).tolist()) for i in range(80)]
    want = {}
    for label in range(3):
        led = []
        for i, _, v in (r for r in rows if r[1] == label):
            near = [j for j, u in led if np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= 0.4]
            want[i] = near[0] if near else i
            if not near:
                led.append((i, v))
    p = spark.createDataFrame(rows, "id long, label long, vector array<double>")
    assert {r.id: r.leader for r in clusters.leader_clusters(p, "label", 0.4).collect()} == want
    assert clusters.leader_clusters(p.filter("false"), "label", 0.4).count() == 0


def test_consolidation_matches_a_loop(spark):
    rng = random.Random(3)
    rows = [(c, o, rng.choice(PATHS)) for c in range(6) for o in range(1, 2 + 2 * c)]
    pairs = {(a, b) for a in PATHS for b in PATHS}
    known = spark.createDataFrame(sorted(pairs), "a string, b string").filter(clusters.related(F.col("a"), F.col("b"))).collect()
    alike, want = {(r.a, r.b) for r in known}, {}
    for c in range(6):
        own = [(o, p) for x, o, p in rows if x == c]
        done = set()
        for i, (o, p) in enumerate(own):
            if o in done:
                continue
            files = {p}
            want[c, o] = o
            for later, q in own[i + 1 :]:
                if later in done or len(own) < 2 or len(files) > 1 or not (p == q or (p, q) in alike):
                    continue
                done.add(later)
                files.add(q)
                want[c, later] = o
            done.add(o)
    got = clusters.consolidated(spark.createDataFrame(rows, "change_id long, ord long, path string")).collect()
    assert {(r.change_id, r.ord): r.into for r in got} == want


NAMES = [*PATHS, "tests/src/a.py", "tests/lib/q/r.rb", "test_z.go", "z_test.py", "z.py", "ab.py", "abc.txt", "xabcx.md", "README.md", "src/main.rs", "tests/e2e.rs", "Dockerfile", ".dockerignore", "a", "go.mod", "go.sum", "é/ö.kt", "spec/x_spec.rb", "x.rb"]


def plainly_related(spark):
    known = spark.createDataFrame([(a, b) for a in NAMES for b in NAMES], "a string, b string").filter(clusters.related(F.col("a"), F.col("b"))).collect()
    return {(r.a, r.b) for r in known}


def test_related_pairs_by_keys(spark):
    """The same pairs as by comparing every two files."""
    rng = random.Random(9)
    alike = plainly_related(spark)
    rows = [(c, i, rng.choice(NAMES)) for c in range(5) for i in range(3 + 6 * c)]
    got = {tuple(r) for r in clusters.related_pairs(spark.createDataFrame(rows, "change_id long, id long, path string")).collect()}
    assert got == {(c, i, j) for c, i, p in rows for d, j, q in rows if c == d and i < j and (p, q) in alike}


def test_related_pairs_shuffle_no_pairs(spark, monkeypatch):
    """Of files of few paths the pairs are made after all exchanges; blocks, doubled rows and ids of several paths lose and repeat nothing."""
    monkeypatch.setattr(clusters, "MET", 7)
    rng = random.Random(11)
    alike = plainly_related(spark)
    rows = [(c, i, rng.choice(NAMES[:6])) for c in range(2) for i in range(90)]
    columns = "change_id long, id long, path string"
    found = clusters.related_pairs(spark.createDataFrame(rows + rows[:20], columns))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and not any(x in plan[: plan.index("Generate")] for x in ("Aggregate", "Join", "Repartition", "Distinct"))
    want = [(c, i, j) for c, i, p in rows for d, j, q in rows if c == d and i < j and (p, q) in alike]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    two = [*rows, (0, 5, "README.md"), (0, 5, "go.mod")]
    want = {(c, i, j) for c, i, p in two for d, j, q in two if c == d and i < j and (p, q) in alike}
    assert sorted(tuple(r) for r in clusters.related_pairs(spark.createDataFrame(two, columns)).collect()) == sorted(want)


def test_related_pairs_are_given_on_in_runs(spark):
    """The two explodes are in code of their own, so one id's pairs are held and not those of two blocks; each id's pairs are runs in order."""
    files = spark.range(1200).select(F.lit(1).alias("change_id"), "id", F.concat(F.lit("src/a"), F.col("id") % 2, F.lit(".py")).alias("path"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = clusters.related_pairs(files)
        stages = re.findall(r"\*\((\d+)\) Generate explode", found._jdf.queryExecution().executedPlan().toString())
        rows = [(r.a, r.b) for r in found.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(stages) == len(set(stages)) == 2
    assert len(rows) == len(set(rows)) == 1200 * 1199 // 2 and all(a < b for a, b in rows)
    runs = 1 + sum(a != c and b != d or (a, b) > (c, d) for (a, b), (c, d) in itertools.pairwise(rows))
    assert runs < 2 * 1200 * 2


def test_related_groups_match_a_loop(spark):
    rng = random.Random(10)
    alike = plainly_related(spark)
    rows, want = [(c, i, rng.choice(NAMES)) for c in range(6) for i in range(2 + 4 * c)], {}
    for c in range(6):
        led = []
        for _, i, p in (r for r in rows if r[0] == c):
            near = [j for j, q in led if (q, p) in alike]
            want[c, i] = near[0] if near else i
            led += [] if near else [(i, p)]
    files = spark.createDataFrame(rows, "change_id long, id long, path string")
    assert {(r.change_id, r.id): r.leader for r in clusters.related_groups(files).collect()} == want
    assert clusters.related_groups(files.filter("false")).count() == 0


def test_one_change_of_20000_files(spark):
    """Four top directories: the files of each follow its first, and no pairs are made."""
    files = spark.range(20_000).select(F.lit(1).alias("change_id"), "id", F.concat(F.lit("top"), F.col("id") % 4, F.lit("/d"), F.col("id") % 50, F.lit("/"), F.sha2(F.col("id").cast("string"), 256)).alias("path"))
    got = clusters.related_groups(files).groupBy("leader").count().collect()
    assert {r.leader: r["count"] for r in got} == {i: 5000 for i in range(4)}


def test_repair_of_files_that_share_groups(spark):
    """Unlike groups: every file ends in one group, and no chunk is lost."""
    rng = random.Random(5)
    rows = sorted({(rng.randrange(12), f"c{i}", f"f{i % 9}") for i in range(40)})
    vectors = spark.createDataFrame([(f"c{i}", [float(i == k) for k in range(40)]) for i in range(40)], "chunk_id string, vector array<double>")
    out = clusters.repaired(spark.createDataFrame(rows, "group_id long, chunk_id string, file_path string"), vectors)
    assert history.violations(out).count() == 0
    assert {(r.chunk_id, r.file_path) for r in out.collect()} == {(c, f) for _, c, f in rows}


def repaired_one_by_one(rows, vectors, least=0.6):
    """One file after another, groups in order: a plain loop over lists."""
    groups = {g: {} for g, _, _ in sorted(rows)}
    for g, c, f in rows:
        groups[g].setdefault(c, set()).add(f)
    gone = set()
    while True:
        held = {}
        for g, own in groups.items():
            for f in sorted(set().union(*own.values())):
                held.setdefault(f, []).append(g)
        bad = next((f for f in held if len(held[f]) > 1), None)
        if bad is None:
            return {(g, c, f) for g, own in groups.items() for c, files in own.items() for f in files}
        most, pair = 0, None
        for i, a in enumerate(held[bad]):
            for b in held[bad][i + 1 :]:
                s = [np.dot(vectors[x], vectors[y]) / np.linalg.norm(vectors[x]) / np.linalg.norm(vectors[y]) for x in groups[a] for y in groups[b]]
                if round(float(np.mean(s)), 12) > most:
                    most, pair = round(float(np.mean(s)), 12), (a, b)
        if pair and most >= least:
            groups[pair[0]] |= groups.pop(pair[1])
            continue
        to = max(held[bad], key=lambda g: (sum(bad in files for files in groups[g].values()), -g))
        moving = [(g, c) for g in held[bad] if g != to for c, files in groups[g].items() if bad in files]
        again = [g for g, c in moving if c in gone]
        if again:
            groups[min(to, again[0])] |= groups.pop(max(to, again[0]))
            continue
        for g, c in moving:
            gone.add(c)
            groups[to][c] = groups[g].pop(c)
        groups = {g: own for g, own in groups.items() if own}


@pytest.mark.parametrize("small, cases", [(clusters.SMALL, 50), (0, 5)])
def test_repair_matches_a_loop(spark, monkeypatch, small, cases):
    """Inputs at once (they share no group), with files in three to six groups and chunks of several files; in one task each, and in rounds."""
    monkeypatch.setattr(clusters, "SMALL", small)
    rng = np.random.default_rng(12)
    rows, vectors = [], {}
    for case in range(cases):
        n_groups = 3 + case % 4
        for c in range(10 + case % 5):
            chunk = f"{case}-{c}"
            vectors[chunk] = rng.normal(size=2 + case % 3).round(3).tolist()
            g = int(rng.integers(n_groups)) + 10 * case
            for f in set(rng.integers(4, size=1 + case % 2).tolist()):
                rows.append((g, chunk, f"{case}/{f}"))
    want = set()
    for case in range(cases):
        own = [r for r in rows if r[1].startswith(f"{case}-")]
        want |= repaired_one_by_one(own, vectors)
    out = clusters.repaired(spark.createDataFrame(rows, "group_id long, chunk_id string, file_path string"), spark.createDataFrame(list(vectors.items()), "chunk_id string, vector array<double>"))
    assert {(r.group_id, r.chunk_id, r.file_path) for r in out.collect()} == want


def test_repair_merges_one_pair_at_a_time(spark):
    """Groups 1 and 2 merge (0.90); their mean is not like group 3 (0.41), so its chunk of f moves and the other stays."""
    angles = {"1": 0, "2": 26, "3": 78, "4": 78}
    vectors = spark.createDataFrame([(c, [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))]) for c, a in angles.items()], "chunk_id string, vector array<double>")
    rows = [(1, "1", "f"), (2, "2", "f"), (3, "3", "f"), (3, "4", "g")]
    out = clusters.repaired(spark.createDataFrame(rows, "group_id long, chunk_id string, file_path string"), vectors)
    assert {(r.chunk_id, r.group_id) for r in out.collect()} == {("1", 1), ("2", 1), ("3", 1), ("4", 3)}


def test_repair_of_nothing_and_missing_vectors(spark):
    none = spark.createDataFrame([], "group_id long, chunk_id string, file_path string")
    vectors = spark.createDataFrame([("a", None), ("b", [0.0, 0.0])], "chunk_id string, vector array<double>")
    assert clusters.repaired(none, vectors).count() == 0
    rows = [(1, "a", "f"), (2, "b", "f"), (2, "c", "f"), (3, "d", None)]
    out = clusters.repaired(spark.createDataFrame(rows, none.schema), vectors)
    assert {(r.chunk_id, r.group_id) for r in out.collect()} == {("a", 2), ("b", 2), ("c", 2)}


@pytest.mark.parametrize("small", [clusters.SMALL, 11, 0])
def test_repair_within_changes(spark, monkeypatch, small):
    """Changes (one of them null) that use the same ids for other things: each comes out as if it were alone, whether in a task, cut up, or in rounds."""
    monkeypatch.setattr(clusters, "SMALL", small)
    rng = np.random.default_rng(7)
    rows, want = [], []
    for change in (None, *range(3 if small == 0 else 12)):
        vectors = {f"c{i}": rng.normal(size=3).round(3).tolist() for i in range(8 + (change or 0) % 5)}
        own = sorted({(int(rng.integers(4)), c, f"f{rng.integers(3)}") for c in vectors})
        rows += [(change, g, c, f, vectors[c]) for g, c, f in own + own[:2]]
        want += repaired_one_by_one(own, vectors)
    members = spark.createDataFrame(rows, "change int, group_id long, chunk_id string, file_path string, vector array<double>")
    assert sorted(map(tuple, clusters.repaired(members, within="change").collect())) == sorted(want)


def test_repair_within_changes_shuffles_once(spark):
    """Rows of a change are brought together once, with their vectors, and nothing is joined or written on the way."""
    rows = spark.createDataFrame([("x", 1, "a", "f", [1.0]), ("x", 2, "b", "f", [1.0]), ("y", 1, "a", "f", [1.0])], "change string, group_id long, chunk_id string, file_path string, vector array<double>")
    out = clusters.repaired(rows, within="change")
    plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, out.collect())) == [(1, "a", "f"), (1, "a", "f"), (1, "b", "f")]


def test_repair_keeps_the_files_of_a_chunk_in_two_groups(spark):
    """Groups 1 and 2 merge, and chunk a, which both hold, keeps both of its files."""
    rows = spark.createDataFrame([(1, "a", "f"), (2, "a", "g"), (2, "b", "f")], "group_id long, chunk_id string, file_path string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0])], "chunk_id string, vector array<double>")
    assert sorted(map(tuple, clusters.repaired(rows, vectors).collect())) == [(1, "a", "f"), (1, "a", "g"), (1, "b", "f")]


def test_most_similar_pairs_in_slices(monkeypatch):
    """Pairs are compared in slices, equal ones by place, rows without a number as 0."""
    rng = np.random.default_rng(3)
    mean, lengths = rng.normal(size=(60, 3)).round(1), np.array([2, 5, 3, 20, 2, 2, 26])
    mean[8:10], mean[0] = mean[7], np.nan
    for compared in (1, 7, 100, 10**6):
        monkeypatch.setattr(clusters, "COMPARED", compared)
        s, x, y = clusters._most_similar(mean, lengths)
        for k, (n, end) in enumerate(zip(lengths, np.cumsum(lengths))):
            pairs = [(-float(np.nan_to_num(np.rint(mean[i] @ mean[j] * 1e12) / 1e12)), i, j) for i in range(end - n, end) for j in range(i + 1, end)]
            assert abs(min(pairs)[0] + s[k]) < 1e-9 and min(pairs)[1:] == (x[k], y[k])


def test_ranks_are_those_of_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r.place == r.k for r in components.ranked(rows, "k").collect())
    assert components.ranked(rows.filter("false"), "k").count() == 0


def test_messages_get_new_ids(spark):
    old = spark.createDataFrame([(3, "s", "a", "x"), (9, "s", "b", "y")], "id long, session_id string, user_query string, ai_response string")
    out = history.add_messages(old, old.select("session_id", "user_query")).collect()
    assert len({r.id for r in out}) == 4 and sorted(r.id for r in out)[:2] == [3, 9]
    assert {r.ai_response for r in out if r.id > 9} == {None}
    assert [r.id for r in history.add_messages(old.filter("false"), old.select("session_id", "user_query").limit(1)).collect()] == [1]


def test_document(spark, tmp_path):
    files = spark.createDataFrame([("b/x.py", "def f():\n    return 1\n"), ("a.py", "class C:\n    pass\n")], "file_path string, content string")
    e = code.entities(files)
    lines = docs.document(e, "repo", chunks.SIGNATURES).orderBy("part", "place").collect()
    text = [r.line for r in lines]
    assert text[0] == "# Documentation of repo" and "- Files scanned: 2" in text and "- Lines of code: 4" in text and "- Languages: python" in text
    assert text.index("├── b/") < text.index("└── a.py") < text.index("- [a.py](#apy)") < text.index("- [b/x.py](#b-xpy)")
    assert text[-1].startswith("### b/x.py")
    path = docs.write_document(docs.document(e, "repo", chunks.SIGNATURES), str(tmp_path), "1")
    assert path.endswith("documentation_1.md") and spark.read.text(path).count() > len(lines)
    assert tree.repository_stats(e).first().files_processed == 2


def test_split_falls_back_to_files(spark):
    good = "diff --git a/x.txt b/x.txt\n@@ -1 +1 @@\n+a\n@@ -5 +5 @@\n+b"
    rows = [(1, good), (2, good.replace("@@ -5 +5 @@", "@@ what @@")), (3, "")]
    got = {(r.diff_id, r.part, r.kind) for r in diffs.split(spark.createDataFrame(rows, "diff_id long, content string")).collect()}
    assert got == {(1, 1, "hunk"), (1, 2, "hunk"), (2, 1, "file")}


def test_a_cluster_must_name_its_folder():
    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://x:7077"

            class getConf:
                get = staticmethod(lambda key: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        components.staging_folder(Elsewhere)


def test_settings_files(tmp_path):
    below = tmp_path / "a" / "b"
    below.mkdir(parents=True)
    (tmp_path / "sparkloom.json").write_text('{"sync": {"debounce_seconds": 3}}')
    assert config.load(str(below), {}).sync.debounce_seconds == 3
    (below / "sparkloom.json").write_text('{"embedding": {"dimension": 8}}')
    found = config.load(str(below), {})
    assert found.embedding.dimension == 8 and found.sync.debounce_seconds == 1.0
    assert config.load(str(below), {"SPARKLOOM_CONFIG": str(tmp_path / "sparkloom.json")}).sync.debounce_seconds == 3
    (below / "sparkloom.json").write_text("[1]")
    with pytest.raises(ValueError, match="no settings"):
        config.load(str(below), {})
    pytest.importorskip("yaml")
    (below / "sparkloom.yml").write_text("diffs:\n  part_limit: 7\n")
    assert config.load(str(below), {}).diffs.part_limit == 7


def test_components_match_a_loop(spark):
    rng = random.Random(7)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)] + [(500, 500 + i) for i in range(1, 40)] + [(3, 3)]
    up = {x: x for p in pairs for x in p}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {x for a, b in pairs if a != b for x in (a, b)}}
    assert components.connected_components(spark.createDataFrame(pairs, "a long, b long").filter("false")).count() == 0


def test_linkage_matches_a_matrix(spark):
    rng = np.random.default_rng(11)
    rows = [(i, int(rng.integers(2)), rng.normal(size=3).tolist()) for i in range(90)]
    want = {}
    for label in range(2):
        own = [r for r in rows if r[1] == label]
        v = np.array([r[2] for r in own])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        want |= {own[i][0]: own[j][0] for i, j in enumerate(clusters.complete_linkage(1 - v @ v.T, 0.5).tolist())}
    p = spark.createDataFrame(rows, "id long, label long, vector array<double>")
    assert {r.id: r.cluster for r in clusters.linkage_clusters(p, "label", threshold=0.5).collect()} == want
    assert clusters.linkage_clusters(p.filter("false"), "label").count() == 0
