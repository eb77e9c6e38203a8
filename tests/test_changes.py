import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions.vectors import semantic_similarity
from sparkloom.operators import clusters, commits, diffs, embed, history
from sparkloom.operators.filters import compile_filter
from sparkloom.operators.search import top_k_many

DIFF = """diff --git a/src/main.py b/src/main.py
index 1..2 100644
--- a/src/main.py
+++ b/src/main.py
@@ -1,3 +1,4 @@
 import os
-old = 1
+new = 1
+# A comment
@@ -10,2 +11,3 @@
+def added():
+    pass
 x = 1
diff --git a/notes.md b/notes.md
--- a/notes.md
+++ b/notes.md
@@ -1 +1 @@
-a
+b
"""


@pytest.fixture(scope="module")
def diff(spark):
    return spark.createDataFrame([(1, DIFF)], "diff_id int, content string")


def test_files_and_hunks(diff):
    f = diffs.file_diffs(diff)
    assert [r.file_path for r in f.orderBy("nth").collect()] == ["src/main.py", "notes.md"]
    assert "".join(r.content for r in f.orderBy("nth").collect()) == DIFF
    h = diffs.hunks(f).orderBy("nth", "hunk_no").collect()
    assert [(r.file_path, r.hunk_no, r.target_start, r.added) for r in h] == [("src/main.py", 1, 1, ["new = 1", "# A comment"]), ("src/main.py", 2, 11, ["def added():", "    pass"]), ("notes.md", 1, 1, ["b"])]
    assert diffs.extract_file(diff, "notes.md").first().content.endswith("+b\n")


def test_preprocessing(diff):
    text = diff.select(diffs.preprocess(F.col("content")).alias("t")).first().t
    assert text.split("\n") == ["import os", "old = 1", "new = 1", "# A comment", "def added():", "    pass", "x = 1", "a", "b"]
    r = diff.select(diffs.embeddable(F.lit("  ")).alias("a"), diffs.embeddable(F.lit("plain")).alias("b")).first()
    assert r.a is None and r.b == "plain"


def test_one_hunk_is_not_packed(spark):
    rows = [(1, "x.txt", ["a" * 60]), (2, "x.txt", ["a" * 60, "b"]), (3, "x.py", ["a" * 60]), (4, "x.txt", ["a"])]
    text = lambda path, own: f"diff --git a/{path} b/{path}\n" + "\n".join(f"@@ -1 +1 @@\n+{h}" for h in own)
    d = spark.createDataFrame([(i, text(path, own)) for i, path, own in rows], "diff_id long, content string")
    got = {(r.diff_id, r.part): (r.kind, r.content) for r in diffs.semantic_split(d, limit=60).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, 1): "hunk", (2, 1): "large", (2, 2): "large", (3, 1): "section", (4, 1): "hunk"}
    assert got[1, 1][1] == text(*rows[0][1:]) and got[3, 1][1] == text(*rows[2][1:])


def test_semantic_split(diff):
    s = diffs.semantic_split(diff).orderBy("nth", "part").collect()
    assert [(r.file_path, r.part, r.kind) for r in s] == [("src/main.py", 1, "section"), ("src/main.py", 2, "section"), ("notes.md", 1, "hunk")]
    assert s[1].content.startswith("diff --git a/src/main.py") and "def added" in s[1].content and "new = 1" not in s[1].content
    assert [r.kind for r in diffs.semantic_split(diff, limit=60).filter("file_path = 'src/main.py'").collect()] == ["large", "large"]


def test_moved_files_are_left_out(spark, diff):
    moved = spark.createDataFrame([("notes.md", "docs/notes.md")], "source string, target string")
    assert {r.file_path for r in diffs.semantic_split(diff, moved).collect()} == {"src/main.py"}


def test_moves(spark):
    gone = spark.createDataFrame([("a/x.py", [1.0, 0.0]), ("a/y.py", [1.0, 0.0])], "path string, vector array<double>")
    new = spark.createDataFrame([("b/x.py", [0.9, 0.1]), ("c/x.py", [1.0, 0.0]), ("b/z.py", [1.0, 0.0])], "path string, vector array<double>")
    assert [(r.source, r.target) for r in diffs.moves(gone, new).collect()] == [("a/x.py", "c/x.py")]
    groups = diffs.move_groups(spark.createDataFrame([("a/x.py", "c/x.py"), ("m.py", "n.py")], "source string, target string")).orderBy("source_dir").collect()
    assert [r.description for r in groups] == ["chore: rename m.py to n.py", "chore: move x.py from a to c"]
    pairs = diffs.name_pairs(spark.createDataFrame([(1, "a/x"), (2, "b/x"), (3, "c/y")], "ord int, path string"), spark.createDataFrame([(1, "n/x")], "ord int, path string"))
    assert [tuple(r) for r in pairs.collect()] == [("a/x", "n/x")]


def test_batches(spark):
    few = spark.createDataFrame([(1, i, f"d{i % 2}/f{i}") for i in range(4)] + [(2, i, f"d{i % 2}/f{i}") for i in range(12)], "diff_id int, nth int, file_path string")
    sizes = diffs.batches(few).groupBy("diff_id", "batch").count().collect()
    assert {r["count"] for r in sizes if r.diff_id == 2} == {3} and [r["count"] for r in sizes if r.diff_id == 1] == [4]


def test_valid_names_and_precedence(spark):
    names = spark.createDataFrame([("a.py",), ("*.py",), ('"q',), ("",), (None,), ("b{c}",)], "file_path string")
    assert [r.file_path for r in diffs.existing(names, names.fillna("")).collect()] == ["a.py"]
    empty = spark.createDataFrame([(1, "", ["x.py", "*"], False, True)], "diff_id int, content string, files array<string>, is_staged boolean, is_untracked boolean")
    assert [(r.file_path, r.description) for r in diffs.file_chunks(empty).collect()] == [("x.py", "New file: x.py")]


SIMILAR = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([], [], 0.0), (None, [1.0], 0.0), ([1.0], [1.0, 2.0], 0.0)]


def test_similarity(spark):
    rows = spark.createDataFrame(SIMILAR, "a array<double>, b array<double>, want double").withColumn("got", semantic_similarity(F.col("a"), F.col("b"))).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


FILTERS = [({}, 4), ({"match": {"p.lang": "py"}}, 2), ({"match_any": {"p.n": [1, 3]}}, 2), ({"match_any": {"p.n": []}}, 0), ({"range": {"p.n": {"gte": 2}}}, 1), ({"must_not": [{"p.lang": "py"}]}, 2), ({"must": [{"p.lang": "py"}], "should": [{"p.n": 1}, {"p.n": 2}]}, 2), ({"p.lang": "py", "p.n": 1}, 1), ({"must": [{"should": [{"p.n": 3}, {"match": {"id": 4}}]}]}, 1), ({"must_not": [{"range": {"p.n": {"lt": 5}}}]}, 1)]


@pytest.mark.parametrize(("spec", "n"), FILTERS)
def test_filters(spark, spec, n):
    rows = spark.createDataFrame([(1, ("py", 1)), (2, ("py", 2)), (3, ("js", None)), (4, (None, 1))], "id int, p struct<lang:string,n:int>")
    want = {2: 2}.get(n, n) if spec != {"match_any": {"p.n": [1, 3]}} else 2
    assert rows.filter(compile_filter(spec)).count() == want


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, ("py", 1))], "id int, p struct<lang:string,n:int>").write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).filter(compile_filter({"match": {"p.lang": "py"}})).select("id")._jdf.queryExecution().toString()
    assert "p.lang" in plan[plan.index("PushedFilters") :]


def test_partitions_do_not_matter(spark):
    rng = np.random.default_rng(0)
    points = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(60)], "id long, vector array<double>")
    a, b = (sorted(map(tuple, top_k_many(points.repartition(n), points.filter("id < 5"), 3).collect())) for n in (1, 8))
    assert a == b and all(r[1] == r[0] for r in a if r[3] == 1)


LINT = [
    ("feat: add x", True), ("feat(api)!: add x", True), ("feat add x", False), ("feat:add x", False), ("foo: add x", False), ("feat(): add x", False), ("FEAT: add x", False), ("feat: Add x", False),
    ("feat: add x.", False), ("feat: " + "x" * 70, False), ("", False), (None, False), ("fix: handle ünïcode", True), ("feat: a\n\nbody\n\nREFS: #1\nREVIEWED-BY: z", True), ("feat: a\n\nbreaking change: x", True), ("feat: a\n\nBRÖ: x", False),
]


def test_lint(spark):
    rows = spark.createDataFrame(LINT, "m string, want boolean").withColumn("got", commits.linted(F.col("m"))).collect()
    assert [(r.m, r.got.is_valid) for r in rows][:15] == [(r.m, r.want) for r in rows][:15]
    said = {r.m: r.got.messages for r in rows}
    assert said[""] == ["Commit message cannot be empty."] and said["feat add x"] == ["Invalid header format: Missing ':' after type/scope."]
    assert said["feat: a\n\nbreaking change: x"] == ["[WARN] Footer token 'breaking change' MUST be uppercase ('BREAKING CHANGE' or 'BREAKING-CHANGE')."]


def test_footers(spark):
    m = "feat: a\n\nbody text\n\nmore\n\nBREAKING CHANGE: it\n continues\nREFS #12"
    r = spark.range(1).select(commits.body_and_footers(commits.parsed(F.lit(m))["rest"]).alias("b")).select("b.*", commits.footers(F.col("b.footers")).alias("f")).first()
    assert r.body == "body text\n\nmore" and [tuple(x) for x in r.f] == [("BREAKING CHANGE", ": ", "it\n continues"), ("REFS", " #", "12")]


TYPES = [(["tests/a.py"], "test"), (["src/a_test.py", "docs/x"], "test"), (["docs/x", "a.json"], "docs"), (["README.md"], "docs"), (["a.toml"], "chore"), ([], "chore"), (["src/a.py"], "chore")]


def test_types_and_descriptions(spark):
    rows = spark.createDataFrame(TYPES, "f array<string>, want string").withColumn("got", commits.commit_type(F.col("f"))).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    say = lambda files: spark.createDataFrame([(files,)], "f array<string>").select(commits.chunk_description(F.lit("feat"), F.col("f")).alias("d")).first().d
    assert say(["a.py"]) == "feat: update a.py" and say(["s/x/a", "s/x/b"]) == "feat: update files in s/x" and say(["a", "b"]) == "feat: update 2 related files"


def test_pull_request_texts(spark):
    c = spark.createDataFrame([(1, 1, "feat: add authentication"), (1, 2, "fix(x): y"), (2, 1, "raw text")], "b int, ord int, message string")
    rows = {r.b: r for r in commits.pr_summary(c, ["b"]).collect()}
    assert rows[1].title == "Feature: Add authentication" and "- [x] Feature\n- [x] Bug Fix" in rows[1].description and "### Fixes\n\n- y\n" in rows[1].description
    assert rows[2].title == "raw text" and "### Other\n\n- raw text\n" in rows[2].description
    r = spark.range(1).select(commits.pr_title(F.lit(None).cast("string")).alias("t"), commits.valid_branch(F.lit("a/b")).alias("v"), commits.filled_template("{a}-{b}", {"a": F.lit(1), "b": F.lit(None)}).alias("f")).first()
    assert tuple(r) == ("Update branch", False, "1-")
    b = commits.branches_by_type(spark.createDataFrame([("HEAD",), ("release/1",), ("origin/release/1",), ("x",)], "branch string"), "gitflow")
    assert {r.type: r.branches for r in b.collect()} == {"release": ["release/1"], "feature": ["x"]}


def test_history(spark):
    parents = spark.createDataFrame([("e", "d"), ("d", "b"), ("c", "b"), ("b", "a"), ("a", None)], "commit_id string, parent_id string")
    log = spark.createDataFrame([(c, i, f"{c} first\nrest") for i, c in enumerate("abcde")], "commit_id string, ord int, message string")
    assert [(r.commit_id, r.summary) for r in history.log_between(log, parents, "c", "e").collect()] == [("e", "e first"), ("d", "d first")]
    pairs = spark.createDataFrame([("x", "main", "e", "c"), ("y", "main", "b", "c")], "branch string, base string, branch_commit string, base_commit string")
    assert {r.branch: (r.is_ancestor, r.ahead) for r in history.branch_relation(parents, pairs).collect()} == {"x": (False, 2), "y": (True, 0)}
    assert {r.commit_id for r in history.log_until(log, "c").collect()} == {"d", "e"}
    flags = spark.createDataFrame([("a", 128), ("b", 1)], "file_path string, flags int")
    assert [r.file_path for r in history.untracked(flags).collect()] == ["a"]


def test_clusters(spark):
    d = np.array([[0, 0.1, 0.25, 0.9], [0.1, 0, 0.35, 0.9], [0.25, 0.35, 0, 0.9], [0.9, 0.9, 0.9, 0]])
    assert clusters.complete_linkage(d).tolist() == [0, 0, 2, 3]
    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.99, 0.1]), (3, "a", [0.0, 1.0]), (4, "b", [1.0, 0.0])], "id long, bl string, vector array<double>")
    assert {r.id: r.cluster for r in clusters.linkage_clusters(v, "bl").collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.id: r.leader for r in clusters.leader_clusters(v, "bl", 0.9).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    g = spark.createDataFrame([("c", 1, 5), ("c", 2, 6), ("d", 1, 5), ("d", 2, 6), ("d", 3, 6), ("d", 4, 6)], "change_id string, chunk_id int, group_id int")
    assert {(r.change_id, r.group_id) for r in clusters.shortcut(g).collect()} == {("c", 5), ("d", 5), ("d", 6)}


def test_integrity_repair(spark):
    members = spark.createDataFrame([(1, 10, "a"), (2, 11, "a"), (2, 12, "b"), (3, 13, "c"), (4, 14, "c"), (4, 15, "c"), (3, 16, "d")], "group_id long, chunk_id long, file_path string")
    near = spark.createDataFrame([(i, [1.0, 0.0] if i <= 12 else [float(i % 2), float(1 - i % 2)]) for i in range(10, 17)], "chunk_id long, vector array<double>")
    out = clusters.repaired(members, near)
    assert history.violations(out).count() == 0 and out.select("chunk_id").distinct().count() == 7
    by = {r.chunk_id: r.group_id for r in out.collect()}
    assert by[10] == by[11] == by[12] == 1 and by[13] == by[14] == by[15] == 4 and by[16] == 3


def test_embeddings(spark):
    c = spark.createDataFrame([("alpha beta alpha", ["f.py"]), ("", ["f.py"]), ("", [])], "content string, files array<string>")
    v = [r.vector for r in embed.chunk_vectors(c, lambda t: embed.hashed(t, 16), 16).collect()]
    assert np.isclose(np.linalg.norm(v[0]), 1) and np.linalg.norm(v[1]) > 0 and v[2] == [0.0] * 16
    rows = embed.token_buckets(c.withColumn("id", F.lit(1)).limit(1), "id", "content", 16).collect()
    assert all(np.isclose(v[0][r.bucket], r.value) for r in rows)
    model = embed.with_model(lambda texts: [[float(len(t))] for t in texts])
    assert [r.v for r in c.select(model(F.col("content")).alias("v")).collect()] == [[16.0], [0.0], [0.0]]
