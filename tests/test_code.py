import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import chunks, clusters, docs, graph, ignore, tree
from sparkloom.sources import code

PYTHON = '''"""Module doc."""

import os
import sys
from a.b import c as d

LIMIT = 42
Alias = Optional[int]
plain = 1
_hidden = 2


class Sample:
    """Class doc."""

    def __init__(self, x: int):
        self.x = helper(x)

    @property
    def value(self):
        return self.x


def sample(a: int, b: int) -> int:
    """Adds."""
    return a + b


def test_sample():
    assert sample(1, 2) == 3


# trailing comment
'''
TYPESCRIPT = '''import { a } from "./a";
import b from 'b';

/** Shape of things. */
export interface Shape {
  area(): number;
}

export type Name = string;
const MAX_SIZE = 10;

export class Box extends Base {
  constructor(private w: number) {
    super();
  }

  area(): number {
    return compute(this.w, "{");
  }
}

export const make = (w: number) => {
  return new Box(w);
};

enum Color { Red }

describe("boxes", () => {
  it("works", () => { make(1); });
});
'''


@pytest.fixture(scope="module")
def entities(spark):
    files = spark.createDataFrame([("src/s.py", PYTHON), ("web/b.ts", TYPESCRIPT), ("bad.py", "def broken(:\n"), ("x.txt", "text"), ("none.py", None)], "file_path string, content string")
    return code.entities(files).cache()


def of(entities, path):
    return [(r.entity_type, r.name, r.parent) for r in entities.filter(F.col("file_path") == path).orderBy("ord").collect()]


def test_python_entities(entities):
    assert of(entities, "src/s.py") == [
        ("MODULE", "s", None), ("IMPORT", "", 0), ("IMPORT", "", 0), ("IMPORT", "", 0), ("CONSTANT", "LIMIT", 0), ("TYPE_ALIAS", "Alias", 0), ("VARIABLE", "plain", 0),
        ("CLASS", "Sample", 0), ("METHOD", "__init__", 7), ("VARIABLE", "self.x", 8), ("PROPERTY", "value", 7), ("FUNCTION", "sample", 0), ("TEST_CASE", "test_sample", 0), ("COMMENT", "", 0),
    ]
    by = {r.name: r for r in entities.filter("file_path = 'src/s.py' AND name <> ''").collect()}
    assert by["s"].docstring == "Module doc." and by["Sample"].docstring == "Class doc." and by["__init__"].calls == ["helper"]
    assert by["value"].hierarchy_path == "s.Sample.value" and by["sample"].start_line == 24
    assert [r.dependencies for r in entities.filter("file_path = 'src/s.py' AND entity_type = 'IMPORT'").orderBy("ord").collect()] == [["os"], ["sys"], ["a.b.c"]]


def test_typescript_entities(entities):
    found = of(entities, "web/b.ts")
    assert [(k, n) for k, n, _ in found] == [
        ("MODULE", "b"), ("IMPORT", ""), ("IMPORT", ""), ("INTERFACE", "Shape"), ("TYPE_ALIAS", "Name"), ("CONSTANT", "MAX_SIZE"), ("CLASS", "Box"), ("METHOD", "constructor"), ("METHOD", "area"),
        ("FUNCTION", "make"), ("ENUM", "Color"), ("TEST_SUITE", "describe"), ("TEST_CASE", ""),
    ]
    shape = entities.filter("name = 'Shape'").first()
    assert shape.docstring == "Shape of things." and entities.filter("name = 'area'").first().calls == ["compute"]


def test_unreadable_files(entities):
    assert of(entities, "bad.py") == [("MODULE", "bad", None)] and not entities.filter("file_path = 'bad.py'").first().parse_ok
    assert of(entities, "x.txt") == [("MODULE", "x", None)] and of(entities, "none.py") == []


def test_levels_of_detail(entities):
    def row(level):
        return chunks.detail(entities, level).filter("name = 'sample'").first()

    assert row(chunks.SIGNATURES).signature == "def sample(a: int, b: int) -> int" and row(chunks.SIGNATURES).docstring is None
    assert row(chunks.DOCS).docstring == "Adds." and row(chunks.DOCS).content is None and "return a + b" in row(chunks.FULL).content
    assert chunks.detail(entities, chunks.SIGNATURES).filter("entity_type = 'COMMENT'").first().content == "# trailing comment"


def test_chunks(spark, entities):
    files = spark.createDataFrame([("src/s.py", PYTHON)], "file_path string, content string")
    own = chunks.chunked(files, entities.filter("file_path = 'src/s.py'")).orderBy("place").collect()
    assert [r.metadata.entity_type for r in own] == ["FILE", "MODULE", "CLASS", "METHOD", "FUNCTION"]
    assert "Contains:" in own[1].content and "  - CLASS: Sample class Sample (lines 13-21)" in own[1].content and "    - METHOD: __init__" in own[1].content
    assert own[4].content.startswith("File: s\nType: FUNCTION\n\nPath: s.sample") and own[1].metadata.file_metadata.language == "python"
    assert len({r.metadata.chunk_id for r in own}) == len(own)
    assert chunks.chunked(files, entities.filter("file_path = 'src/s.py'"), max_lines=3).filter("place < 0").count() == 0


def test_unknown_subtrees_give_no_chunks(spark):
    rows = [("f", 0, None, 0, "MODULE", "f", 1, 3, "f"), ("f", 1, 0, 1, "UNKNOWN", "u", 1, 2, "f.u"), ("f", 2, 1, 2, "FUNCTION", "g", 1, 2, "f.u.g"), ("f", 3, 0, 1, "FUNCTION", "h", 3, 3, "f.h")]
    e = spark.createDataFrame([Row(file_path=a, ord=b, parent=c, depth=d, entity_type=k, name=n, start_line=s, end_line=t, docstring=None, content="x", language=None, dependencies=[], calls=[], hierarchy_path=h, parse_ok=True) for a, b, c, d, k, n, s, t, h in rows], code.SCHEMA)
    out = chunks.chunked(spark.createDataFrame([("f", "x\ny\nz")], "file_path string, content string"), e)
    assert sorted(r.metadata.entity_name for r in out.filter("place >= 0").collect()) == ["f", "h"]


def test_graph(spark, entities):
    nodes, edges = graph.entity_graph(entities.filter("file_path IN ('src/s.py', 'web/b.ts')"))
    got = {(r.src.split("_")[-1], r.dst.split("_")[-1], r.type) for r in edges.collect()}
    assert ("Sample", "", "declare") in got or any(t == "declare" for *_, t in got)
    assert {r.kind for r in nodes.filter("id LIKE 'dep_%'").collect()} == {"EXTERNAL", "INTERNAL"}
    lines = graph.edge_lines(edges).orderBy("place").collect()
    assert [r.line for r in lines] == sorted(r.line for r in lines) and all(r.style.startswith(f"  linkStyle {r.place} ") for r in lines)
    text = graph.diagram(nodes, edges).first().text
    assert text.startswith("graph LR") and "subgraph" in text and "-.->|imports|" in text
    only = graph.entity_graph(entities.filter("file_path = 'src/s.py'"), relations=["calls"], only_connected=True)[0]
    assert {r.kind for r in only.collect()} <= {"MODULE", "CLASS", "EXTERNAL", "INTERNAL", "FUNCTION", "METHOD"}


def test_call_edges_prefer_full_names(spark):
    names = spark.createDataFrame([(1, "f"), (2, "a.f"), (3, "g"), (4, "g")], "id int, name string")
    calls = spark.createDataFrame([(9, "a.f"), (9, "b.f"), (3, "x.g"), (9, "nope")], "src int, called string")
    assert {tuple(r) for r in graph.call_edges(calls, names).collect()} == {(9, 2), (9, 1), (3, 4)}


def test_trees(spark):
    files = spark.createDataFrame([("file1.txt", "h1"), ("subdir/file2.py", "h2")], "file_path string, hash string")
    dirs = spark.createDataFrame([("emptydir",)], "file_path string")
    assert tree.tree_text(files, "project", dirs).first().text == "project\n├── emptydir/\n├── subdir/\n│   └── file2.py\n└── file1.txt"
    assert tree.tree_text(files.filter("false"), "empty").first().text == "empty/"
    root = lambda rows: {r.path: r.hash for r in tree.tree_hashes(spark.createDataFrame(rows, "file_path string, hash string")).collect()}[""]
    base = [("a/b.py", "1"), ("a/c/d.py", "2"), ("e", "3")]
    assert root(base) == root(base[::-1])
    for other in ([("a/x.py", "1"), *base[1:]], base[:2], [*base, ("n", "4")], [("a/b.py", "9"), *base[1:]]):
        assert root(other) != root(base)
    kinds = {r.path: r.type for r in tree.tree_hashes(spark.createDataFrame(base, "file_path string, hash string"), patterns=["^a/c"]).collect()}
    assert kinds["a/c"] == "excluded" and "a/c/d.py" not in kinds


@pytest.mark.parametrize(("lines", "kept"), [([], "a.py d/b.log d/keep.log build/x"), (["*.log"], "a.py build/x"), (["*.log", "!keep.log"], "a.py d/keep.log build/x"), (["build/"], "a.py d/b.log d/keep.log"), (["/d"], "a.py build/x"), (["d/*.log", "# no", ""], "a.py build/x")])
def test_ignore_rules(spark, lines, kept):
    paths = spark.createDataFrame([(p, False) for p in ("a.py", "d/b.log", "d/keep.log", "build/x")], "path string, is_dir boolean")
    assert [r.path for r in ignore.kept_paths(paths, lines, defaults=False).collect()] == kept.split()


def test_ignored_directories(spark):
    paths = spark.createDataFrame([("node_modules", True, False), ("node_modules/x", True, False), ("src", True, False), ("../up/dist", True, True), ("m.pyc", False, False)], "path string, is_dir boolean, outside boolean")
    assert [r.path for r in ignore.kept_paths(paths, []).collect()] == ["src", "../up/dist"]


CASES = [("a.py", "python"), ("a.pyi", "python"), ("x/a.jsx", "javascript"), ("a.mjs", "javascript"), ("a.cjs", "javascript"), ("a.tsx", "typescript"), ("a.PY", None), ("Makefile", None), (".py", None)]


def test_paths_and_text(spark):
    rows = spark.createDataFrame(CASES, "path string, language string").withColumn("got", T.language_of(F.col("path"))).collect()
    assert [r.got for r in rows] == [r.language for r in rows]
    one = spark.createDataFrame([("This is a test", "a\r\nb\rc\n\n", "feature/x y", "git@github.com:own/repo.git", 'a[b]{"c"}')], "t string, l string, b string, u string, m string")
    r = one.select(T.token_estimate(F.col("t")).alias("e"), T.lines(F.col("l")).alias("l"), T.safe_branch(F.col("b")).alias("b"), T.safe_branch(F.lit("..")).alias("bad"), T.repository_slug(F.col("u")).alias("u"), T.diagram_label(F.col("m")).alias("m"), T.clean_message(F.lit(" a\n\n\n\nb ")).alias("c"), T.relative_path(F.lit("/r//a/./b"), "/r").alias("p")).first()
    assert tuple(r) == (3, ["a", "b", "c", ""], "feature_xy", "invalid_branch_name_after_sanitize", "own/repo", "a(b)(#quot;c#quot;)", "a\n\nb", "a/b")


RELATED = [("test_a.py", "a.py", True), ("a_test.py", "a.py", True), ("a.py", "b.py", False), ("src/x/a.py", "src/y/b.py", True), ("package.json", "yarn.lock", True), ("ab.py", "ab.js", False), ("util.py", "utils.js", True), ("README.md", "z", True), ("Dockerfile", ".dockerignore", True), ("q/w.c", "e/r.h", False)]


def test_relatedness(spark):
    rows = spark.createDataFrame(RELATED, "a string, b string, want boolean").withColumn("got", clusters.related(F.col("a"), F.col("b"))).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_documentation(spark, entities, tmp_path):
    s = docs.file_sections(entities.filter("file_path = 'src/s.py'"))
    text = s.first().section
    assert text.startswith("### src/s.py") and "**Function**: `sample`" in text and "Adds." in text
    assert docs.table_of_contents(s).first().line == "- [src/s.py](#src-spy)"
    docs.write_documentation(s, str(tmp_path / "out"))
    assert "Sample" in "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))


def test_files_source(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_text("x = 1\n")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe bad")
    rows = {r.file_name: r for r in code.files(spark, str(tmp_path)).collect()}
    assert rows["a.py"].language == "python" and rows["a.py"].content == "x = 1\n" and not rows["a.py"].is_binary
    assert rows["b.bin"].is_binary and rows["c.txt"].is_binary and rows["c.txt"].content is None


def test_resolved_paths_and_contexts(spark):
    names = spark.createDataFrame([("src/a.py",), ("old/pkg/b.py",), ("zzz.py",)], "path string")
    known = spark.createDataFrame([("src/a.py",), ("new/pkg/b.py",), ("b.py",)], "path string")
    got = {r.path: r.resolved for r in chunks.resolved_paths(names, known).collect()}
    assert got == {"src/a.py": "src/a.py", "old/pkg/b.py": "new/pkg/b.py", "zzz.py": None}
    r = spark.range(1).select(chunks.fitted_context(F.lit("x" * 40), F.lit("s"), 10).alias("a"), chunks.fitted_context(F.lit("x" * 80), F.lit("s"), 10).alias("b")).first()
    assert tuple(r) == ("x" * 40, "s")


def test_templates_and_regular_expressions_are_no_code():
    source = "\n".join([
        "function a(x) { return `one ${x.map(y => `two } ${b(y)} {`).join('}')} three {`; }",
        "const R = /[/}'\"`]+\\/{/g;",
        "function c() { if (x) { return /}}/.test(d(1)) } }",
        "const half = (4) / 2; // } {",
        "function e() { return 8 / f(2) / g(1); }",
        "function last() { return \"`\" + '{'; }",
    ])
    top, _ = code.parse_braces(source)
    got = [(r["entity_type"], r["name"], r["start_line"], r["end_line"]) for r in top]
    assert [x for x in got if x[0] == "FUNCTION"] == [("FUNCTION", "a", 1, 1), ("FUNCTION", "c", 3, 3), ("FUNCTION", "e", 5, 5), ("FUNCTION", "last", 6, 6)]
    assert ("CONSTANT", "R", 2, 2) in got and ("VARIABLE", "half", 4, 4) in got
    calls = {r["name"]: r["calls"] for r in top if r["entity_type"] == "FUNCTION"}
    assert "b" in calls["a"] and "d" in calls["c"] and calls["e"] == ["f", "g"]


def test_files_are_taken_in_slices(spark, monkeypatch):
    """A worker gives rows on as soon as there are some; what it makes doesn't depend on the slices."""
    import pyarrow as pa

    text = 'import os\n\n\nclass A:\n    """Doc."""\n\n    def m(self):\n        return f()\n'
    files = [(f"d/x{i}.py", text if i % 3 else None if i % 2 else "def (") for i in range(130)]
    want = [r for p, s in files for r in code._flat(p, s, "python")]
    monkeypatch.setattr(code, "ROWS", 7)
    kept = []

    class Source:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_arrays([pa.array([f[0] for f in files]), pa.array([f[1] for f in files]), pa.array(["python"] * len(files))], names=["p", "c", "l"])
            kept.extend(run(iter([batch.slice(0, 101), batch.slice(101)])))

    spark.range(0)
    code.entities(Source())
    assert len(kept) == -(-len(want) // 7) and all(b.num_rows <= 7 for b in kept)
    assert [tuple(r.values()) for b in kept for r in b.to_pylist()] == want


def test_edges_are_counted_over_files_that_are_parsed_once(spark):
    plan = graph.edge_counts(code.entities(spark.createDataFrame([("a.py", "def f():\n    g()\n\n\ndef g():\n    pass\n")], "file_path string, content string")))
    assert "MapInArrow" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in plan.collect()} == {("declare", 2, 1), ("call", 1, 1)}
