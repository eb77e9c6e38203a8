"""Source files as tables of code entities.

`entities` turns files (file_path, content) into one row per entity in
preorder, by small helpers per file inside `mapInArrow`: the syntax tree of
the standard library for Python, declarations found by patterns with matched
braces for JavaScript and TypeScript, after strings, templates, comments and
regular expressions have been told apart from code. A file that can't be read has its MODULE
row only, with parse_ok false.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SCHEMA = (
    "file_path string, ord int, parent int, depth int, entity_type string, name string, start_line int, end_line int, docstring string, "
    "content string, language string, dependencies array<string>, calls array<string>, hierarchy_path string, parse_ok boolean"
)
#: Files that are looked at together, and rows and characters that are given on together.
FILES, ROWS, CHARS = 50, 1_000, 1 << 20
ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
#: Words in an assigned value that make it a type alias.
ALIAS_WORDS = ("TypeVar", "Dict", "List", "Tuple", "Set", "Union", "Optional", "Callable", "Any")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, file_name, ext, language, size_bytes, mtime, content, is_binary) of all files below a path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(
        F.col("path").alias("file_path"),
        T.base_name(F.col("path")).alias("file_name"),
        T.extension(F.col("path")).alias("ext"),
        T.language_of(F.col("path")).alias("language"),
        F.col("length").alias("size_bytes"),
        F.unix_micros("modificationTime").cast("double").alias("micros"),
        F.when(~T.is_binary(F.col("content")), T.decoded(F.col("content"))).alias("content"),
        T.is_binary(F.col("content")).alias("is_binary"),
    ).withColumn("mtime", F.col("micros") / 1e6).drop("micros")


def _row(kind: str, name: str, start: int, end: int, **more) -> dict:
    return {"entity_type": kind, "name": name, "start_line": start, "end_line": end, "children": [], "docstring": None, "dependencies": [], "calls": []} | more


def _dotted(node: ast.AST) -> str:
    try:
        return ast.unparse(node)
    except (ValueError, RecursionError):
        return ""


def _calls(node: ast.AST) -> list[str]:
    return list(dict.fromkeys(_dotted(n.func) for n in ast.walk(node) if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))))


def _assigned(node: ast.Assign | ast.AnnAssign) -> dict | None:
    target = node.targets[0] if isinstance(node, ast.Assign) else node.target
    name, value = _dotted(target), _dotted(node.value) if node.value else ""
    if any(w in value for w in ALIAS_WORDS):
        kind = "TYPE_ALIAS"
    elif name.isupper():
        kind = "CONSTANT"
    elif not name.startswith("_") and any(c.isalpha() for c in name):
        kind = "VARIABLE"
    else:
        return None
    return _row(kind, name, node.lineno, node.end_lineno)


def _python(nodes: list[ast.stmt], in_class: bool) -> list[dict]:
    out = []
    for n in nodes:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            marks = [_dotted(d) for d in n.decorator_list]
            plain = "METHOD" if in_class else "FUNCTION"
            if marks:
                kind = "PROPERTY" if "property" in marks else plain
            elif isinstance(n, ast.ClassDef):
                kind = "CLASS"
            else:
                kind = "TEST_CASE" if n.name.startswith("test_") else plain
            start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
            row = _row(kind, n.name, start, n.end_lineno, docstring=ast.get_docstring(n, clean=True))
            row["calls"] = _calls(n) if kind in ("FUNCTION", "METHOD") else []
            row["children"] = _python(n.body, isinstance(n, ast.ClassDef) or in_class)
            out.append(row)
        elif isinstance(n, ast.Import):
            out.append(_row("IMPORT", "", n.lineno, n.end_lineno, dependencies=[a.name for a in n.names]))
        elif isinstance(n, ast.ImportFrom):
            base = "." * n.level + (n.module or "")
            out.append(_row("IMPORT", "", n.lineno, n.end_lineno, dependencies=[f"{base}.{a.name}" if n.module else base + a.name for a in n.names]))
        elif isinstance(n, (ast.Assign, ast.AnnAssign)) and (row := _assigned(n)):
            out.append(row)
    return out


def parse_python(source: str) -> tuple[list[dict], str | None]:
    """Top entities of a module, comments among them, and its docstring; raises SyntaxError or ValueError."""
    tree = ast.parse(source)
    top = _python(tree.body, False)
    for t in tokenize.generate_tokens(io.StringIO(source).readline):
        if t.type == tokenize.COMMENT and t.start[1] == 0:
            top.append(_row("COMMENT", "", t.start[0], t.end[0]))
    return sorted(top, key=lambda r: r["start_line"]), ast.get_docstring(tree)


#: A comment, a string, or a regular expression (where one may stand) of JavaScript.
_QUIET = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*", re.S)
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%~^<>]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do))$")


def _blanked(source: str) -> str:
    """The source with comments, strings, regular expressions and the texts of templates as spaces; what stands in a template's ${} stays code."""
    out, i, n = list(source), 0, len(source)
    depths: list[int] = []  # braces that are open inside each open ${}
    while i < n:
        c, end = source[i], i + 1
        if c == "`" or (c == "}" and depths and depths[-1] == 0):
            if c == "}":
                depths.pop()
            while end < n and source[end] != "`" and source[end : end + 2] != "${":
                end += 2 if source[end] == "\\" else 1
            if source[end : end + 2] == "${":
                depths.append(0)
                end += 1
            end = min(n, end + 1)
        elif c in "/\"'" and (m := _QUIET.match(source, i)) and (c != "/" or m[0][1] in "/*" or _BEFORE_REGEX.search(source[max(0, i - 40) : i].rstrip())):
            end = m.end()
        else:
            if depths:
                depths[-1] += (c == "{") - (c == "}")
            i += 1
            continue
        out[i:end] = [x if x == "\n" else " " for x in source[i:end]]
        i = end
    return "".join(out)


_DECLARED = [
    ("CLASS", re.compile(r"\bclass\s+(\w+)[^{;]*\{")),
    ("INTERFACE", re.compile(r"\binterface\s+(\w+)[^{;]*\{")),
    ("ENUM", re.compile(r"\benum\s+(\w+)\s*\{")),
    ("FUNCTION", re.compile(r"\bfunction\s*\*?\s*(\w+)\s*\([^)]*\)[^{;]*\{")),
    ("FUNCTION", re.compile(r"\b(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b[^{]*|\([^)]*\)[^={;]*=>\s*|\w+\s*=>\s*)\{")),
    ("METHOD", re.compile(r"^[ \t]+(?:public |private |protected |static |async |get |set )*(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b)(\w+)\s*\([^)]*\)[^{;=\n]*\{", re.M)),
    ("TEST_SUITE", re.compile(r"\b(describe)\s*\([^{]*\{")),
    ("TEST_CASE", re.compile(r"\b(?:it|test)\s*\(()[^{]*\{")),
]
_ONE_LINE = [("TYPE_ALIAS", re.compile(r"^[ \t]*(?:export\s+)?type\s+(\w+)[^=\n]*=", re.M)), ("CONSTANT", re.compile(r"^(?:export\s+)?const\s+([A-Z][A-Z0-9_]*)\s*[:=]", re.M)), ("VARIABLE", re.compile(r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*[:=]", re.M))]
_IMPORTED = re.compile(r"""^\s*(?:import\b[^;\n]*?from\s*|import\s*|export\b[^;\n]*?from\s*)['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]\s*\)""", re.M)


def parse_braces(source: str) -> tuple[list[dict], str | None]:
    """Top entities of a JavaScript or TypeScript file: declarations nested by their braces."""
    quiet = _blanked(source)
    line = lambda at: source.count("\n", 0, at) + 1
    closing, stack = {}, []
    for m in re.finditer(r"[{}]", quiet):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            closing[stack.pop()] = m.start()
    found: dict[int, tuple[int, int, dict]] = {}
    for kind, pattern in _DECLARED:
        for m in pattern.finditer(quiet):
            brace = m.end() - 1
            if brace in closing and brace not in found:
                end = closing[brace]
                doc = re.search(r"/\*\*((?:(?!\*/).)*)\*/\s*(?:export\s+(?:default\s+)?)?(?:async\s+)?$", source[: m.start()], re.S)
                row = _row(kind, m[1], line(m.start() + len(m[0]) - len(m[0].lstrip())), line(end), docstring=re.sub(r"(?m)^\s*\*? ?", "", doc[1]).strip() if doc else None)
                if kind in ("FUNCTION", "METHOD"):
                    row["calls"] = [c for c in dict.fromkeys(re.findall(r"([\w.]+)\s*\(", quiet[brace:end])) if c not in ("if", "for", "while", "switch", "catch", "function", "return")]
                found[brace] = (m.start(), end, row)
    spans = sorted(found.values(), key=lambda x: (x[0], -x[1]))
    inside = lambda at: any(a < at < b for a, b, _ in spans)
    named = {r["name"] for _, _, r in spans}
    for kind, pattern in _ONE_LINE:
        for m in pattern.finditer(quiet):
            if not inside(m.start()) and m[1] not in named:
                named.add(m[1])
                spans.append((m.start(), m.start(), _row(kind, m[1], line(m.start()), line(m.end()))))
    for m in _IMPORTED.finditer(source):
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        spans.append((at, at, _row("IMPORT", "", line(at), line(m.end()), dependencies=[m[1] or m[2]])))
    top, open_ = [], []
    for a, b, row in sorted(spans, key=lambda x: (x[0], -x[1])):
        while open_ and open_[-1][0] < a:
            open_.pop()
        if row["entity_type"] == "METHOD" and not (open_ and open_[-1][1]["entity_type"] in ("CLASS", "INTERFACE")):
            continue
        (open_[-1][1]["children"] if open_ else top).append(row)
        open_.append((b, row))
    return top, None


def _flat(path: str, source: str | None, language: str | None) -> list[tuple]:
    if source is None:
        return []
    lines = re.split(r"\r\n|\n|\r", re.sub(r"(\r\n|\n|\r)\Z", "", source)) if source else []
    ok, doc, top = True, None, []
    try:
        if language == "python":
            top, doc = parse_python(source)
        elif language in ("javascript", "typescript"):
            top, doc = parse_braces(source)
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError):
        ok = False
    stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    root = _row("MODULE", stem, 1, max(1, len(lines)), docstring=doc, children=top)
    out: list[tuple] = []

    def walk(row: dict, parent: int | None, depth: int, above: str) -> None:
        here = row["name"] or f"<{row['entity_type'].lower()}>"
        place = f"{above}.{here}" if above else here
        mine = len(out)
        content = "\n".join(lines[row["start_line"] - 1 : row["end_line"]])
        out.append((path, mine, parent, depth, row["entity_type"], row["name"], row["start_line"], min(row["end_line"], max(1, len(lines))), row["docstring"], content, language, row["dependencies"], row["calls"], place, ok))
        for child in row["children"]:
            walk(child, mine, depth + 1, place)

    walk(root, None, 0, "")
    return out


def entities(source: DataFrame) -> DataFrame:
    """Entities of files (file_path, content), in preorder (ord) with their parent's ord. Files are taken in slices, and their rows given on once there are ROWS or their texts have CHARS, so that a worker's memory is that of a few files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for first in range(0, b.num_rows, FILES):
                for path, text, language in zip(*[c.to_pylist() for c in b.slice(first, FILES).columns], strict=True):
                    for r in _flat(path, text, language):
                        rows.append(r)
                        size += len(r[9])
                        if len(rows) >= ROWS or size >= CHARS:
                            yield _batch(rows)
                            rows, size = [], 0
        if rows:
            yield _batch(rows)
        rows = None
        pa.default_memory_pool().release_unused()  # a worker lives on after its task

    return source.select("file_path", "content", T.language_of(F.col("file_path")).alias("language")).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*[c.split(" ") for c in SCHEMA.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(v, ARROW[k]) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def incremental(source: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Entities of files (file_path, content) with file_hash and `parsed`: files that `known` (an earlier result) has with the same path and content keep their entities, and only the others reach the parser. Entities of files that are gone or changed go."""
    files = source.select("file_path", "content", F.coalesce(T.content_hash(F.col("content")), F.lit("")).alias("file_hash"))
    if known is None:
        kept, fresh = None, files
    else:
        there = known.select("file_path", "file_hash").distinct()
        kept = known.join(files.select("file_path", "file_hash"), ["file_path", "file_hash"], "left_semi").withColumn("parsed", F.lit(False))
        fresh = files.join(there, ["file_path", "file_hash"], "left_anti")
    new = entities(fresh).join(fresh.select("file_path", "file_hash"), "file_path").withColumn("parsed", F.lit(True))
    return new if kept is None else new.unionByName(kept.select(new.columns))
