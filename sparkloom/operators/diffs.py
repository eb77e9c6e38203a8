"""Unified diffs as tables: files, lines, hunks, sections, packed parts, moves, budgets.

diffs: (diff_id, content). Every result carries its order explicitly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import EPSILON
from .components import Staged, running, staged

#: Largest packed part in characters, similarity of a moved file, files that are handled at once, files of a batch beyond that.
PART_LIMIT, MOVED, FILES_AT_ONCE, BATCH = 50_000, 0.85, 10, 3
#: Rows of a key that are folded in one row, and of a block of files of one name.
FOLD, MEET = 2_000, 1_000

#: Lines that begin a unit of code, by extension.
_CODE = {
    "py": [r"^import\s+.*", r"^from\s+.*", r"^class\s+\w+", r"^def\s+\w+", r"^if\s+__name__\s*==\s*['\"]__main__['\"]"],
    "js": [r"^import\s+.*", r"^const\s+\w+\s*=\s*require", r"^function\s+\w+", r"^const\s+\w+\s*=\s*function", r"^class\s+\w+", r"^export\s+"],
    "ts": [r"^import\s+.*", r"^export\s+", r"^interface\s+", r"^type\s+", r"^class\s+", r"^function\s+"],
    "java": [r"^import\s+.*", r"^public\s+class", r"^private\s+class", r"^(public|private|protected)(\s+static)?\s+\w+\s+\w+\("],
    "go": [r"^import\s+", r"^func\s+", r"^type\s+\w+\s+struct"],
    "rb": [r"^require\s+", r"^class\s+", r"^def\s+", r"^module\s+"],
    "php": [r"^namespace\s+", r"^use\s+", r"^class\s+", r"^(public|private|protected)\s+function"],
    "cs": [r"^using\s+", r"^namespace\s+", r"^(public|private|protected|internal)\s+class", r"^(public|private|protected|internal)(\s+static)?\s+\w+\s+\w+\("],
    "kt": [r"^import\s+.*", r"^class\s+\w+", r"^fun\s+\w+", r"^val\s+\w+", r"^var\s+\w+"],
    "scala": [r"^import\s+.*", r"^class\s+\w+", r"^object\s+\w+", r"^def\s+\w+", r"^val\s+\w+", r"^var\s+\w+"],
}
#: Those of further extensions are the same.
BOUNDARIES = _CODE | {"jsx": _CODE["js"], "tsx": _CODE["ts"]}


def valid_filename(name: Column) -> Column:
    return (F.coalesce(name, F.lit("")) != "") & ~name.rlike(r"[*+{}\\]") & ~F.startswith(name, F.lit('"'))


def file_diffs(diffs: DataFrame) -> DataFrame:
    """(diff_id, nth, file_path, content): one row for each `diff --git` header; file_path is the new side's."""
    parts = F.split("content", r"(?m)(?=^diff --git a/\S+ b/\S+)")
    rows = diffs.select("diff_id", F.posexplode(parts).alias("nth", "content")).filter(F.startswith("content", F.lit("diff --git a/")))
    return rows.select("diff_id", "nth", F.regexp_extract("content", r"^diff --git a/\S+ b/(\S+)", 1).alias("file_path"), "content")


def file_chunks(diffs: DataFrame) -> DataFrame:
    """file_diffs with valid names and content, described; diffs without content give one empty chunk per named file if they are unstaged or untracked."""
    full = file_diffs(diffs.filter(F.coalesce("content", F.lit("")) != "")).filter(valid_filename(F.col("file_path")))
    full = full.select("diff_id", "nth", "file_path", "content", F.concat(F.lit("Changes in "), "file_path").alias("description"))
    if not {"files", "is_staged", "is_untracked"} <= set(diffs.columns):
        return full
    empty = diffs.filter((F.coalesce("content", F.lit("")) == "") & (~F.col("is_staged") | F.col("is_untracked"))).select("diff_id", F.posexplode("files").alias("nth", "file_path")).filter(valid_filename(F.col("file_path")))
    return full.unionByName(empty.select("diff_id", "nth", "file_path", F.lit("").alias("content"), F.concat(F.lit("New file: "), "file_path").alias("description")))


def extract_file(diffs: DataFrame, path: str) -> DataFrame:
    """(diff_id, content) of a file's first diff."""
    return file_diffs(diffs).filter(F.col("file_path") == path).groupBy("diff_id").agg(F.min_by("content", "nth").alias("content"))


def diff_lines(files: DataFrame) -> DataFrame:
    """(diff_id, nth, file_path, n, hunk_no, tag, line): every line; hunk_no is 0 before the first @@, tag is +, -, space, @ or h (header)."""
    rows = files.select("diff_id", "nth", "file_path", F.posexplode(T.lines(F.col("content"))).alias("n", "raw"))
    hunk = F.sum(F.startswith("raw", F.lit("@@")).cast("int")).over(Window.partitionBy("diff_id", "nth").orderBy("n"))
    rows = rows.withColumn("hunk_no", hunk)
    tag = F.when(F.col("hunk_no") == 0, "h").when(F.startswith("raw", F.lit("@@")), "@").when(F.substring("raw", 1, 1).isin("+", "-", " "), F.substring("raw", 1, 1)).otherwise("h")
    body = F.when(tag.isin("+", "-", " "), F.expr("substring(raw, 2)")).otherwise(F.col("raw"))
    return rows.select("diff_id", "nth", "file_path", "n", "hunk_no", tag.alias("tag"), body.alias("line"))


def hunks(files: DataFrame) -> DataFrame:
    """(diff_id, nth, file_path, hunk_no, header, target_start, body, added): added holds the added lines in order. A hunk stands in one piece in its text, so it is cut out of it and no line is shuffled."""
    pieces = F.split(F.concat(F.lit("\n"), "content"), "\n@@")
    cut = files.select("diff_id", "nth", "file_path", F.size(pieces).alias("n"), F.posexplode(pieces).alias("hunk_no", "piece")).filter("hunk_no > 0")
    hunk = F.concat(F.lit("@@"), F.when(F.col("hunk_no") + 1 == F.col("n"), F.regexp_replace("piece", r"(\r\n|\n|\r)\z", "")).otherwise(F.regexp_replace("piece", r"\r\z", "")))
    rows = cut.select("diff_id", "nth", "file_path", "hunk_no", hunk.alias("hunk"))
    start = F.regexp_extract("hunk", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    added = F.regexp_extract_all("hunk", F.lit(r"[\r\n]\+([^\r\n]*)"), F.lit(1))
    return rows.select("diff_id", "nth", "file_path", "hunk_no", F.regexp_extract("hunk", r"^[^\r\n]*", 0).alias("header"), F.regexp_replace("hunk", r"\r\n|\r", "\n").alias("body"), added.alias("added"), F.when(start != "", start.cast("int")).alias("target_start"))


def preprocess(content: Column) -> Column:
    """Changed and context lines without their prefix; headers and everything else go."""
    header = F.lit(r"^(diff --git|index |\+\+\+|---)")
    kept = F.filter(T.lines(content), lambda x: ~F.regexp_like(x, header) & F.regexp_like(x, F.lit(r"^[+\- ]")))
    return F.array_join(F.transform(kept, lambda x: F.substring(x, F.lit(2), F.lit(2**31 - 1))), "\n")


def embeddable(content: Column) -> Column:
    """What of a text is embedded: null if blank, preprocessed if it looks like a diff, else itself."""
    return F.when(F.trim(content) == "", F.lit(None)).when(content.rlike(r"(?m)^(diff --git|@@ )"), preprocess(content)).otherwise(content)


def _matching(pattern: Column):
    return lambda x: F.regexp_like(x, pattern)


def has_boundary(lines: Column, extension: Column) -> Column:
    """Whether any line begins a unit of code in the language of this extension."""
    hit = F.lit(False)
    for name, patterns in BOUNDARIES.items():
        any_of = F.lit("|".join(f"(?:{p})" for p in patterns))
        hit = F.when(extension == name, F.exists(lines, _matching(any_of))).otherwise(hit)
    return hit


def islands(rows: DataFrame, keys: list[str], order: str, boundary: Column, name: str = "section") -> DataFrame:
    """rows and the number (from 1) of the run they are in: a run begins at a boundary that is not the first row."""
    by = Window.partitionBy(*keys).orderBy(order)
    start = (boundary & (F.row_number().over(by) > 1)).cast("int")
    return rows.withColumn(name, F.sum(start).over(by) + 1)


def sections(files: DataFrame) -> DataFrame:
    """Hunks with their section: a hunk with an added line that begins a unit of code starts one."""
    h = hunks(files)
    ext = F.regexp_replace(T.extension(F.col("file_path")), r"^\.", "")
    return islands(h, ["diff_id", "nth"], "hunk_no", has_boundary(F.col("added"), ext))


def packed(rows: DataFrame, keys: list[str], order: str, size: Column, limit: int, start: Column | None = None) -> DataFrame:
    """rows with `part` (from 1): greedy packing in order; a part closes when the next row would exceed the limit, a row that alone exceeds it has a part of its own.

    start is the size that every part begins with (a file's header). Sizes are not negative, the order of a
    key's rows has no ties, keys aren't null. A key of up to FOLD rows is folded in one row; in longer ones each row
    knows from running sums where the next part would begin if one began with
    it, and jumps of double length mark those that do, in as many rounds as the
    logarithm of the most parts of a key. All keys are one order there, so no key is one group.
    """
    slim = staged(rows.select(*keys, F.col(order).alias("o"), size.cast("long").alias("s"), (F.lit(0) if start is None else start).cast("long").alias("st")), "sizes")
    many = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("st").alias("b"))
    short = slim.join(many.filter(F.col("n") <= FOLD), keys)
    found = _folded(short, keys, limit)
    long = many.filter(F.col("n") > FOLD)
    if long.limit(1).count():
        found = found.unionByName(_jumped(slim.join(long, keys), keys, limit))
    return rows.join(found.withColumnRenamed("o", order), [*keys, order])


def _folded(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(keys, o, part) of rows (keys, o, s, b) by a fold over each key's sizes."""
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("o", "s"))).alias("a"), F.max("b").alias("b"))
    zero = F.struct(F.lit(0).cast("int").alias("part"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        over = (acc["part"] == 0) | (acc["used"] + x["s"] > limit)  # what follows a row over the limit is over it too
        new = F.when(over, acc["part"] + 1).otherwise(acc["part"])
        alone = F.col("b") + x["s"] > limit
        used = F.when(over & alone, F.lit(limit + 1)).when(over, F.col("b") + x["s"]).otherwise(acc["used"] + x["s"])
        return F.struct(new.alias("part"), used.alias("used"), F.concat(acc["parts"], F.array(new)).alias("parts"))

    parts = grouped.select(*keys, "a", F.aggregate("a", zero, step)["parts"].alias("p"))
    return parts.select(*keys, F.explode(F.arrays_zip("a", "p")).alias("z")).select(*keys, F.col("z.a.o").alias("o"), F.col("z.p").alias("part"))


def _jumped(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(keys, o, part) of rows (keys, o, s, b) by jumps from part to part."""
    stage = Staged(rows.sparkSession)
    r = stage(running(rows.select(*keys, "o", "s", "b", F.lit(1).alias("one")), {"sum": "s", "place": "one"}, *keys, "o"), "running")
    ends = stage(r.groupBy(*keys).agg(F.min("place").alias("first"), F.max("place").alias("last")), "ends")
    # the next part begins after all rows whose running sum still fits: their number is its place less one
    fits = r.filter(F.col("b") + F.col("s") <= limit).select(*keys, (F.col("sum") - F.col("s") + limit - F.col("b")).alias("sum"), "place", F.lit(0).alias("one"))
    merged = running(r.select(*keys, "sum", "place", "one").unionByName(fits).withColumn("asks", 1 - F.col("one")), {"before": "one"}, *keys, "sum", "asks", "place")
    jump = merged.filter("asks = 1").select(*keys, "place", (F.col("before") + 1).alias("next"))
    jump = jump.unionByName(r.filter(F.col("b") + F.col("s") > limit).select(*keys, "place", (F.col("place") + 1).alias("next")))
    jump = stage(jump.join(ends, keys).filter("next <= last").select("place", "next"), "jumps")
    marks, turn = stage(ends.select(F.col("first").alias("place")), "marks"), None
    while True:
        now = Staged(rows.sparkSession)
        new = marks.join(jump, "place").select(F.col("next").alias("place")).join(marks, "place", "left_anti")
        more = now(new, "more")
        if not more.limit(1).count():
            break
        marks = now(marks.unionByName(more), "marks")
        jump = now(jump.join(jump.select(F.col("place").alias("next"), F.col("next").alias("then")), "next").select("place", F.col("then").alias("next")), "jumps")
        if turn:
            turn.drop()
        turn = now
    begun = r.select(*keys, "o", "place").join(marks.withColumn("begins", F.lit(1)), "place", "left").withColumn("begins", F.coalesce("begins", F.lit(0)))
    begun = running(begun, {"part": "begins"}, "place")
    own = begun.join(begun.join(ends, (begun["place"] == ends["first"])).select(*[begun[k] for k in keys], (F.col("part") - 1).alias("ahead")), keys)
    out = staged(own.select(*keys, "o", (F.col("part") - F.col("ahead")).cast("int").alias("part")), "parts")
    stage.drop()
    if turn:
        turn.drop()
    return out


def cut_to_budget(rows: DataFrame, keys: list[str], order: str, lines: Column, each: int = 300, total: int = 1000) -> DataFrame:
    """rows that fit, with `taken` lines and `cut`: a row gives at most `each` lines (and a marker line when cut), all rows of a key `total`; the row that crosses is cut, later ones go."""
    own = F.when(lines > each, F.lit(each + 1)).otherwise(lines)
    ahead = F.coalesce(F.sum(own).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("room", F.lit(total) - ahead).filter("room > 0")
    return out.withColumn("taken", F.least(own, F.col("room"))).withColumn("cut", (lines > each) | (own > F.col("room"))).drop("room")


def keep_leading(rows: DataFrame, keys: list[str], order: str, size: Column, limit: int, reserve: int = 100) -> DataFrame:
    """Leading rows while their total size is at most limit - reserve; `dropped` tells whether later ones went. All rows stay if they fit the limit."""
    by = Window.partitionBy(*keys)
    run = F.sum(size).over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.sum(size).over(by)
    out = rows.withColumn("run", run).withColumn("dropped", whole > limit)
    return out.filter(~F.col("dropped") | (F.col("run") <= limit - reserve)).drop("run")


def truncated(text: Column, limit: int, marker: str = "\n... [truncated]") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def moves(deleted: DataFrame, added: DataFrame, least: float = MOVED) -> DataFrame:
    """(source, target, similarity): each deleted file (path, vector) with its best added one of the same base name, if similar enough. An added file may serve again; ties go to the first path.

    The files of a name are dealt to blocks of some MEET rows of either side. Each two blocks
    meet in one matrix product that keeps each source's best; a task gets many names together.
    """
    name = T.base_name(F.col("path")).alias("name")
    vector = F.col("vector").cast("array<double>").alias("vector")
    d, a = deleted.select("path", name, vector), added.select("path", name, vector)
    blocks = d.groupBy("name").agg(F.ceil(F.count(F.lit(1)) / MEET).alias("d_blocks")).join(a.groupBy("name").agg(F.ceil(F.count(F.lit(1)) / MEET).alias("a_blocks")), "name")

    def dealt(rows: DataFrame, own: str, other: str, gone: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("path"), F.col(f"{own}_blocks")).alias(own)
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1)).alias(other)
        return rows.join(blocks, "name").select("path", "name", "vector", mine, others, F.lit(gone).alias("gone"))

    both = staged(dealt(d, "d", "a", True).unionByName(dealt(a, "a", "d", False)), "named")
    n = max(1, both.count() // (4 * MEET))
    both = both.withColumn("bucket", F.pmod(F.xxhash64("name", "d", "a"), F.lit(n)))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        source, target, similarity = [], [], []
        for _, own in pdf.groupby(["name", "d", "a"], sort=False):
            gone, new = own[own.gone], own[~own.gone].sort_values("path", key=lambda p: p.map(str.encode))
            if len(gone) and len(new):
                s = _similarities(gone.vector, new.vector)
                at = s.argmax(axis=1)  # of equal ones the first path
                source += gone.path.tolist()
                target += [new.path.iloc[j] for j in at.tolist()]
                similarity += s[np.arange(len(s)), at].tolist()
        return pd.DataFrame({"source": pd.Series(source, dtype=object), "target": pd.Series(target, dtype=object), "similarity": similarity})

    scored = both.groupBy("bucket").applyInPandas(best, "source string, target string, similarity double").filter(F.col("similarity") >= least)
    top = scored.groupBy("source").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "target")).alias("best"))
    return top.select("source", "best.target", (-F.col("best.far")).alias("similarity"))


def _similarities(x: pd.Series, y: pd.Series) -> np.ndarray:
    """Clamped cosines (12 digits) of each two vectors; 0 for null, empty, unequal or vanishing ones, and where the result is no number."""
    out = np.zeros((len(x), len(y)))
    length = [np.array([-1 if v is None else len(v) for v in side]) for side in (x, y)]
    for n in np.intersect1d(*length):
        if n > 0:
            i, j = (np.flatnonzero(own == n) for own in length)
            units = []
            for side, at in ((x, i), (y, j)):
                m = np.stack(side.to_numpy()[at]).astype(float)
                size = np.linalg.norm(m, axis=1, keepdims=True)
                units.append(np.divide(m, size, out=np.zeros_like(m), where=size > EPSILON))
            out[np.ix_(i, j)] = np.nan_to_num(np.clip(np.round(units[0] @ units[1].T, 12), 0, 1), nan=0.0)
    return out


def name_pairs(deleted: DataFrame, added: DataFrame) -> DataFrame:
    """(source, target): the n-th deleted with the n-th added file of each base name, each used once. Inputs: (ord, path)."""
    def ranked(df: DataFrame, out: str) -> DataFrame:
        name = T.base_name(F.col("path"))
        return df.select(name.alias("name"), F.col("path").alias(out), F.row_number().over(Window.partitionBy(name).orderBy("ord", "path")).alias("n"))

    return ranked(deleted, "source").join(ranked(added, "target"), ["name", "n"]).select("source", "target")


def move_groups(pairs: DataFrame) -> DataFrame:
    """(source_dir, target_dir, n_moves, files, description) of moves (source, target) between the same two directories; with diff_id, those of each diff apart."""
    own = [c for c in ("diff_id",) if c in pairs.columns]
    d = pairs.withColumn("source_dir", T.directory(F.col("source"))).withColumn("target_dir", T.directory(F.col("target")))
    g = d.groupBy(*own, "source_dir", "target_dir").agg(F.count(F.lit(1)).alias("n_moves"), F.array_sort(F.collect_list(F.struct("source", "target"))).alias("m"))
    first = F.col("m")[0]
    name = lambda c: F.when(c == "", "root directory").otherwise(c)
    there = F.concat(F.lit(" from "), name(F.col("source_dir")), F.lit(" to "), name(F.col("target_dir")))
    one = F.col("n_moves") == 1
    text = (
        F.when((F.col("source_dir") == F.col("target_dir")) & one, F.concat(F.lit("chore: rename "), T.base_name(first["source"]), F.lit(" to "), T.base_name(first["target"])))
        .when(F.col("source_dir") == F.col("target_dir"), F.concat(F.lit("chore: rename "), "n_moves", F.lit(" files in "), F.when(F.col("source_dir") == "", ".").otherwise(F.col("source_dir"))))
        .when(one, F.concat(F.lit("chore: move "), T.base_name(first["source"]), there))
        .otherwise(F.concat(F.lit("chore: move "), "n_moves", F.lit(" files"), there))
    )
    return g.select(*own, "source_dir", "target_dir", "n_moves", F.flatten(F.transform("m", lambda x: F.array(x["source"], x["target"]))).alias("files"), text.alias("description"))


def batches(files: DataFrame, most: int = FILES_AT_ONCE, size: int = BATCH) -> DataFrame:
    """(diff_id, file_path, batch): one batch per diff of up to `most` files, else batches of `size` inside each directory, in file order."""
    by = Window.partitionBy("diff_id", "folder").orderBy("nth")
    d = files.withColumn("folder", T.directory(F.col("file_path"))).withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("diff_id")) > most)
    part = F.floor((F.row_number().over(by) - 1) / size)
    return d.select("diff_id", "file_path", F.when(F.col("many"), F.concat_ws("#", "folder", part.cast("string"))).otherwise("all").alias("batch"))


def semantic_split(diffs: DataFrame, moved: DataFrame | None = None, limit: int = PART_LIMIT) -> DataFrame:
    """(diff_id, nth, part, file_path, kind, content) of all files but moved ones (source, target, and diff_id if they are of one diff only).

    A diff without hunks is kept whole; one above the limit is packed by hunks
    if it has several; one whose language has boundaries is cut into sections; else every hunk is
    a part of its own.
    """
    files = file_diffs(diffs).filter(valid_filename(F.col("file_path")))
    if moved is not None:
        own = [c for c in ("diff_id",) if c in moved.columns]
        files = files.join(_of_moves(moved, own), [*own, "file_path"], "left_anti")
    several = F.size(F.split(F.concat(F.lit("\n"), "content"), "\n@@", 3)) > 2
    h = sections(files).join(files.select("diff_id", "nth", F.length("content").alias("whole"), several.alias("several"), F.regexp_extract("content", r"(?s)^(.*?)(?=\n@@ |\z)", 1).alias("head")), ["diff_id", "nth"])
    p = packed(h, ["diff_id", "nth"], "hunk_no", F.length("body") + 1, limit, F.length("head") + 1).withColumnRenamed("part", "pack")
    ext = F.regexp_replace(T.extension(F.col("file_path")), r"^\.", "")
    known = ext.isin(list(BOUNDARIES))
    kind = F.when((F.col("whole") > limit) & F.col("several"), "large").when(known, "section").otherwise("hunk")
    part = F.when(kind == "large", F.col("pack")).when(kind == "section", F.col("section")).otherwise(F.col("hunk_no")).cast("int")
    joined = p.withColumn("kind", kind).withColumn("part", part).groupBy("diff_id", "nth", "part", "file_path", "kind").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk_no", "body"))), lambda x: x["body"]), "\n").alias("content"), F.first("head").alias("head")
    )
    cut = joined.select("diff_id", "nth", "part", "file_path", "kind", F.concat_ws("\n", "head", "content").alias("content"))
    whole = files.join(h.select("diff_id", "nth").distinct(), ["diff_id", "nth"], "left_anti")
    return cut.unionByName(whole.select("diff_id", "nth", F.lit(1).alias("part"), "file_path", F.lit("whole").alias("kind"), "content"))


def _of_moves(moved: DataFrame, own: list[str]) -> DataFrame:
    return moved.select(*own, F.col("source").alias("file_path")).unionByName(moved.select(*own, F.col("target").alias("file_path"))).distinct()


def split_whole(diffs: DataFrame, files: DataFrame, moved: DataFrame | None = None, limit: int = PART_LIMIT) -> DataFrame:
    """(diff_id, kind, batch, file_path, part, files, content, description): all parts of each diff.

    files: (diff_id, nth, file_path), what each diff names, untracked files too. Moves (diff_id, source, target) come first,
    a part for each two directories with all their files' diffs (kind move). Of the other files each gives
    the parts of `semantic_split`, or one without content if the diff doesn't hold it (kind missing); batch says which are handled
    together: all of a diff, or three at a time of a directory if there are over FILES_AT_ONCE.
    """
    own = files.filter(valid_filename(F.col("file_path"))).select("diff_id", "nth", "file_path")
    parts = None
    if moved is not None:
        groups = move_groups(moved).withColumn("file_path", F.explode(F.array_distinct("files")))
        text = file_diffs(diffs).select("diff_id", "file_path", "nth", "content")
        held = groups.join(text, ["diff_id", "file_path"], "left").groupBy("diff_id", "source_dir", "target_dir").agg(
            F.first("files").alias("files"), F.first("description").alias("description"), F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("nth", "content")))).alias("all")
        )
        content = F.array_join(F.transform("all", lambda x: F.concat(x["content"], F.lit("\n"))), "")
        none = F.lit(None).cast("string")
        parts = held.select("diff_id", F.lit("move").alias("kind"), none.alias("batch"), none.alias("file_path"), F.lit(1).alias("part"), "files", content.alias("content"), "description")
        own = own.join(_of_moves(moved, ["diff_id"]), ["diff_id", "file_path"], "left_anti")
    own = staged(own.join(batches(own), ["diff_id", "file_path"]), "files")
    cut = semantic_split(diffs, moved, limit).drop("nth")
    rest = own.join(cut, ["diff_id", "file_path"], "left")
    rest = rest.select(
        "diff_id", F.coalesce("kind", F.lit("missing")).alias("kind"), "batch", "file_path", F.coalesce("part", F.lit(1)).alias("part"), F.array("file_path").alias("files"), F.coalesce("content", F.lit("")).alias("content"), F.concat(F.lit("Changes in "), "file_path").alias("description")
    )
    return rest if parts is None else parts.unionByName(rest)


def malformed(content: Column) -> Column:
    """Whether a file's diff has a hunk header that can't be read."""
    return F.exists(T.lines(content), lambda x: F.startswith(x, F.lit("@@")) & ~F.regexp_like(x, F.lit(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@")))


def split(diffs: DataFrame, moved: DataFrame | None = None, limit: int = PART_LIMIT) -> DataFrame:
    """`semantic_split`, but a diff any file of which is malformed gives one part (kind file) for each of its files."""
    bad = file_diffs(diffs).filter(malformed(F.col("content"))).select("diff_id").distinct()
    good = semantic_split(diffs.join(bad, "diff_id", "left_anti"), moved, limit)
    rest = file_chunks(diffs.join(bad, "diff_id", "left_semi"))
    return good.unionByName(rest.select("diff_id", "nth", F.lit(1).alias("part"), "file_path", F.lit("file").alias("kind"), "content"))


def by_precedence(staged: DataFrame, unstaged: DataFrame, untracked: DataFrame, key: str = "file_path") -> DataFrame:
    """One row per file: staged before unstaged before untracked."""
    rows = None
    for rank, df in enumerate((staged, unstaged, untracked)):
        part = df.withColumn("precedence", F.lit(rank))
        rows = part if rows is None else rows.unionByName(part)
    n = F.row_number().over(Window.partitionBy(key).orderBy("precedence"))
    return rows.withColumn("n", n).filter("n = 1").drop("n")


def existing(files: DataFrame, *known: DataFrame, key: str = "file_path") -> DataFrame:
    """Valid file names that are in any of the known sets (on disk, tracked, deleted)."""
    keys = None
    for k in known:
        keys = k.select(key) if keys is None else keys.unionByName(k.select(key))
    return files.filter(valid_filename(F.col(key))).join(keys.distinct(), key, "left_semi")
