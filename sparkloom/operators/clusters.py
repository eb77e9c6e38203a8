"""Grouping of changes: linkage clusters, leader clusters, relatedness, repair of file integrity."""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import norm
from .components import Staged, connected_components, ranked, staged

#: Distance below which complete linkage merges, and similarity at which groups merge.
LINKAGE, MERGE = 0.3, 0.6
#: Rows of a part of groups that one task repairs, and rows of such parts that a task gets at once.
SMALL, TOGETHER = 2000, 20_000
#: Pairs of groups that are compared at once, and numbers of their vectors.
COMPARED = 2_000_000
#: Ids of a path that meet others at once, pairs that a task makes, and tasks that make them at most.
MET, MADE, TASKS = 3_000, 20_000_000, 10_000
#: Last characters of a text by which it is looked for in others.
HELD = 24


def complete_linkage(distance: np.ndarray, threshold: float = LINKAGE) -> np.ndarray:
    """Labels (index of each cluster's first member) after merging the nearest two clusters while their farthest members are below the threshold."""
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    label = np.arange(len(d))
    while len(d) > 1:
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if not d[i, j] < threshold:
            break
        i, j = min(i, j), max(i, j)
        far = np.maximum(d[i], d[j])
        d[i], d[:, i] = far, far
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        label[label == j] = i
    return label


def linkage_clusters(points: DataFrame, block_col: str, id_col: str = "id", vector_col: str = "vector", threshold: float = LINKAGE) -> DataFrame:
    """(id, cluster): complete linkage on cosine distance inside each block (say a directory); a cluster is named by its least id.

    Only pairs below the threshold are held, since clusters with any farther
    pair never merge. In each round all pairs of clusters that are nearest to
    each other merge, which for complete linkage gives what merging the nearest
    pair of all one after another gives; the distance of two new clusters is the
    greatest between their parts, if all of these are held.
    """
    from .search import pairs_within

    names = points.select(F.col(id_col).cast("long").alias("id"), F.col(id_col).cast("long").alias("cluster"))
    d = staged(pairs_within(points, threshold, id_col, vector_col, within=block_col).filter(F.col("distance") < threshold), "linked")
    while True:
        pair = F.struct("distance", "a", "b").alias("p")
        nearest = d.select(F.col("a").alias("u"), pair).unionByName(d.select(F.col("b").alias("u"), pair)).groupBy("u").agg(F.min("p").alias("p"))
        merges = staged(nearest.groupBy("p").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select(F.col("p.a").alias("into"), F.col("p.b").alias("gone")), "merges")
        if not merges.limit(1).count():
            return names
        a, b = (merges.select(F.col("gone").alias(c), F.col("into").alias(f"{c}_into")) for c in ("a", "b"))
        moved = d.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_into", "a").alias("x"), F.coalesce("b_into", "b").alias("y"), "distance").filter("x <> y")
        moved = moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("distance").alias("distance"), F.count(F.lit(1)).alias("n"))
        a, b = (merges.select(F.col("into").alias(c), F.lit(2).alias(f"{c}_parts")) for c in ("a", "b"))
        whole = moved.join(a, "a", "left").join(b, "b", "left").filter(F.col("n") == F.coalesce("a_parts", F.lit(1)) * F.coalesce("b_parts", F.lit(1)))
        d = staged(whole.select("a", "b", "distance"), "linked")
        names = staged(names.join(merges, names["cluster"] == merges["gone"], "left").select("id", F.coalesce("into", "cluster").alias("cluster")), "names")


def leader_clusters(points: DataFrame, block_col: str, threshold: float, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, leader): in each block the first unassigned point (by id) leads, and takes all unassigned ones of at least this clamped similarity."""
    from .search import pairs_within

    pairs = pairs_within(points, 1 - threshold, id_col, vector_col, within=block_col)
    return leaders(points.select(F.col(id_col).cast("long").alias("id")), pairs)


def leaders(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, leader) of greedy grouping by id over alike pairs (a, b), a < b: whoever is like no leader before it leads.

    In each round everyone whose lower partners are all decided is decided: it
    leads if none of them leads. Rounds go on as long as chains of undecided
    partners are, and all of a round is joins on ids.
    """
    pairs = staged(pairs.select("a", "b"), "alike")
    lead = staged(ids.join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_anti").select("id"), "leaders")
    left = staged(ids.join(lead, "id", "left_anti"), "undecided")
    while left.limit(1).count():
        led = pairs.join(lead.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        open_ = left.join(led, "id", "left_anti")
        waits = pairs.join(open_.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        new = staged(open_.join(waits, "id", "left_anti"), "leaders")
        left = staged(open_.join(new, "id", "left_anti"), "undecided")
        lead = lead.unionByName(new)
    lead = staged(lead, "leaders")
    first = pairs.join(lead.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("first"))
    own = ids.join(lead.withColumn("leads", F.lit(True)), "id", "left").join(first, "id", "left")
    return own.select("id", F.when(F.col("leads"), F.col("id")).otherwise(F.col("first")).alias("leader"))


def related_keys(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What `related` says of the files (change_id, id, path) of each change, without pairs of files: keys (change_id, id, key) and like (change_id, key, other), the keys that belong together. Two files are related if a key of one is like a key of the other.

    Keys are the top directory, base name, its stem, the path where a test path holds it, and the sides of the pattern pairs
    that match. Which stem or path holds which is found by the texts of up to HELD
    characters that it holds, so it takes no pairs either.
    """
    f = files.select("change_id", "id", "path")
    path, name, folder = F.col("path"), T.base_name(F.col("path")), T.directory(F.col("path"))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    sides = [(f"{side}{i}", rf"(?i)\A(?:{p})") for i, pair in enumerate(RELATED) for side, p in zip("pq", pair, strict=True)]
    named = [F.when(folder != "", F.concat(F.lit("d:"), F.substring_index(folder, "/", 1))), F.when(F.length(stem) >= 3, F.concat(F.lit("s:"), stem)), F.concat(F.lit("n:"), name), F.concat(F.lit("t:"), path)]
    own = F.array(*named, *[F.when(path.rlike(p), F.lit(k)) for k, p in sides])
    keys = f.select("change_id", "id", F.explode(F.array_compact(own)).alias("key")).distinct()
    paths = f.select("change_id", "path").distinct()
    same = keys.filter("key LIKE 'd:%' OR key LIKE 's:%'").select("change_id", "key", F.col("key").alias("other")).distinct()
    bare = F.when(F.startswith(name, F.lit("test_")), F.substring(name, 6, 2**31 - 1)), F.when(name.rlike(r"_test\.py$"), F.regexp_replace(name, r"_test\.py$", ".py"))
    tested = paths.select("change_id", F.concat(F.lit("n:"), name).alias("key"), F.explode(F.array_compact(F.array(*bare))).alias("other")).select("change_id", "key", F.concat(F.lit("n:"), "other").alias("other"))
    stems = paths.select("change_id", stem.alias("text")).filter("length(text) >= 3").distinct()
    inside = _held(stems, stems, "s:").unionByName(_held(paths.filter(F.startswith("path", F.lit("tests/"))).select("change_id", F.col("path").alias("text")), paths.select("change_id", F.col("path").alias("text")), "t:"))
    patterns = paths.select("change_id").distinct().select("change_id", F.explode(F.array(*[F.lit(i) for i in range(len(RELATED))])).alias("i")).select("change_id", F.concat(F.lit("p"), "i").alias("key"), F.concat(F.lit("q"), "i").alias("other"))
    one = tested.unionByName(inside).unionByName(patterns)
    return keys, same.unionByName(one).unionByName(one.select("change_id", F.col("other").alias("key"), F.col("key").alias("other"))).distinct()


def _held(holders: DataFrame, texts: DataFrame, mark: str) -> DataFrame:
    """(change_id, key, other) for each text (change_id, text) and a holder in which it stands, both marked. A text is looked for by its last HELD characters."""
    end = F.right("text", F.lit(HELD))
    lengths = texts.groupBy("change_id").agg(F.collect_set(F.length(end)).alias("lengths"))  # HELD at most
    parts = F.explode(F.expr("array_distinct(flatten(transform(lengths, n -> transform(sequence(1, greatest(1, length(text) - n + 1)), i -> substring(text, i, n)))))"))
    there = holders.join(lengths, "change_id").select("change_id", F.col("text").alias("holder"), parts.alias("part"))
    met = texts.select("change_id", "text", end.alias("part")).join(there, ["change_id", "part"]).filter(F.contains("holder", "text") & (F.col("holder") != F.col("text")))
    return met.select("change_id", F.concat(F.lit(mark), "holder").alias("key"), F.concat(F.lit(mark), "text").alias("other")).distinct()


def related_pairs(files: DataFrame) -> DataFrame:
    """(change_id, a, b), a < b: the related files of each change.

    Files of one path are related to the same ones, so keys are joined, and made unique, by path. The ids of a path are dealt to
    blocks of MET, and pairs are made where two blocks meet: what is shuffled
    is related paths, and a path's ids once for each block that they meet, but no pairs of files of one path. Pairs come in
    runs of one id with others in order. Code made for both explodes together would hold all pairs of two blocks (9 million) as rows before
    the first is given on; the coalesce, which merges no tasks, parts them, so one id's pairs are held, and a block once for each id of another (72 MB). An id that has
    several paths in a change is found by each, so only then pairs are made unique.
    """
    f = files.select("change_id", "id", "path").filter("change_id IS NOT NULL AND id IS NOT NULL AND path IS NOT NULL")
    several = f.groupBy("change_id", "id").agg((F.min("path") != F.max("path")).alias("several")).filter("several").limit(1).count()
    paths = f.groupBy("change_id", "path").agg(F.ceil(F.approx_count_distinct("id") / MET).alias("blocks"))
    paths = staged(ranked(paths, "change_id", "path"), "paths")
    keys, like = related_keys(paths.withColumnRenamed("place", "id"))
    x, y = keys.select("change_id", "key", F.col("id").alias("x")), keys.select("change_id", F.col("key").alias("other"), F.col("id").alias("y"))
    alike = staged(x.join(like, ["change_id", "key"]).join(y, ["change_id", "other"]).filter("x <= y").select("x", "y").distinct(), "alike")
    dealt = f.join(paths, ["change_id", "path"]).select("change_id", "place", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id")
    blocks = staged(dealt.groupBy("change_id", "place", "block").agg(F.array_sort(F.collect_set("id")).alias("ids")), "blocks")
    size = blocks.select("place", "block", F.size("ids").cast("long").alias("n"))
    a, b = (size.select(F.col("place").alias(c), F.col("block").alias(f"{c}_block"), F.col("n").alias(f"n{c}")) for c in "xy")
    meet = staged(alike.join(a, "x").join(b, "y").filter("x < y OR x_block <= y_block").select("x", "x_block", "y", "y_block", (F.col("nx") * F.col("ny")).alias("n")), "meet")
    tasks = min(TASKS, 1 + (meet.agg(F.sum("n")).first()[0] or 0) // MADE)
    a, b = (blocks.select(F.col("place").alias(c), F.col("block").alias(f"{c}_block"), F.col("ids").alias(f"{c}_ids"), "change_id") for c in "xy")
    both = meet.join(a, ["x", "x_block"]).join(b.drop("change_id"), ["y", "y_block"]).repartition(tasks, "x", "x_block", "y", "y_block")
    one = both.select("change_id", F.expr("x = y AND x_block = y_block").alias("own"), F.explode("x_ids").alias("i"), "y_ids").coalesce(TASKS)
    pairs = one.select("change_id", "own", "i", F.explode("y_ids").alias("j")).filter("i < j OR (i > j AND NOT own)").select("change_id", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    return pairs.distinct() if several else pairs


def related_groups(files: DataFrame) -> DataFrame:
    """(change_id, id, leader): greedy grouping of the files (change_id, id, path) of each change, in order of ids: whoever is related to no leader before it leads, and others follow the first leader that is related.

    No pairs are made: a round knows of each key the least leader and the least
    undecided file. Rounds go on as long as chains of files that wait for each other are.
    """
    spark = files.sparkSession
    stage = Staged(spark)
    keys, like = related_keys(files)
    like, keys = stage(like, "like"), stage(keys, "keys")
    left, lead, turn = stage(files.select("change_id", "id").distinct(), "undecided"), None, None

    def least(of: DataFrame) -> DataFrame:
        """(change_id, id, least): of files with related ones in `of`, the least of these."""
        by_key = keys.join(of, ["change_id", "id"]).groupBy("change_id", "key").agg(F.min("id").alias("least"))
        other = by_key.join(like, ["change_id", "key"]).groupBy("change_id", F.col("other").alias("key")).agg(F.min("least").alias("least"))
        return keys.join(other, ["change_id", "key"]).groupBy("change_id", "id").agg(F.min("least").alias("least"))

    while left.limit(1).count():
        now = Staged(spark)
        new = left.join(least(left), ["change_id", "id"], "left").filter("least IS NULL OR least >= id").select("change_id", "id")
        new = stage(new, "leaders")
        lead = new if lead is None else lead.unionByName(new)
        led = least(new).filter("least < id").select("change_id", "id")
        left = now(left.join(new, ["change_id", "id"], "left_anti").join(led, ["change_id", "id"], "left_anti"), "undecided")
        if turn:
            turn.drop()
        turn = now
    if lead is None:
        return files.select("change_id", "id", F.col("id").alias("leader"))
    own = files.select("change_id", "id").join(lead.withColumn("leads", F.lit(True)), ["change_id", "id"], "left").join(least(lead), ["change_id", "id"], "left")
    out = staged(own.select("change_id", "id", F.when(F.col("leads"), F.col("id")).otherwise(F.col("least")).alias("leader")), "groups")
    stage.drop()
    return out


def consolidated(chunks: DataFrame, least: int = 2) -> DataFrame:
    """(change_id, ord, into) of single-file chunks (change_id, ord, path): the chunk (its ord) that each is merged into.

    In order, each chunk that is not merged yet takes later ones of its own file,
    and one of a related file, after which it holds two files and takes no more. Changes of
    fewer than `least` chunks stay. A change (what one commit holds) is one group, of chunks and
    their keys, not of pairs.
    """
    f = chunks.select("change_id", "ord", "path")
    keys, like = related_keys(f.withColumnRenamed("ord", "id"))
    own = keys.groupBy("change_id", F.col("id").alias("ord")).agg(F.collect_set("key").alias("keys"))
    near = keys.join(like, ["change_id", "key"]).groupBy("change_id", F.col("id").alias("ord")).agg(F.collect_set("other").alias("others"))
    rows = f.join(own, ["change_id", "ord"], "left").join(near, ["change_id", "ord"], "left")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        order, paths = pdf.ord.tolist(), pdf.path.tolist()
        into: dict = {}
        by: dict = {}
        for at, path, held in zip(order, paths, pdf["keys"], strict=True):
            for k in ({("path", path)} | set(held if held is not None else [])) if len(pdf) >= least else ():
                by.setdefault(k, []).append((at, path))

        def first(k, after, path):
            """The first chunk of key k after `after` that is not merged and of another file."""
            return next((o for o, p in by.get(k, ())[bisect_right(by.get(k, ()), after, key=lambda x: x[0]) :] if o not in into and p != path), None)

        for at, path, others in zip(order, paths, pdf.others, strict=True):
            if at in into:
                continue
            into[at] = at
            found = [o for k in (others if others is not None else []) if (o := first(k, at, path)) is not None]
            stop = min(found, default=None)
            for o, _ in by.get(("path", path), ()):
                if o > at and o not in into and (stop is None or o < stop):
                    into[o] = at
            if stop is not None:
                into[stop] = at
        return pd.DataFrame({"change_id": pdf.change_id, "ord": pdf.ord, "into": [into[o] for o in order]})

    kind = dict(f.dtypes)
    return rows.groupBy("change_id").applyInPandas(one, f"change_id {kind['change_id']}, ord {kind['ord']}, into {kind['ord']}")


#: Pairs of patterns (from the start, without case) of files that belong together.
RELATED = [
    (r"^(.*)\.rb$", r"spec/.*_spec\.rb$"),
    (r"src/(lib|main)\.rs$", r"tests/.*\.rs$"),
    (r"(openapi|swagger)\.(yaml|yml|json)$", r".*\.(go|py|js|java|rb|cs|ts)$"),
    (r"^(.*)\.(kt|java)$", r"res/layout/.*\.(xml)$"),
    (r"AndroidManifest\.xml$", r".*\.(kt|java)$"),
    (r"build\.gradle(\.kts)?$", r".*\.(kt|java)$"),
    (r"package\.json$", r"(package-lock\.json|yarn\.lock|pnpm-lock\.yaml)$"),
    (r"requirements\.txt$", r"(setup\.py|setup\.cfg|pyproject\.toml)$"),
    (r"pyproject\.toml$", r"(setup\.py|setup\.cfg|poetry\.lock|uv\.lock)$"),
    (r"Gemfile$", r"Gemfile\.lock$"),
    (r"Cargo\.toml$", r"Cargo\.lock$"),
    (r"composer\.json$", r"composer\.lock$"),
    (r"go\.mod$", r"go\.sum$"),
    (r"pom\.xml$", r".*\.java$"),
    (r"package\.json$", r"(tsconfig\.json|\.eslintrc(\.js|\.json)?|\.prettierrc(\.js|\.json)?|\.babelrc|webpack\.config\.js|vite\.config\.(js|ts))$"),
    (r"pyproject\.toml$", r"(\.flake8|\.pylintrc|\.isort\.cfg|mypy\.ini)$"),
    (r"Dockerfile$", r"(\.dockerignore|docker-compose\.yml)$"),
    (r"docker-compose\.yml$", r"\.env$"),
    (r"\.github/workflows/.*\.yml$", r".*\.(sh|py|js|ts|go)$"),
    (r"\.gitlab-ci\.yml$", r".*\.(sh|py|js|ts|go)$"),
    (r"Jenkinsfile$", r".*\.(groovy|sh|py)$"),
    (r"README\.md$", r".*$"),
    (r"docs/.*\.md$", r"src/.*$"),
    (r"^(.*)\.py$", r"data/.*\.(csv|json|parquet)$"),
]


def test_names_match(a: Column, b: Column) -> Column:
    """test_X and X, or X_test.py and X.py, either way round."""
    one = lambda x, y: (F.startswith(x, F.lit("test_")) & (F.substring(x, 6, 2**31 - 1) == y)) | (x.rlike(r"_test\.py$") & (F.regexp_replace(x, r"_test\.py$", ".py") == y))
    return one(a, b) | one(b, a)


def similar_names(a: Column, b: Column, least: int = 3) -> Column:
    """One base name holds the other, and both have at least `least` characters."""
    x, y = F.regexp_replace(a, r"\.[^.]*$", ""), F.regexp_replace(b, r"\.[^.]*$", "")
    return (F.contains(x, y) | F.contains(y, x)) & (F.least(F.length(x), F.length(y)) >= least)


def matches_pair(a: Column, b: Column, patterns: list[tuple[str, str]] = RELATED) -> Column:
    hit = F.lit(False)
    for p, q in patterns:
        p, q = rf"(?i)\A(?:{p})", rf"(?i)\A(?:{q})"
        hit = hit | (a.rlike(p) & b.rlike(q)) | (a.rlike(q) & b.rlike(p))
    return hit


def related(a: Column, b: Column, patterns: list[tuple[str, str]] = RELATED) -> Column:
    """Whether two paths belong together: same, parent or same top directory; a test path that holds the other; matching or similar names; a pair of patterns."""
    da, db = T.directory(a), T.directory(b)
    dirs = (da != "") & (db != "")
    top = lambda c: F.substring_index(c, "/", 1)
    near = dirs & ((da == db) | F.startswith(da, F.concat(db, F.lit("/"))) | F.startswith(db, F.concat(da, F.lit("/"))) | (top(da) == top(db)))
    tests = (F.startswith(a, F.lit("tests/")) & F.contains(a, b)) | (F.startswith(b, F.lit("tests/")) & F.contains(b, a))
    na, nb = T.base_name(a), T.base_name(b)
    return near | tests | test_names_match(na, nb) | similar_names(na, nb) | matches_pair(a, b, patterns)


def shortcut(groups: DataFrame, most: int = 3) -> DataFrame:
    """Group ids (change_id, chunk_id, group_id): one group for a change of up to `most` chunks."""
    n = groups.groupBy("change_id").agg(F.count(F.lit(1)).alias("n"), F.min("group_id").alias("first"))
    return groups.join(n, "change_id").select("change_id", "chunk_id", F.when(F.col("n") <= most, F.col("first")).otherwise(F.col("group_id")).alias("group_id"))


def _similar_groups(pairs: DataFrame, own: DataFrame, units: DataFrame) -> DataFrame:
    """pairs (a, b and more) of groups with s, the mean cosine of their chunks: the dot product of the groups' mean unit vectors. own: (group_id, chunk_id); a group without a vector is like none."""
    rows = own.join(units, "chunk_id")
    size = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    mean = rows.select("group_id", F.posexplode("unit").alias("at", "v")).groupBy("group_id", "at").agg(F.sum("v").alias("v")).join(size, "group_id").select("group_id", "at", (F.col("v") / F.col("size")).alias("v"))
    a, b = (mean.select(F.col("group_id").alias(c), "at", F.col("v").alias(f"v{c}")) for c in ("a", "b"))
    found = pairs.select("a", "b").distinct().join(a, "a").join(b, ["b", "at"]).groupBy("a", "b").agg(F.round(F.sum(F.col("va") * F.col("vb")), 12).alias("s"))
    return pairs.join(found, ["a", "b"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))


def _places(lengths: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each length n, one after another."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where one of the columns has another value than a row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _firsts(hit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of consecutive runs of these lengths, each with a hit, the place of the first one."""
    at = np.flatnonzero(hit)
    return at[_starts(np.repeat(np.arange(len(lengths)), lengths)[at])]


def _ordered(values: pa.Array) -> np.ndarray:
    """A number for each value, in their order."""
    found = values.dictionary_encode()
    number = np.empty(len(found.dictionary), np.int64)
    number[pc.sort_indices(found.dictionary).to_numpy()] = np.arange(len(number))
    return number[found.indices.to_numpy()]


def _equal(values: pa.Array) -> np.ndarray:
    """A number for each value, null too."""
    return values.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)


def _unit_rows(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, the shorter ones ending in zeros, and which rows have one. Vanishing vectors and such with a null are zero."""
    has = vectors.is_valid().to_numpy(zero_copy_only=False)
    n = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy().astype(np.int64)
    flat = vectors.flatten().cast(pa.float64())
    row = np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), max(1, n.max(initial=0))))
    out[row, _places(n)] = flat.fill_null(0.0).to_numpy()
    out[row[flat.is_null().to_numpy(zero_copy_only=False)]] = 0
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(size > 0, size, 1), has


def _most_similar(mean: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(s, x, y) of consecutive runs of two or more rows: the most similar pair of each, x before y, the first of equal ones."""
    n, ends = lengths * (lengths - 1) // 2, np.cumsum(lengths)
    cuts = [*_starts(np.cumsum(n) // COMPARED), len(n)]
    found = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = np.arange(ends[a] - lengths[a], ends[b - 1])
        after = np.repeat(ends[a:b], lengths[a:b]) - own - 1
        x = np.repeat(own, after)
        y = x + 1 + _places(after)
        step = max(1, COMPARED // mean.shape[1])
        s = np.concatenate([np.einsum("ij,ij->i", mean[x[i : i + step]], mean[y[i : i + step]]) for i in range(0, len(x), step)])
        s = np.nan_to_num(np.rint(s * 1e12) / 1e12)
        at = _firsts(s == np.repeat(np.maximum.reduceat(s, np.cumsum(n[a:b]) - n[a:b]), n[a:b]), n[a:b])
        found.append((s[at], x[at], y[at]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _repaired_rows(p: np.ndarray, g: np.ndarray, c: np.ndarray, f: np.ndarray, unit: np.ndarray, has: np.ndarray, merge: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, group) of what is left of rows of many parts p, worked through side by side: each part takes its next step in each turn. Groups g and files f are numbered in order, apart for each part, and so are chunks c."""
    n_g, n_c, n_p = g.max(initial=0) + 1, c.max(initial=0) + 1, p.max(initial=0) + 1
    at, moved, done = np.arange(len(p)), np.zeros(n_c, bool), []
    while True:
        key = (f[at] * n_g + g) * n_c + c[at]
        key, order = np.unique(key, return_index=True)  # a chunk that two groups held is there once
        at, g = at[order], g[order]
        first = _starts(key // n_c)  # a group that holds a file
        n = np.diff(np.r_[first, len(at)])
        file, group, part, again = f[at[first]], g[first], p[at[first]], np.logical_or.reduceat(moved[c[at]], first) if len(at) else first
        ahead = _starts(file)
        held = np.diff(np.r_[ahead, len(file)])
        ahead, held = ahead[held > 1], held[held > 1]
        order = np.lexsort((file[ahead], group[ahead], part[ahead]))
        ahead, held = ahead[order], held[order]
        next_ = _starts(part[ahead])  # the next file of each part
        ahead, held = ahead[next_], held[next_]
        active = np.zeros(n_p, bool)
        active[part[ahead]] = True
        keep = active[p[at]]
        done.append((at[~keep], g[~keep]))
        if not len(ahead):
            return tuple(map(np.concatenate, zip(*done, strict=True)))
        own = np.repeat(ahead, held) + _places(held)  # the groups of these files
        starts, named = np.cumsum(held) - held, group[own]
        number = np.full(n_g, -1)
        number[named] = np.arange(len(own))
        rows = np.flatnonzero((number[g] >= 0) & has[at])
        rows = rows[np.unique(number[g[rows]] * n_c + c[at[rows]], return_index=True)[1]]
        of = number[g[rows]]
        mean = np.zeros((len(own), unit.shape[1]))
        if len(rows):
            s = _starts(of)
            mean[of[s]] = np.add.reduceat(unit[at[rows]], s, axis=0) / np.diff(np.r_[s, len(of)])[:, None]
        s, x, y = _most_similar(mean, held)
        alike, into = s >= merge, np.arange(n_g)
        into[named[y[alike]]] = named[x[alike]]
        most = _firsts(n[own] == np.repeat(np.maximum.reduceat(n[own], starts), held), held)
        to = np.repeat(most, held)
        slot = np.repeat(np.arange(len(held)), held)
        back = np.flatnonzero(again[own] & (to != np.arange(len(own))) & ~alike[slot])
        back = back[_starts(slot[back])]
        into[np.maximum(named[to[back]], named[back])] = np.minimum(named[to[back]], named[back])
        alike[slot[back]] = True
        goes = np.flatnonzero(~alike[slot] & (to != np.arange(len(own))))
        dest = np.full(len(first), -1)
        dest[own[goes]] = named[to[goes]]
        dest = np.repeat(dest, n)
        gone, one = np.unique((g * n_c + c[at])[dest >= 0], return_index=True)
        new = into[g]
        if len(gone):  # a chunk goes with all its files
            place = np.minimum(np.searchsorted(gone, g * n_c + c[at]), len(gone) - 1)
            goes = gone[place] == g * n_c + c[at]
            new[goes] = dest[dest >= 0][one][place[goes]]
            moved[c[at[goes]]] = True
        at, g = at[keep], new[keep]


def _whole_parts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows in order of their part, in batches of whole parts and some `least` rows, with a number for each row's part."""
    left: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            left.append(batch)
        if left and (batch is None or sum(map(len, left)) >= least):
            rows = pa.concat_batches(left)
            new = _starts(_equal(rows.column("part")))
            end = len(rows) if batch is None else new[-1] if len(new) else 0
            left = [rows.slice(end)]
            if end:
                yield rows.slice(0, end), np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(rows)]))[:end]


def _side_by_side(rows: DataFrame, merge: float) -> DataFrame:
    """(group_id, chunk_id, file_path) of rows (part, group_id, chunk_id, file_path, vector), repaired by part: tasks get whole parts, in order, and work some TOGETHER rows of them through at once."""
    ids, kind = ["group_id", "chunk_id", "file_path"], dict(rows.dtypes)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, p in _whole_parts(batches, TOGETHER):
            apart = lambda x: np.unique(p * (x.max() + 1) + x, return_inverse=True)[1]  # noqa: E731, B023
            group, chunk, file = (own.column(c) for c in ids)
            g = apart(_ordered(group))
            named = np.unique(g, return_index=True)[1]
            at, to = _repaired_rows(p, g, apart(_equal(chunk)), apart(_ordered(file)), *_unit_rows(own.column("vector")), merge)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([group.take(pa.array(named[to])), chunk.take(at), file.take(at)], names=ids)

    return rows.select("part", *ids, "vector").repartition("part").sortWithinPartitions("part").mapInArrow(repair, ", ".join(f"{c} {kind[c]}" for c in ids))


def _numbered(m: DataFrame, col: str) -> DataFrame:
    """m with {col}_no, a number for each value in each part, in order."""
    n = ranked(m.select("part", col).distinct(), "part", col, name=f"{col}_no").withColumnsRenamed({"part": "in_part", col: "value"})
    return m.join(n, F.col("part").eqNullSafe(F.col("in_part")) & F.col(col).eqNullSafe(F.col("value"))).drop("in_part", "value")


def _repaired_within(m: DataFrame, merge: float) -> DataFrame:
    """`repaired` of rows (part, group_id, chunk_id, file_path, vector) whose parts share nothing. Parts of more than SMALL rows are numbered, so that they share no ids, and cut up further."""
    ids = ["group_id", "chunk_id", "file_path"]
    large = staged(m.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SMALL).select(F.col("part").alias("large")), "large")
    if not large.limit(1).count():
        return _side_by_side(m, merge)
    same = F.col("part").eqNullSafe(F.col("large"))
    small, m = _side_by_side(m.join(large, same, "left_anti"), merge), m.join(large, same, "left_semi")
    kept = Staged(m.sparkSession)
    for c in ids:
        m = _numbered(m, c)
    m = kept(m, "numbered")
    number = {f"{c}_no": c for c in ids}
    out = repaired(m.select(*number).withColumnsRenamed(number), m.select(F.col("chunk_id_no").alias("chunk_id"), "vector").dropDuplicates(["chunk_id"]), merge)
    out = out.withColumnsRenamed({c: n for n, c in number.items()})
    for n, c in number.items():
        out = out.join(m.select(n, c).distinct(), n)
    out = staged(small.unionByName(out.select(*ids)), "repaired")
    kept.drop()
    return out


def repaired(members: DataFrame, vectors: DataFrame | None = None, merge: float = MERGE, within: str | None = None) -> DataFrame:
    """(group_id, chunk_id, file_path) with every file in one group.

    One file at a time: the first one (in order of groups, then of paths) that
    several groups hold. Its two most similar groups (mean cosine of their
    chunks) become one, the lower, if they are at least `merge` alike; otherwise
    all its chunks move to the group with most of them, the lowest of such. Then
    everything is looked at anew. A chunk of several files could go to and fro
    for ever: where one would move again, the lowest group with such a chunk and
    the one it would go to become one instead. Groups that no chain of files connects don't
    touch each other: parts of up to SMALL rows are worked through side by side, by
    tasks that get some TOGETHER rows of them at once, and of larger ones each takes its
    own next step in a round of joins, as many rounds as the largest has steps.
    `within` names a column of members, say the change, whose values share no file and no group (equal ids in two of them are
    different ones): rows are dealt by it, and only values of more than SMALL rows are cut up by chains of files.
    Chunks without a vector are left out of the mean, vanishing vectors count in
    it as zero; rows without a path or a group are left out. Vectors are in `vectors` (chunk_id, vector), or else in a column of members.
    """
    spark = members.sparkSession
    m = members.filter("file_path IS NOT NULL AND group_id IS NOT NULL")
    if within is not None:
        m = m if vectors is None else m.drop("vector").join(vectors.select("chunk_id", "vector"), "chunk_id", "left")
        return _repaired_within(m.select(F.col(within).alias("part"), "group_id", "chunk_id", "file_path", "vector"), merge)
    if vectors is None:
        vectors = m.select("chunk_id", "vector").dropDuplicates(["chunk_id"])
    kept = Staged(spark)
    m = kept(m.select("group_id", "chunk_id", "file_path").distinct(), "members")
    ends = m.select(F.col("group_id").alias("g"), F.concat(F.lit("f"), "file_path").alias("f")).distinct()
    by_file = ends.groupBy("f").agg(F.min("g").alias("first"))
    part = connected_components(ends.join(by_file, "f").filter("g <> first").select(F.col("g").alias("a"), F.col("first").alias("b")).distinct())
    m = kept(m.join(part.withColumnRenamed("id", "group_id").withColumnRenamed("component", "part"), "group_id", "left").select(F.coalesce("part", "group_id").alias("part"), "group_id", "chunk_id", "file_path"), "members")
    torn = m.groupBy("part", "file_path").agg((F.min("group_id") != F.max("group_id")).alias("torn"), F.count(F.lit(1)).alias("n"))
    size = torn.groupBy("part").agg(F.max("torn").alias("torn"), (F.sum("n") <= SMALL).alias("small"))
    m = kept(m.join(size, "part"), "members")
    small = _side_by_side(m.filter("torn AND small").join(vectors.select("chunk_id", "vector"), "chunk_id", "left"), merge)
    done, turn = m.filter("NOT torn").select("group_id", "chunk_id", "file_path").unionByName(small), None
    m = m.filter("torn AND NOT small").drop("torn", "small").withColumn("moved", F.lit(False))
    if m.limit(1).count():
        size = norm(F.col("vector"))
        unit = F.transform("vector", lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))
        units = kept(vectors.filter("vector IS NOT NULL").select("chunk_id", unit.alias("unit")), "units")
    while m.limit(1).count():
        held = m.groupBy("part", "file_path", "group_id").agg(F.countDistinct("chunk_id").alias("n"), F.max("moved").alias("moved"))
        first = held.groupBy("part", "file_path").agg(F.min("group_id").alias("first"), F.count(F.lit(1)).alias("n_groups")).filter("n_groups > 1")
        now = Staged(spark)
        next_ = now(first.groupBy("part").agg(F.min(F.struct("first", "file_path"))["file_path"].alias("file_path")), "next")
        done = done.unionByName(kept(m.join(next_.select("part"), "part", "left_anti").drop("part", "moved"), "whole"))
        m = m.join(next_.select("part"), "part", "left_semi")
        own = now(held.join(next_, ["part", "file_path"]), "own")
        x, y = own.select("part", F.col("group_id").alias("a")), own.select("part", F.col("group_id").alias("b"))
        touched = m.join(own.select("group_id"), "group_id", "left_semi").select("group_id", "chunk_id").distinct()
        near = _similar_groups(x.join(y, "part").filter("a < b"), touched, units)
        best = near.groupBy("part").agg(F.min(F.struct((-F.col("s")).alias("s"), "a", "b")).alias("p")).filter(-F.col("p.s") >= merge)
        best = best.select("part", F.col("p.b").alias("gone"), F.col("p.a").alias("into"))
        to = own.groupBy("part").agg(F.min(F.struct((-F.col("n")).alias("n"), "group_id"))["group_id"].alias("to"))
        back = own.join(to, "part").filter("moved AND group_id <> to").groupBy("part", "to").agg(F.min("group_id").alias("g")).join(best, "part", "left_anti")
        best = now(best.unionByName(back.select("part", F.greatest("to", "g").alias("gone"), F.least("to", "g").alias("into"))), "best")
        moving = m.join(next_, ["part", "file_path"]).join(to.join(best, "part", "left_anti"), "part").select("group_id", "chunk_id", "to").distinct()
        after = m.join(best.drop("part"), m["group_id"] == best["gone"], "left").join(moving, ["group_id", "chunk_id"], "left")
        after = now(after.select("part", F.coalesce("to", "into", "group_id").alias("group_id"), "chunk_id", "file_path", (F.col("moved") | F.coalesce(F.col("to") != F.col("group_id"), F.lit(False))).alias("moved")).distinct(), "members")
        if turn:
            turn.drop()
        m, turn = after, now
    out = staged(done, "repaired")
    for s in (kept, turn):
        if s:
            s.drop()
    return out
