"""Token vectors against a loop over the texts."""

import collections
import hashlib
import re

from sparkloom.operators import token_table as T


def learnt(texts, d, window):
    n, v = collections.Counter(), collections.defaultdict(lambda: [0] * d)
    for text in texts:
        ts = re.findall(r"\w+", (text or "").lower(), re.ASCII)
        n.update(ts)
        for i, t in enumerate(ts):
            for j in range(max(0, i - window), min(len(ts), i + window + 1)):
                if i != j:
                    h = int(hashlib.md5(ts[j].encode()).hexdigest()[:8], 16)
                    v[t] = [x + (1 if h >> k & 1 else -1) for k, x in enumerate(v[t])]
    total = sum(n.values())
    out = {}
    for t in n:
        size = max(1, sum(map(abs, v[t])))
        out[t] = n[t], 1000 * total // (total + 999 * n[t]), [(abs(x) * 1000 // size) * (1 if x > 0 else -1) for x in v[t]]
    return out


def embedded(text, table, d):
    out = [0] * d
    for t in re.findall(r"\w+", (text or "").lower(), re.ASCII):
        if t in table:
            _, w, v = table[t]
            out = [a + w * b for a, b in zip(out, v)]
    return out


def test_against_a_loop(spark):
    texts = ["the cat sat on the mat", "The dog sat; the dog ran", None, "", "alone", "a a a a", "x " * 3000 + "y", "!!", "the cat sat on the mat"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").selectExpr("*", "1 AS token", "2 AS n", "3 AS salt", "4 AS h")
    for d, window in ((8, 2), (32, 1), (5, 4)):
        table = T.token_table(rows, dimension=d, window=window)
        want = learnt(texts, d, window)
        assert {r.token: (r.n, r.weight, list(r.vector)) for r in table.collect()} == want
        got = {r.id: r for r in T.table_vectors(rows, table, dimension=d, salts=3).collect()}
        assert {i: list(r.sums) for i, r in got.items()} == {i: embedded(x, want, d) for i, x in enumerate(texts)}
        assert got[2].n_tokens == 0 and not any(got[2].vector) and abs(sum(x * x for x in got[0].vector) - 1) < 1e-9


def test_unknown_tokens_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "new words"), (None, "old old"), (None, "old")], "id int, text string")
    table = T.token_table(rows.filter("id IS NULL"), dimension=4)
    got = {r.id: (r.n_tokens, any(r.sums)) for r in T.table_vectors(rows, table, dimension=4).collect()}
    assert got == {1: (2, False), None: (3, True)}
    none = rows.limit(0)
    assert T.token_table(none).count() == 0 and T.table_vectors(none, table, dimension=4).count() == 0
    assert T.table_vectors(rows, T.token_table(none)).count() == 2


def test_tokens_of_like_contexts_are_near(spark):
    """Cats and dogs stand in the same places, so their vectors are nearer to each other than to other words."""
    frames = ["the {} sleeps on its bed", "a {} eats from the bowl", "my {} runs through grass", "that {} was hungry today"]
    texts = [f.format(x) for f in frames for x in ("cat", "dog")] + ["stocks fell sharply after trading", "markets and stocks rose again slowly"] * 4
    table = {r.token: r.vector for r in T.token_table(spark.createDataFrame([(x,) for x in texts], "text string")).collect()}

    def cosine(a, b):
        x, y = table[a], table[b]
        return sum(p * q for p, q in zip(x, y)) / (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5

    assert cosine("cat", "dog") > 0.99 > 0.7 > cosine("cat", "stocks")


def test_slices_of_texts(spark, monkeypatch):
    """Sums are taken over slices of lists, also of a cut array, and a list longer than a slice is one; only the sums of each slice are shuffled."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(T, "TOKENS", 4)
    texts = ["a b a", "c", "", "b a b a b a b", "a c", "d", "c c c c"]
    lists = pa.array([["q"], *[re.findall(r"\w+", x) for x in texts]]).slice(1)
    parts = list(T._slices(lists))
    assert [len(p) for p in parts] == [3, 1, 2, 1] and pa.concat_arrays(parts).to_pylist() == lists.to_pylist()
    own = sorted((tuple(r.values()) for p in parts for r in T._summed(p, 5, 3).to_pylist()), key=lambda r: r[0])
    left, got = None, {}
    for first in range(0, len(own), 2):
        cut = own[first : first + 2]
        *done, left = T._totals(T._rows(pa.array([r[0] for r in cut]), np.array([r[1] for r in cut]), np.array([r[2] for r in cut])), left, 5)
        got |= {r["token"]: (r["n"], r["vector"]) for x in map(T._scaled, done) for r in x.to_pylist()}
    got |= {r["token"]: (r["n"], r["vector"]) for r in T._scaled(left).to_pylist()}
    assert got == {t: (n, v) for t, (n, _, v) in learnt(texts, 5, 3).items()}
    rows = spark.createDataFrame([("a b c",)] * 50, "text string")
    assert {r.token: r.n for r in T.token_table(rows).collect()} == {"a": 50, "b": 50, "c": 50}


def test_words_of_texts(monkeypatch):
    """Tokens are those of the pattern, by text, also where texts touch, of cut arrays and by runs of few bytes."""
    import pyarrow as pa

    texts = ["skipped", "", "ab", "cd e", "", "Été_1 x-y", "ß", "a", "b", "  ", "x" * 50, "\u212a k", "", "end"]
    want = [re.findall(r"\w+", x, re.ASCII) for x in texts[1:]]
    for kind in (pa.string(), pa.large_string()):
        for size in (1, 3, 7, 10**6):
            monkeypatch.setattr(T, "BYTES", size)
            assert [x for part in T._words(pa.array(texts, kind).slice(1)) for x in part.to_pylist()] == want
    assert [len(x.values) for x in T._words(pa.array(["", "!"]))] == [0] and not list(T._words(pa.array([], pa.string())))


def test_sums_in_lanes():
    """Neighbours of tokens that occur more often than a lane counts, in windows for which lanes are wider."""
    import pyarrow as pa

    texts = [["a"] * 700 + ["b", "c"] * 40, ["c"], ["b", "a", "b"] * 100]
    for d, window in ((1, 1), (32, 2), (9, 7), (8, 40), (3, 5000)):
        want = {t: [x, n] for t, (n, _, x) in learnt([" ".join(x) for x in texts], d, window).items()}
        out = T._summed(pa.array(texts), d, window)
        assert {r["token"]: r["n"] for r in out.to_pylist()} == {t: n for t, (_, n) in want.items()}
        assert {r["token"]: r["vector"] for r in T._scaled(out).to_pylist()} == {t: x for t, (x, _) in want.items()}


def test_sums_as_bytes():
    import numpy as np
    import pyarrow as pa

    v = np.array([[1, -128, 5], [127, -127, 0], [2**31 - 1, -(2**31) + 1, 0], [0, 0, 0], [128, 1, 1]], np.int32)
    rows = T._rows(pa.array(list("abcde")), np.arange(5), v)
    packed = T._packed(rows)
    assert [len(x) for x in packed.column(2).to_pylist()] == [12, 3, 12, 3, 12]
    assert T._unpacked(packed, 3).to_pylist() == rows.to_pylist() and T._unpacked(packed.slice(1, 3), 3).to_pylist() == rows.slice(1, 3).to_pylist()
    assert T._unpacked(packed.slice(0, 0), 3).num_rows == 0


def test_only_rows_of_used_tokens_are_dealt(spark):
    """Of a table of 2000 tokens one is used, by two texts: no part of the plan makes a row for each token and salt."""
    table = T.token_table(spark.range(1000).selectExpr("concat('a', id, ' b', id) AS text"))
    out = T.table_vectors(spark.createDataFrame([(1, "a7"), (2, "a7 new")], "id int, text string"), table, salts=64)
    assert "sequence" not in out._jdf.queryExecution().optimizedPlan().toString()
    one = {r.token: r for r in table.collect()}["a7"]
    assert {r.id: (r.n_tokens, list(r.sums)) for r in out.collect()} == {i: (i, [one.weight * x for x in one.vector]) for i in (1, 2)}


def test_sums_go_on_from_slice_to_slice(spark, monkeypatch):
    """A task gives on a frequent token's sums once, not with each slice of texts, and nothing is lost where it holds few."""
    import pyarrow as pa

    texts = [f"x{i} the cat y{i} the dog" for i in range(40)]
    sums = [T._summed(pa.array([x.split()]), 4, 2) for x in texts]
    want = {t: (n, x) for t, (n, _, x) in learnt(texts, 4, 2).items()}
    monkeypatch.setattr(T, "HELD", 12)
    held, given = [], []
    for x in sums:
        held.append(x)
        if sum(y.num_rows for y in held) > T.HELD:
            rare, often = T._parted(T._merged(held, 4), 2)
            assert often.num_rows <= 3
            given, held = [*given, rare], [often]
    given += held
    assert sum(x.num_rows for x in given) < sum(x.num_rows for x in sums) * 0.6
    merged = T._merged(given, 4)
    assert {r["token"]: (r["n"], r["vector"]) for r in T._scaled(merged).to_pylist()} == want
    big = T._rows(pa.array(["a", "b", "c", "d"]), T.np.array([2**40, 9, 8, 1]), T.np.zeros((4, 4), T.np.int32))
    rare, often = T._parted(big, 2)
    assert "a" in rare.column(0).to_pylist() and often.column(0).to_pylist() == ["b"]
