import itertools
import random

import numpy as np
import pyarrow as pa
import xxhash

from sparkloom.llm import simhash

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def print_of(text):
    w = (text or "").encode().translate(LOWER).split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least(prints):
    """Least id reachable from each fingerprint, by brute force over all pairs."""
    values = sorted(set(prints.values()))
    up = {v: v for v in values}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 2:
            up[find(a)] = find(b)
    first = {}
    for i, v in prints.items():
        first[find(v)] = min(first.get(find(v), i), i)
    return {i: first[find(v)] for i, v in prints.items()}


def components(spark, prints, parts=4):
    from sparkloom.llm.linking import components as joined

    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in prints.items()]
    rows = spark.createDataFrame(signed, "id long, print long").repartition(parts)
    part = {r.node: r.component for r in joined(simhash.links(rows.select("print").distinct())).collect()}
    first = {}
    for i, v in signed:
        c = part.get(v, v)
        first[c] = min(first.get(c, i), i)
    return {i: first[part.get(v, v)] for i, v in signed}


def test_the_code_covers_all_words():
    e, first, counts = simhash._patterns()
    assert (counts[0] == 1).all()  # each word has just one code word within the radius
    words = np.arange(1 << 23)
    nearest = words ^ e[first[simhash._remainder(words)]]
    assert (simhash._remainder(nearest) == 0).all()
    assert np.bitwise_count(words ^ nearest).max() == simhash.RADIUS
    assert len(np.unique(nearest >> 11)) == 1 << 12  # the upper bits tell code words apart


def test_neighbours_visit_the_home(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**63), 2**63 - 1, 3000)
    for i, j in [(0, 1), (3, 25), (22, 23), (45, 46), (50, 63), (7, 7)]:
        y = x ^ (np.int64(1) << np.int64(i)) ^ (np.int64(1) << np.int64(j))
        at, anchor = simhash.near_anchors(y)
        assert set(at[anchor == simhash.homes(x)[at]]) == set(range(3000))


def balls(seed=6):
    """Random prints, chains, and crowds of prints a few bits from a centre."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(300)] + [0, 1, 3, 1 << 63, (1 << 64) - 1]
    for size, flips in [(40, 1), (120, 2), (200, 3), (300, 5)]:
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = centre
            for _ in range(rng.randrange(flips + 1)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    x = out[7]
    for _ in range(60):  # a chain of steps of two bits
        x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        out.append(x)
    return dict(enumerate(out))


def test_links_match_all_pairs(spark):
    prints = balls()
    assert components(spark, prints) == least(prints)


def test_crowded_anchors_go_to_the_finest_code(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", 12)
    prints = balls(8)
    assert components(spark, prints) == least(prints)


def test_small_blocks_compare_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    x = np.array(list(balls(9).values()), np.uint64).view(np.int64)
    anchor = np.sort(rng.integers(0, 5, len(x)))
    home = rng.random(len(x)) < 0.6
    whole = simhash.compared(anchor, home, x)
    monkeypatch.setattr(simhash, "BLOCK", 100)
    assert [c.tolist() for c in simhash.compared(anchor, home, x)] == [c.tolist() for c in whole]


def test_fingerprints(documents, monkeypatch):
    texts = [r.text for r in documents.select("text").collect()] + [None, "", " \n", "One", "one TWO", "A b\tc", "a b c", "é É x ÿ", "x " * 50_000]
    monkeypatch.setattr(simhash, "CHUNK", 1000)
    got = np.concatenate(list(simhash.fingerprints(pa.array(texts)))).tolist()
    assert got == [print_of(t) for t in texts]


def test_documents(spark, documents, odd, none):
    texts = {r.doc_id: r.text for r in documents.collect()}
    prints = {i: print_of(t) for i, t in texts.items()}
    got = {r.doc_id: (r.print % 2**64, r.component_id) for r in simhash.joined(documents).collect()}
    want = least(prints)
    assert got == {i: (prints[i], want[i]) for i in texts}
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    found = sorted(((r.doc_id is None, r.doc_id, r.print % 2**64, r.component_id) for r in simhash.joined(odd).collect()), key=str)
    want = least({k: print_of(t) for k, t in {i: t for i, t in rows if i is not None}.items()})
    shared = {print_of(t): want[i] for i, t in rows if i is not None}
    assert found == sorted(((i is None, i, print_of(t), shared.get(print_of(t))) for i, t in rows), key=str)
    assert simhash.joined(none).collect() == []


def test_rows_without_ids_link_nothing(spark):
    a = print_of("a b c")
    docs = spark.createDataFrame([(1, "a b c"), (None, "a b c"), (None, "other words here")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.joined(docs).collect()}
    assert got == {(1, 1), (None, 1), (None, None)} and a
