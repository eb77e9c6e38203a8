import collections
import math
import random
import re

import numpy as np
import pytest
from sparkloom.llm import lexical_search as search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def ranked(docs, items, k=10):
    """Every document scored for every item, in Python integers."""
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out, wanted = [], collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    for item, own in wanted.items():
        scores = []
        for doc, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def test_documents_match_brute_force(spark, documents, small):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    counts = {}
    got = rows(search.searched(documents, items, counts=counts))
    assert got == ranked([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert 0 < counts["opened"]


@pytest.mark.parametrize("segment, terms_", [(2000, 40), (1 << 20, 1 << 17)])
def test_many_segments_and_blocks(spark, monkeypatch, segment, terms_):
    """Few words make many equal scores; segments and blocks of items are small in one case."""
    rng = random.Random(5)
    vocabulary = ["a", "B", "cé", "D1", "日本", "ff", "g", "h", "rare"]
    docs = [(rng.randrange(10_000), " ".join(rng.choices(vocabulary, weights=[9, 8, 7, 6, 5, 4, 3, 2, 0.05], k=rng.randrange(12)))) for _ in range(900)]
    items = [(i, " ".join(rng.sample(vocabulary, 1 + i % 5))) for i in range(12)]
    monkeypatch.setattr(search, "SEGMENT", segment)
    monkeypatch.setattr(search, "TERMS", terms_)
    got = rows(search.searched(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 7))
    assert got == ranked(docs, items, 7)


def test_odd_rows(spark, odd, none):
    items = [(1, "word a"), (1, "B e"), (None, "me"), (2, None), (3, ""), (4, "absent"), (5, "é 日本 nul"), (5, "é 日本 nul")]
    table = spark.createDataFrame([(*i, 3, 4) for i in items], "item_id long, text string, item long, term long")
    assert rows(search.searched(odd, table)) == ranked([(r.doc_id, r.text) for r in odd.collect()], items)
    assert rows(search.searched(none, table)) == [] == rows(search.searched(odd, table.filter("false")))


def test_ranges_below_the_best_stay_closed():
    """Best first: only ranges whose sum of maxima reaches the k-th best score are opened, equal ones too."""
    n = 4096
    times = np.ones(n, np.int64)
    times[[70, 71, 3000]] = [50, 50, 40]
    p = search.Postings(np.arange(n)[::-1], np.ones(n, bool), np.full(n, 60), np.zeros(n, np.int64), np.arange(n), times)
    tree = search.Tree(p, times, 1)
    best = []
    assert tree.search(np.zeros(1, np.int64), best, 2) <= 10
    assert sorted((s, -d) for s, _, d in best) == [(50, n - 72), (50, n - 71)]
    best = []
    assert tree.search(np.zeros(1, np.int64), best, 4) > n // search.FAN  # all others tie for the fourth place, so the least id needs them
    assert min(best)[0] == 1 and -min(best)[2] == 0
