"""Repeated passages that lines do not show, against brute force over runs of 51 words."""

import collections
import re

import numpy as np

from sparkloom.llm import substring_dedup

RUN = 51


def runs(rows):
    """(doc_id, start, end) of each run of 51 words that stands twice, apart."""
    at = collections.defaultdict(list)
    for i, text in rows:
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        for j in range(len(words) - RUN + 1):
            at[" ".join(w for *_, w in words[j : j + RUN])].append((i, words[j][0], words[j + RUN - 1][1]))
    return [p for places in at.values() if len(places) > 1 for p in places if any(q[0] != p[0] or q[1] >= p[2] or q[2] <= p[1] for q in places)]


def made():
    rng = np.random.default_rng(3)
    def text(n):
        return [f"w{x}" for x in rng.integers(0, 5000, n)]

    shared, twice = text(RUN), text(60)
    lines = [" ".join(shared[i : i + 9]) for i in range(0, RUN, 9)]
    return [
        (1, " ".join(text(150) + shared + text(150))),  # inside a longer line
        (2, "\n".join([" ".join(text(8)), *lines, " ".join(text(7))])),  # wrapped short
        (3, " ".join(text(70) + twice + text(40) + twice)),  # twice in one text
        (4, " ".join(text(900))),  # nothing
        (5, None),
    ]


def test_every_repeated_run_holds_a_block(spark, documents):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert substring_dedup.repeated(docs, block=None).count() == 0  # lines alone see none of it
    for d, least in ((docs, 3), (documents.select("doc_id", "text"), 0)):
        found = collections.defaultdict(list)
        for r in substring_dedup.spans(d).collect():
            assert r.n_copies > 1
            found[r.doc_id].append((r.start, r.end))
        blocks = collections.defaultdict(list)
        for r in substring_dedup.repeated(d).collect():
            blocks[r.doc_id].append((r.start, r.end))
        want = runs(d.collect())
        assert len({i for i, *_ in want}) >= least
        assert all(any(s <= a and b <= e for a, b in blocks[i]) for i, s, e in want)
        assert all(any(a <= x and y <= b for a, b in found[i]) for i in blocks for x, y in blocks[i])
        covered = sum(any(a < e and s < b for a, b in found[i]) for i, s, e in want)
        assert covered == len(want)
        if least:
            assert set(found) == {1, 2, 3}


def test_passages_are_cut_once(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in substring_dedup.deduplicated(docs, block=substring_dedup.BLOCK).collect()}
    cut = collections.defaultdict(set)
    for r in substring_dedup.repeated(docs, block=substring_dedup.BLOCK).filter("removed").collect():
        cut[r.doc_id] |= set(range(r.start, r.end))
    for i, text in rows:
        assert clean[i] == (text and "".join(c for j, c in enumerate(text) if j not in cut[i]))
    assert clean[1] == rows[0][1] and len(clean[2]) < len(rows[1][1]) and len(clean[3]) < len(rows[2][1])


def test_same_words_over_and_over(spark):
    docs = spark.createDataFrame([(1, "word " * 400), (2, "one two three " * 9)], "doc_id long, text string")
    got = substring_dedup.repeated(docs, block=substring_dedup.BLOCK).collect()
    assert {r.doc_id for r in got} == {1} and any(r.removed for r in got) and any(not r.removed for r in got)
