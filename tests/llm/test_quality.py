import collections
import re

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import quality_classifier, quality_rules, text_stats


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = list(zip(w, w[1:], w[2:], strict=False))
    n = collections.Counter(three)
    covered = {i + k for i, t in enumerate(three) if n[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_stats_match_brute_force(documents, odd):
    for docs in (documents.select("doc_id", "text"), odd.select("doc_id", "text")):
        want = collections.Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
        got = collections.Counter(tuple(r) for r in text_stats.text_stats(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
        assert got == want


def test_votes_recover_the_classes():
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.8
    votes = np.where(good[:, None], np.where(rng.random((4000, 6)) < 0.03, 0, 1), np.where(rng.random((4000, 6)) < 0.5, 0, 1))
    votes[rng.random(votes.shape) < 0.2] = 2
    pattern, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = quality_rules.fit(pattern, counts.astype(float))[back.ravel()]
    assert ((post >= 0.5) == good).mean() > 0.93


def test_judged(spark, documents, odd, none, small):
    out = quality_rules.judged(documents)
    rows = {r.doc_id: r for r in out.collect()}
    labels = spark.read.parquet(f"{small}/labels.parquet").collect()
    asked = [(rows[x.doc_id].kept, x.quality) for x in labels if not rows[x.doc_id].base_failed]
    assert np.mean([k == (q == 1) for k, q in asked]) > 0.9
    assert all(not r.kept for r in rows.values() if r.base_failed)
    assert quality_rules.judged(odd).count() == odd.count() and quality_rules.judged(none).count() == 0
    assert quality_rules.kept(documents).columns == documents.columns
    assert quality_rules.kept(documents).count() == sum(r.kept for r in rows.values())


def test_isotonic_is_monotone():
    share = quality_classifier.isotonic(np.array([1.0, 0, 3, 2, 9]), np.array([4.0, 4, 4, 4, 9]))
    assert (np.diff(share) >= 0).all() and 0 < share[0] < share[-1] < 1


def test_features_approximate_the_gaussian_kernel():
    x = np.random.default_rng(0).normal(size=(50, 4))
    z = quality_classifier.Fourier(np.zeros(4), np.ones(4), 4000)(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 4 / 2))
    assert np.abs(z @ z.T - want).max() < 0.12


def test_classifier(spark, documents, odd, none):
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    s = quality_classifier.scored(base, labels, train).join(labels, "doc_id").withColumn("held", ~train)
    held = s.filter("held").select("score", "quality").collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in held)
    assert quality_classifier.scored(odd, labels, train).count() == odd.count()
    assert quality_classifier.scored(none, labels, train).count() == 0
    empty = labels.filter("false")
    assert {r.score for r in quality_classifier.scored(odd, empty, train).collect()} == {0.5}
