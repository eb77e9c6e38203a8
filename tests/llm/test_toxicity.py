import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.llm import toxicity as T
from sparkloom.llm.arrow_text import slices


def brute_kernel(a, b):
    """Sum over all pairs of subsequences of the seven shapes, by their symbols."""

    def parts(word):
        s = "^" + "".join(c for c in word.lower() if c.isalnum()) + "$"
        out = {}
        for shape, w in T._SHAPES:
            for i in range(len(s) - shape[-1]):
                k = "".join(s[i + o] for o in shape)
                out[k] = out.get(k, 0) + w
        return out

    x, y = parts(a), parts(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


def test_kernel_matches_brute_force():
    words = ["idiot", "idxiot", "id-iot", "banana", "ananas", "x"]
    w = T.of_strings(words)
    for j, z in enumerate(words):
        one = np.zeros(len(words))
        one[j] = 1
        got = w.dot(w.table(one)) * w.norm() * w.norm()[j]
        assert np.allclose(got, [brute_kernel(x, z) for x in words]), z


def test_gaps_and_insertions_keep_most_of_the_kernel():
    w = T.of_strings(["worthless", "worth-less", "w0rthless", "worxthless", "wothless", "earthworm"])
    one = np.zeros(6)
    one[0] = 1
    k = w.dot(w.table(one))
    assert k[1] == k[0] and k[2] == k[0] and min(k[3], k[4]) > 0.5 * k[0] > k[5]


def test_spread_letters_count_as_a_word():
    table, bias = T.machine(["idiot", "moron"], np.ones(2), ["table", "chair", "the", "and", "river", "stone"])
    x = np.concatenate([T.document_features(p, table, bias) for p in slices(pa.array(["you i d i o t there", "you idiot", "i am a b c", "", "the river"]))])
    assert x[0, 0] > 0 and x[1, 0] > 0 and x[4, 0] < 0 and x[3, 0] == -2
    texts = ["the i d", "i o t the", "i d i o t", "a i", "d i o t"]  # no run goes over the end of a text
    apart = np.concatenate([T.document_features(p, table, bias) for p in slices(pa.array(texts))])
    for t, row in zip(texts, apart, strict=True):
        assert np.allclose(row, np.concatenate([T.document_features(p, table, bias) for p in slices(pa.array([t]))])[0])


def test_scores(spark, odd, none):
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    s = T.scored(docs, labels, train).join(labels, "doc_id").filter(~train).select("score", "toxic").collect()
    hit = [r.score >= 0.7 for r in s if r.toxic == 1]
    wrong = [r.score >= 0.7 for r in s if r.toxic == 0]
    assert np.mean(hit) > 0.85 and np.mean(wrong) < 0.01
    extra = T.scored(odd, labels, train)
    assert extra.count() == odd.count() and all(0 <= r.score <= 1 for r in extra.collect())
    assert T.scored(none, labels, train).count() == 0
    assert {r.score for r in T.scored(odd, labels.filter("false"), train).collect()} == {0.0}


def test_few_labels_and_repeated_ones(spark):
    """Scores rise with the number of labels and don't jump from 0; labels that repeat count once."""
    rng = np.random.default_rng(5)
    calm = [f"{a}{b}" for a in ("ri", "sto", "ta", "mo", "le") for b in ("ver", "ne", "ble", "lan", "tus")]
    rows = [(i, " ".join(rng.choice(calm, 9)) + (" you worthless blorg" if i % 2 else " you")) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gap = []
    for n in (8, 26, 40):
        labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")
        found = {r.doc_id: r.score for r in T.scored(docs, labels, F.lit(True)).collect()}
        if n == 26:
            twice = {r.doc_id: r.score for r in T.scored(docs, labels.unionByName(labels), F.lit(True)).collect()}
            assert all(abs(found[i] - twice[i]) < 1e-9 for i in found)
        gap.append(np.mean([found[i] for i in range(41, 80, 2)]) - np.mean([found[i] for i in range(40, 80, 2)]))
    assert 0 <= gap[0] <= gap[1] + 0.05 and gap[2] > 0.8 and gap[1] > 0.05
