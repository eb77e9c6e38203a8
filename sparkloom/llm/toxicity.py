"""Toxicity (operator 1): a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel of two words sums, over the subsequences of 3 and 4 symbols that
span at most one symbol more, the products of their weights (GAP for one
skipped symbol), so that a word with a symbol inserted or left out keeps most
of its subsequences. Separators inside a word are dropped, look-alike digits
and signs are folded to letters, and runs of single letters ("x y z") also
count as one word.

Training. From a bounded sample of labelled documents (POSITIVES and NEGATIVES)
the sentences are taken, equal ones once, and carry their document's label. As
one insult makes a sentence toxic, a toxic sentence stands for its witnesses:
the words in it that toxic sentences hold more often, each weighted by a share that grows smoothly with the evidence. So what the kernel compares is words, not whole
sentences (README.md says why, with figures). Witnesses
against words of other sentences train a squared-hinge machine on Nystroem
features of LANDMARKS words. Its decision is linear in the subsequences, so it
is kept as one table of weights by subsequence, which scores any word without
the landmarks. A logistic curve, fitted on the sample's documents, turns the
highest word scores of a text into a probability.

Cases: a null text counts as empty; an empty text gets the score of a text
without toxic words; null labels are left out; without labels of both kinds
every score is 0; repeated rows each give a row; an empty table gives an empty
table; only doc_id and text of documents are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import Slice, slices, words
from .common import staged, texts

#: Bounds of the training sample: documents of either label.
POSITIVES, NEGATIVES = 3000, 5000
#: Most other words that are learnt from, and landmarks.
OTHERS, LANDMARKS = 20_000, 256
#: Likelihood ratio (as a chi-square value) at which a witness counts by half, how fast that falls and rises around it, and the share of its weight below which a word is none.
EVIDENCE, SLOPE, FAINT = 25.0, 2.0, 1e-3
GAP = 0.6
_SLICE = 3 << 20
_BITS3, _BITS4 = 18, 20
#: Offsets of the symbols of a subsequence, with the weight of its gap.
_SHAPES = [((0, 1, 2), 1.0), ((0, 1, 3), GAP), ((0, 2, 3), GAP), ((0, 1, 2, 3), 1.0), ((0, 1, 2, 4), GAP), ((0, 1, 3, 4), GAP), ((0, 2, 3, 4), GAP)]
_OPEN, _CLOSE, _PAD = 63, 62, 4


def _fold() -> np.ndarray:
    """Symbol of each byte: letters without case, look-alikes as letters, other bytes beyond ASCII in classes, 0 for what is dropped."""
    out = np.zeros(256, np.uint8)
    for i in range(26):
        out[65 + i] = out[97 + i] = 1 + i
    for c, letter in zip("013457@$", "oieastas", strict=True):
        out[ord(c)] = 1 + ord(letter) - 97
    for c in "2689":
        out[ord(c)] = 27 + int(c)
    for b in range(0x80, 0xC0):
        out[b] = 37 + (b & 0x3F) % 25
    return out


FOLD = _fold()


class Words:
    """Many words as one row of symbols, with zeros between, and their kernel's subsequences."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray):
        """data: bytes; word i is data[start[i]:start[i] + length[i]]."""
        n = len(start)
        at = np.repeat(start - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(int(length.sum())) if n else np.zeros(0, np.int64)
        code, of = FOLD[data[at]], np.repeat(np.arange(n), length)
        code, of = code[code > 0], of[code > 0]
        self.size = np.bincount(of, minlength=n)
        self.first = np.r_[0, np.cumsum(self.size + 2 + _PAD)]
        self.row = np.zeros(int(self.first[-1]) + _PAD, np.uint32)
        self.row[self.first[:-1]] = _OPEN
        self.row[self.first[:-1] + self.size + 1] = _CLOSE
        self.row[np.arange(len(code)) + of * (2 + _PAD) + 1] = code

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """For each shape: the subsequence at each place, whether it is one, the weight of its gap."""
        n = len(self.row) - _PAD
        for shape, weight in _SHAPES:
            s = [self.row[o : o + n] for o in shape]
            key = (s[0] << np.uint32(12)) | (s[1] << np.uint32(6)) | s[2]
            if len(s) == 4:
                key = ((((key << np.uint32(6)) | s[3]) * np.uint32(2654435761)) >> np.uint32(32 - _BITS4)) + np.uint32(1 << _BITS3)
            yield key, (s[-1] > 0) & (s[0] > 0), weight

    def norm(self) -> np.ndarray:
        """Length of each word in the kernel's space, as if all its subsequences differed."""
        n = self.size + 2
        return np.sqrt(np.maximum(1.0, sum(w * w * np.maximum(0, n - o[-1]) for o, w in _SHAPES)))

    def dot(self, table: np.ndarray) -> np.ndarray:
        """Each word's sum of the table's weights over its subsequences, over its norm."""
        total = np.zeros(len(self.row) - _PAD)
        for key, there, weight in self.features():
            total += weight * table[key] * there
        return np.add.reduceat(total, self.first[:-1]) / self.norm() if len(self.first) > 1 else np.zeros(0)

    def table(self, share: np.ndarray) -> np.ndarray:
        """The sum of the words' own points in the kernel's space, each times its share."""
        out = np.zeros((1 << _BITS3) + (1 << _BITS4))
        by = np.repeat(share / self.norm(), np.diff(self.first))
        for key, there, weight in self.features():
            np.add.at(out, key[there], weight * by[there])
        return out


def of_strings(strings: list[str]) -> Words:
    data = [s.encode() for s in strings]
    length = np.array(list(map(len, data)), np.int64)
    return Words(np.frombuffer(b"".join(data) or b" ", np.uint8), np.r_[0, np.cumsum(length)[:-1]].astype(np.int64) if data else np.zeros(0, np.int64), length)


def machine(positive: list[str], weight: np.ndarray, negative: list[str], landmarks: int = LANDMARKS, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """Weights by subsequence and bias of the machine: positive words count `weight` times, either class the same in all."""
    half = landmarks // 2
    marks = positive[:half] + negative[: landmarks - min(half, len(positive))]
    both, z = of_strings(positive + negative), of_strings(marks)
    one = np.eye(len(marks))
    kernel = np.stack([both.dot(z.table(one[j])) for j in range(len(marks))], axis=1)
    inner = np.stack([z.dot(z.table(one[j])) for j in range(len(marks))], axis=1)
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    x = np.c_[kernel @ root, np.ones(len(kernel))]
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    c = np.r_[weight / weight.sum(), np.full(len(negative), 1 / max(1, len(negative)))] * cost * 100
    w = np.zeros(x.shape[1])
    shrink = np.r_[np.ones(x.shape[1] - 1), 1e-6]
    for _ in range(25):  # Newton steps on the rows inside the margin
        near = y * (x @ w) < 1
        a = x[near] * c[near, None]
        new = np.linalg.solve(np.diag(shrink) + a.T @ x[near], a.T @ y[near])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return z.table(root @ w[:-1]), float(w[-1])


def document_features(part: Slice, table: np.ndarray, bias: float) -> np.ndarray:
    """For each row of a slice: its two highest scores of different words, log of the number of words above the margin, log of the number of words."""
    out = np.zeros((part.rows, 4))
    out[:, :2] = -2.0
    w = words(part)
    n = np.diff(w.first)
    out[:, 3] = np.log1p(n)
    if len(w.start) == 0:
        return out
    row = np.repeat(np.arange(part.rows), n)
    code, unique = pd.factorize(w.hash)
    at = np.zeros(len(unique), np.int64)
    at[code] = np.arange(len(code))
    score = (Words(part.data, w.start[at], w.end[at] - w.start[at]).dot(table) + bias)[code]
    single = (w.end - w.start == 1) | ((w.end - w.start == 2) & (part.data[w.start] >= 0xC0))
    opens = np.flatnonzero(single & np.r_[True, ~single[:-1] | (row[1:] != row[:-1])])  # runs of letters that stand alone, inside a row
    ends = np.flatnonzero(single & np.r_[~single[1:] | (row[1:] != row[:-1]), True]) + 1
    a, b = opens[ends - opens >= 3], ends[ends - opens >= 3]
    if len(a):
        start = w.start[a]
        score[a] = np.maximum(score[a], Words(part.data, start, w.end[b - 1] - start).dot(table) + bias)
    full = n > 0
    top = np.maximum.reduceat(score, w.first[:-1][full])
    out[full, 0] = top
    lower = np.where(score >= out[row, 0], -2.0, score)
    out[full, 1] = np.maximum.reduceat(lower, w.first[:-1][full])
    out[:, 2] = np.log1p(np.bincount(row, score > 0, minlength=part.rows))
    return np.clip(out, -2.0, None)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of a ridge-penalised logistic curve, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 1e-2 * w
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-2 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _with_features(rows: DataFrame, table, bias: float, keep: str) -> DataFrame:
    """keep (a long column) and the features of the texts, as x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [document_features(p, table.value, bias) for p in slices(b["text"], _SLICE)]
            if found:
                x = np.concatenate(found)
                yield pa.record_batch([b[keep], *(pa.array(x[:, i]) for i in range(4))], [keep, "x0", "x1", "x2", "x3"])

    return rows.select(keep, "text").mapInArrow(run, f"{keep} long, x0 double, x1 double, x2 double, x3 double")


def sample(docs: DataFrame, labels: DataFrame, train: Column) -> tuple[DataFrame, dict[int, float]]:
    """text and toxic of the training sample, and how many labelled documents each of its documents stands for, by label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("toxic")).filter(F.col("toxic").isin(0, 1) & train).distinct()
    seen = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    bounds = {1: POSITIVES, 0: NEGATIVES}
    picks = [known.filter(F.col("toxic") == k).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(n) for k, n in bounds.items()]
    picked = F.broadcast(picks[0].unionByName(picks[1]))  # POSITIVES + NEGATIVES rows at most
    return texts(docs).join(picked, "doc_id").select("text", "toxic"), {k: max(1.0, seen.get(k, 0) / n) for k, n in bounds.items()}


def witnesses(chosen: DataFrame) -> tuple[list[tuple[str, float]], list[str]]:
    """Witness words with their weight, the number of toxic sentences that hold them times a share that grows with the evidence, and other words of sentences that aren't toxic. The sample bounds the witnesses."""
    sentences = chosen.select("toxic", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[.!?\n|]+")).alias("sentence"))
    sentences = sentences.select("toxic", F.array_distinct(F.split("sentence", r"[ \t\x0b\f\r]+")).alias("parts"), "sentence").dropDuplicates(["toxic", "sentence"])
    word = F.regexp_replace("word", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    counted = sentences.select("toxic", F.explode("parts").alias("word")).select("toxic", word.alias("word")).filter(F.length("word") > 1)
    counted = staged(counted.groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")), "words")
    total = counted.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    share = (total["pos"] or 0) / max(1, (total["pos"] or 0) + (total["neg"] or 0))
    if not 0 < share < 1:
        return [], []
    p, q = F.col("pos") + 0.5, F.col("neg") + 0.5
    evidence = 2 * (p * F.log(p / ((p + q) * share)) + q * F.log(q / ((p + q) * (1 - share))))
    more = F.col("pos") * (1 - share) > 2 * F.col("neg") * share
    counted = counted.withColumn("evidence", F.when(more, evidence).otherwise(0.0))
    share_of = 1 / (1 + F.exp((EVIDENCE - F.col("evidence")) / SLOPE))
    found = counted.withColumn("share", share_of).filter((F.col("share") >= FAINT) & (F.col("evidence") > 0)).orderBy(F.desc("evidence"), "word").collect()  # words of POSITIVES documents at most
    rest = counted.filter((F.col("evidence") < EVIDENCE / 5) & (F.col("neg") > 0))
    common = rest.orderBy(F.desc("neg"), "word").limit(OTHERS // 10).collect()
    others = rest.orderBy(F.md5("word"), "word").limit(OTHERS).collect()
    return [(r["word"], float(r["pos"]) * r["share"]) for r in found], list(dict.fromkeys(r["word"] for r in [*common, *others]))


def train_machine(found: list[tuple[str, float]], others: list[str]) -> tuple[np.ndarray, float]:
    """Train on the first others, then again with those of the rest that score highest."""
    positive, weight = [w for w, _ in found], np.sqrt([n for _, n in found])
    first = others[: OTHERS // 5]
    table, bias = machine(positive, weight, first)
    rest = others[OTHERS // 5 :]
    if rest:
        hard = np.argsort(-of_strings(rest).dot(table), kind="stable")[:2000]
        table, bias = machine(positive, weight, first + [rest[i] for i in hard])
    return table, bias


def scored(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """doc_id and score (probability that the text is toxic) of every document.

    labels: doc_id, toxic (0 or 1); train: a condition over doc_id that says whose labels may be learnt from.
    """
    spark = docs.sparkSession
    chosen, each = sample(docs, labels, train)
    chosen = staged(chosen, "sample")  # POSITIVES + NEGATIVES rows at most, read several times below
    found, others = witnesses(chosen)
    if not found or not others:
        return texts(docs).select("doc_id", F.lit(0.0).alias("score"))
    table, bias = train_machine(found, others)
    shared = spark.sparkContext.broadcast(table.astype(np.float32))  # a table of fixed size
    known = np.array(_with_features(chosen, shared, bias, "toxic").collect())  # POSITIVES + NEGATIVES rows at most
    curve = logistic(known[:, 1:], known[:, 0], np.where(known[:, 0] == 1, each[1], each[0]))
    z = sum((F.col(f"x{i}") * float(curve[i]) for i in range(4)), F.lit(float(curve[4])))
    return _with_features(texts(docs), shared, bias, "doc_id").select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))
