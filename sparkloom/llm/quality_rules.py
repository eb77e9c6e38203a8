"""Quality rules by weak supervision (operator 2).

Each rule votes good, bad or abstains on a document's statistics. The numbers
of documents with each pattern of votes (3 ** len(rules()) at most) are summed by
Spark, over the documents that pass the base rule (the others are rejected
whatever the votes, and would otherwise shape the class of bad documents); expectation-maximisation on these counts estimates the share of good
documents and how each rule votes on good and on bad ones, and the posterior
probability of "good" given a document's pattern decides, instead of asking
that every rule passes. The table of patterns is what is broadcast.

Cases: a null or empty text has no words, so it fails the base rule and is not
kept; repeated rows count as often as they occur; an empty table gives an empty
table; only doc_id and text are read. Votes that never occur keep their prior.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, staged
from .text_stats import text_stats

GOOD, BAD, ABSTAIN = 1, 0, 2
KEEP = 0.5


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """Each rule as a vote over the columns of text_stats."""
    mean_length = _share("word_chars", "n_words")
    return {
        "length": _vote(F.col("n_words") < 60, F.col("n_words") >= 100),
        "symbols": _vote(_share("n_symbols", "n_words") > 0.1, _share("n_symbols", "n_words") < 0.02),
        "symbol_words": _vote(_share("n_symbol_words", "n_words") > 0.1, _share("n_symbol_words", "n_words") < 0.03),
        "letters": _vote(_share("n_letters", "word_chars") < 0.86, _share("n_letters", "word_chars") > 0.92),
        "word_length": _vote((mean_length < 2.5) | (mean_length > 12), mean_length.between(3, 10)),
        "upper": _vote(_share("n_upper", "n_letters") > 0.3, _share("n_upper", "n_letters") < 0.12),
        "repeats": _vote(_share("n_repeat_words", "n_words") > 0.3, _share("n_repeat_words", "n_words") < 0.15),
        "lines": _vote(_share("n_dup_lines", "n_lines") > 0.3, _share("n_dup_lines", "n_lines") < 0.1),
        "runs": _vote(_share("n_run_words", "n_words") > 0.1, _share("n_run_words", "n_words") < 0.03),
        "exclaims": _vote(_share("n_exclaims", "n_words") > 0.2, _share("n_exclaims", "n_words") < 0.05),
    }


#: What a rule is taken to do before any votes are seen: shares of bad, good and no votes on bad and on good documents.
#: A bad document breaks some rules, not all; a good one hardly any.
PRIOR = ((0.35, 0.50, 0.15), (0.02, 0.80, 0.18))


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 100, share: float = 0.8, weight: float = 0.02) -> np.ndarray:
    """Posterior probability of good for each vote pattern (rows of votes, with so many documents each).

    A rule has its own distribution over bad / good / abstain for either class.
    PRIOR, worth `weight` times the documents and 10 at least, breaks the
    symmetry between the classes.
    """
    n = votes.shape[1]
    hot = np.eye(3)[votes]  # pattern, rule, vote
    prior = np.array(PRIOR)
    weight = max(10.0, weight * counts.sum())
    table = np.repeat(prior[:, None, :], n, axis=1)  # class, rule, vote
    p = share
    post = np.full(len(votes), share)
    for _ in range(rounds):
        scores = np.stack([np.log(1 - p) + np.einsum("prv,rv->p", hot, np.log(table[0])), np.log(p) + np.einsum("prv,rv->p", hot, np.log(table[1]))])
        post = 1 / (1 + np.exp(np.clip(scores[0] - scores[1], -500, 500)))
        mass = np.stack([counts * (1 - post), counts * post])
        table = np.einsum("cp,prv->crv", mass, hot) + weight * prior[:, None, :]
        table /= table.sum(axis=2, keepdims=True)
        p = (mass[1].sum() + weight * share) / (mass.sum() + weight)
    return post


def judged(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """The columns of text_stats, base_failed, probability (posterior of good) and kept, for each document."""
    names = list(rules())
    stats = text_stats(docs)
    pattern = sum((v * 3**i for i, v in enumerate(rules().values())), F.lit(0))
    stats = stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    stats = staged(stats.withColumn("pattern", pattern.cast("int")), "quality")
    seen = stats.filter(~F.col("base_failed")).groupBy("pattern").count().collect()  # 3 ** len(rules) rows at most
    spark = docs.sparkSession
    found = []
    if seen:
        codes = np.array([r["pattern"] for r in seen])
        votes = np.stack([codes // 3**i % 3 for i in range(len(names))], axis=1)
        found = list(zip(codes.tolist(), fit(votes, np.array([r["count"] for r in seen], float)).tolist(), strict=True))
    table = spark.createDataFrame(found, "pattern int, probability double")
    out = stats.join(F.broadcast(table), "pattern", "left").drop("pattern")
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("probability", F.lit(0.0)) >= keep))


def kept(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of docs, with their columns, whose own text is kept; rows may share a doc_id."""
    own, own_key, key = apart(docs.columns, "kept_id", "kept_own", "kept_key")
    verdict = judged(docs, keep).filter("kept").select(F.col("doc_id").alias(own), F.col("key").alias(own_key)).distinct()
    d = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    return d.join(verdict, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.col(key) == F.col(own_key)), "left_semi").select(*docs.columns)
