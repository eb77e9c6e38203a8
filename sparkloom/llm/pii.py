"""Personal data (operator 9), with DataFrame and SQL functions only.

Base spans of four kinds come from patterns and checks. The method adds spans:
per kind, a high-recall generator proposes further candidates (spelt-out
addresses, digit groups with other separators, phone numbers without a plus, and,
as a fifth kind, secrets: long runs of letters with digits),
which may overlap spans of other kinds. What says that a candidate is personal
data is kept apart from what is learnt from: evidence is a word before it that
names its kind ("token", "card"), or that its digits pass the check of the kind; the
features are its format (length, groups, separators), the characters around it, and how
many documents hold the same string, and neither the check nor the naming word is
among them. Spark counts candidates and evidence by cell of binned features, apart for
FOLDS parts of the texts (by a hash). Boosted trees of depth two are
fitted on these counts (CELLS rows at most, whatever the input) and compiled to a
SQL expression; per kind the lowest threshold is taken at which PRECISION
of the candidates above it, each scored by trees fitted on the other parts, have evidence. So a format that nearly always comes with
evidence is redacted where it stands without. Candidates above the threshold that overlap no
base span of their kind become spans.

Positions are running sums, per text, of the lengths between and of the
matches; they count code points.

Cases: a null text counts as empty and has no spans; rows with the same doc_id
and text give equal rows; an empty table gives an empty table, and then no
trees; kinds without candidates, or without held-out ones, keep their base spans; `redacted` keeps the
columns of its input, whatever their names; `found` reads doc_id and text only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, staged, texts

#: Kinds of base spans; spans of the last kind are only added.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: Base patterns. Look-behinds and possessive loops only spare steps: the matches are those of the plain patterns in README.md.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates.
WIDE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9A-Za-z.])|\G)[0-9]++(?:(?:\.|\[\.\])[0-9]++){3}",
    "card": r"(?:(?<![0-9A-Za-z])|\G)[0-9]{3,6}(?:[\x20._/-]{0,2}[0-9]{3,6}){2,5}(?![0-9A-Za-z])",
    "phone": r"(?:(?<![0-9A-Za-z+])|\G)(?:\+|00)?(?:[0-9]{1,3}[\x20.-]{1,2})?\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20.-]{1,2}[0-9]{3,5}(?![\x20.-]?[0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+={0,2}",
}
#: Words that name a kind when they stand just before a candidate.
NAMES = {"email": "mail|contact|write", "ip": "ip|host|server|addr|address", "card": "card|visa|credit|pay", "phone": "tel|phone|call|fax|mobile", "secret": "token|key|secret|password|passwd|pwd|auth|bearer"}
ROUNDS, RATE, PRECISION = 40, 0.3, 0.95
#: Numbers of bins of the features, which bound the cells; parts of the texts, each of which is held out once.
BINS = {"size": 6, "groups": 4, "marks": 4, "before": 4, "after": 4, "copies": 4}
FOLDS = 2
#: Standard errors by which the precision above a threshold is held to be lower than it was seen.
ERRORS = 0.7
CELLS = FOLDS * len(ALL_KINDS) * int(np.prod(list(BINS.values())))
_MARK = "\u0001"
_NEAR = 24


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    at = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    value = F.aggregate(at, F.lit(0), lambda s, i: s + _luhn_digit(digits, i))
    return (F.length(digits) > 0) & (value % 10 == 0)


def _luhn_digit(digits: Column, i: Column) -> Column:
    d = F.substring(digits, -i, F.lit(1)).cast("int")
    double = 2 * d
    return F.when(i % 2 == 1, d).when(double > 9, double - 9).otherwise(double)


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: Column, text: Column) -> Column:
    """The check of each kind, on a match."""
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    digits = only_digits(text)
    return (
        F.when(kind == "ip", text.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(10, 15))
        .otherwise(True)
    )


def _matches(docs: DataFrame) -> DataFrame:
    """One row for each match of each pattern: doc_id, key, kind, wide, text, start, end, before and after (up to _NEAR characters)."""
    d = texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.filter(F.col("text").rlike(r"[0-9@]|[(\[]at[)\]]")).withColumn("key", F.xxhash64("doc_id", "text"))
    d = d.withColumn("text", F.translate("text", _MARK, "\u0002"))  # neither stands in a match
    patterns = [(kind, wide, p) for wide, table in ((False, BASE), (True, WIDE)) for kind, p in table.items()]
    digit = F.col("text").rlike("[0-9]")
    gate = {"email": F.col("text").rlike(r"@|[(\[]at[)\]]"), "secret": F.col("text").rlike("[A-Za-z0-9_+/-]{16}") & digit}
    # gaps and matches by turns
    cut = d.select("doc_id", "key", *[F.when(gate.get(k, digit), F.split(F.regexp_replace("text", p, f"{_MARK}$0{_MARK}"), _MARK, -1)).alias(f"p{i}") for i, (k, _, p) in enumerate(patterns)])

    def rows(i: int, kind: str, wide: bool) -> Column:
        parts = F.coalesce(F.col(f"p{i}"), F.array().cast("array<string>"))
        return F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), lambda j: j < F.size(parts)),
            lambda j: F.struct(F.lit(kind).alias("kind"), F.lit(wide).alias("wide"), j.alias("nth"), F.get(parts, j).alias("text"), F.length(F.get(parts, j - 1)).alias("gap"), F.right(F.get(parts, j - 1), F.lit(_NEAR)).alias("before"), F.left(F.get(parts, j + 1), F.lit(_NEAR)).alias("after")),
        )

    found = cut.select("doc_id", "key", F.explode(F.concat(*[rows(i, k, w) for i, (k, w, _) in enumerate(patterns)])).alias("m")).select("doc_id", "key", "m.*")
    # rows with the same doc_id and text give the same matches
    found = found.dropDuplicates(["doc_id", "key", "kind", "wide", "nth"])
    so_far = Window.partitionBy("doc_id", "key", "kind", "wide").orderBy("nth")
    found = found.withColumn("end", F.sum(F.col("gap") + F.length("text")).over(so_far))
    return found.withColumn("start", F.col("end") - F.length("text")).drop("nth", "gap")


def _near(c: Column) -> Column:
    """Class of a neighbouring character: none or white space, punctuation, letter, other."""
    return F.when((c == "") | c.isNull() | c.rlike(r"\s"), 0).when(c.rlike(r"[,.;:!?()\"'\[\]|]"), 1).when(c.rlike(r"\p{L}"), 2).otherwise(3)


def _features(c: DataFrame) -> DataFrame:
    """Adds to matches the columns of BINS but copies, valid (the check of the kind, on its digits) and named."""
    kind, text = F.col("kind"), F.col("text")
    n = F.length(only_digits(text))
    letters = F.length(text)
    size = F.when(kind == "email", F.when(letters < 6, 0).when(letters < 12, 1).when(letters < 40, 2).otherwise(3))
    size = size.when(kind == "secret", F.when(letters < 20, 0).when(letters < 28, 1).when(letters < 36, 2).when(letters < 44, 3).when(letters < 72, 4).otherwise(5))
    size = size.otherwise(F.when(n < 7, 0).when(n < 10, 1).when(n < 12, 2).when(n < 14, 3).when(n < 20, 4).otherwise(5))
    groups = F.least(F.lit(3), F.greatest(F.lit(0), F.regexp_count("text", F.lit("[0-9]+")) - 1))
    groups = F.when(kind == "secret", F.least(F.lit(3), F.floor(4 * n / letters))).otherwise(groups)  # or the share of digits
    marks = F.when(kind == "secret", F.when(text.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), 0).when(text.rlike("^[0-9a-z]+$|^[0-9A-Z]+$"), 1).when(text.rlike("^[0-9A-Za-z]+$"), 2).otherwise(3))
    marks = marks.otherwise(F.when(text.startswith("+"), 0).when(text.rlike(r"[(\[]"), 1).when(text.rlike(r"\x20"), 2).otherwise(3))
    named = F.lit(False)
    for k, words in NAMES.items():
        named = named | ((kind == k) & F.col("before").rlike(rf"(?i)(?:{words})\W{{0,4}}$"))
    return c.withColumns({
        "size": size,
        "groups": groups.cast("int"),
        "marks": marks,
        "before_": _near(F.right("before", F.lit(1))),
        "after_": _near(F.left("after", F.lit(1))),
        "valid": F.when(kind.isin("ip", "card", "phone"), _valid(kind, F.regexp_replace("text", r"\[\.\]", "."))).otherwise(False),
        "named": named,
        "international": text.rlike("^(?:[+]|00)"),
        "string": F.xxhash64("kind", F.lower("text")),
    }).drop("before", "after").withColumnsRenamed({"before_": "before", "after_": "after"})


def boosted(cells: np.ndarray, good: np.ndarray, all_: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list[tuple]]:
    """Boosted trees for the logistic loss on counted cells (rows of binned features). Bias and trees (f, v, (f1, v1, low, high), (f2, v2, low, high)): go low where feature <= v."""
    share = (good.sum() + 1) / (all_.sum() + 2)
    bias = float(np.log(share / (1 - share)))
    score = np.full(len(cells), bias)
    splits = [(f, v) for f in range(cells.shape[1]) for v in np.unique(cells[:, f])[:-1].tolist()]
    trees: list[tuple] = []

    def best(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple:
        g, h = grad[rows].sum(), hess[rows].sum()
        found = (1e-9, 0, -1, g / (h + 1), g / (h + 1))
        for f, v in splits:
            low = rows & (cells[:, f] <= v)
            gl, hl = grad[low].sum(), hess[low].sum()
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > found[0]:
                found = (gain, f, v, gl / (hl + 1), (g - gl) / (h - hl + 1))
        return found

    for _ in range(rounds if splits else 0):
        p = 1 / (1 + np.exp(-score))
        grad, hess = good - all_ * p, all_ * p * (1 - p)
        _, f, v, _, _ = best(np.ones(len(cells), bool), grad, hess)
        low = cells[:, f] <= v
        sides = []
        for rows in (low, ~low):
            _, f2, v2, a, b = best(rows, grad, hess)
            sides.append((f2, v2, rate * float(a), rate * float(b)))
            score[rows] += np.where(cells[rows, f2] <= v2, rate * a, rate * b)
        trees.append((f, v, *sides))
    return bias, trees


def _scores(cells: np.ndarray, bias: float, trees: list[tuple]) -> np.ndarray:
    out = np.full(len(cells), bias)
    for f, v, left, right in trees:
        a, b = (np.where(cells[:, s[0]] <= s[1], s[2], s[3]) for s in (left, right))
        out += np.where(cells[:, f] <= v, a, b)
    return out


def threshold(score: np.ndarray, good: np.ndarray, all_: np.ndarray, precision: float = PRECISION, errors: float = ERRORS) -> float:
    """The lowest score such that the share of good candidates from there on is at least `precision`, by the lower end of its (Wilson) interval of so many standard errors; infinite if there is none. Few candidates make the interval wide, so their number acts without a step."""
    order = np.argsort(-score, kind="stable")
    n, hits = np.maximum(np.cumsum(all_[order]), 1e-9), np.cumsum(good[order])
    p, z = hits / n, errors
    lower = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    last = np.r_[score[order][1:] < score[order][:-1], True]  # cells of equal scores go together
    fit = np.flatnonzero((lower >= precision) & last)
    return float(score[order][fit[-1]]) if len(fit) else float("inf")


def _expression(bias: float, trees: list[tuple]) -> str:
    names = list(BINS)

    def leaf(s: tuple) -> str:
        return f"IF({names[s[0]]} <= {s[1]}, {s[2]:.9f}D, {s[3]:.9f}D)"

    return " + ".join([f"{bias:.9f}D", *(f"IF({names[f]} <= {v}, {leaf(a)}, {leaf(b)})" for f, v, a, b in trees)])


def added_condition(candidates: DataFrame) -> Column:
    """Fit the trees on candidates (key, kind, the columns of BINS, evidence), set thresholds on candidates that the trees have not seen, and give the condition under which one is redacted.

    The texts are dealt to FOLDS parts; each part is scored by trees fitted on
    the others, and these scores set the threshold of the trees fitted on all.
    """
    fold = F.pmod("key", F.lit(FOLDS))
    counted = candidates.groupBy("kind", fold.alias("fold"), *BINS).agg(F.sum(F.col("evidence").cast("long")).alias("good"), F.count(F.lit(1)).alias("all")).collect()  # CELLS rows at most
    accept = F.lit(False)
    for kind in ALL_KINDS:
        rows = sorted((tuple(r[b] for b in BINS), r["fold"], r["good"], r["all"]) for r in counted if r["kind"] == kind)
        if not rows:
            continue
        cells = np.array([r[0] for r in rows])
        part, good, all_ = (np.array([r[i] for r in rows], float) for i in (1, 2, 3))
        unseen = np.zeros(len(rows))
        for f in range(FOLDS):
            own = part == f
            if own.any():
                unseen[own] = _scores(cells[own], *boosted(cells[~own], good[~own], all_[~own])) if (~own).any() else -np.inf
        least = threshold(unseen, good, all_)
        if np.isfinite(least):
            accept = accept | ((F.col("kind") == kind) & (F.expr(_expression(*boosted(cells, good, all_))) >= least - 1e-6))
    return accept


def candidates(docs: DataFrame) -> DataFrame:
    """Base spans and further candidates, once for each doc_id and text: doc_id, key (hash of both), kind, start, end, base, wide, evidence, and the columns of BINS."""
    m = _features(_matches(docs))
    m = m.withColumn("base", ~F.col("wide") & (F.col("valid") | (F.col("kind") == "email"))).filter(F.col("base") | F.col("wide"))
    checked = F.col("valid") & ((F.col("kind") != "phone") | F.col("international"))
    evidence = F.max(F.col("base") | checked | F.col("named"))
    one = m.groupBy("doc_id", "key", "kind", "start", "end").agg(F.max("base").alias("base"), F.max("wide").alias("wide"), evidence.alias("evidence"), F.first("string").alias("string"), *[F.max(b).alias(b) for b in BINS if b != "copies"])
    one = staged(one, "candidates")
    copies = one.groupBy("string").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    n = F.coalesce("copies", F.lit(1))
    return one.join(copies, "string", "left").drop("string").withColumn("copies", F.when(n < 2, 0).when(n < 5, 1).when(n < 17, 2).otherwise(3))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of doc_id and text), kind, start, end, base: all spans, once for each doc_id and text."""
    one = candidates(docs)
    by = Window.partitionBy("doc_id", "key", "kind").orderBy("start", "end")
    taken_before = F.max(F.when(F.col("base"), F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start")
    taken_after = F.min(F.when(F.col("base"), F.col("start"))).over(by.rowsBetween(1, Window.unboundedFollowing)) < F.col("end")
    free = ~F.coalesce(taken_before, F.lit(False)) & ~F.coalesce(taken_after, F.lit(False))
    accept = added_condition(one.filter("wide"))
    out = one.withColumn("free", free).filter(F.col("base") | (F.col("wide") & accept & F.col("free")))
    return out.select("doc_id", "key", "kind", "start", "end", "base")


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in ALL_KINDS]), kind).cast("int")


def listed(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (the base spans as kind:start:end, comma-joined) and spans (all, likewise) of every document."""
    s = found(docs)
    order = F.struct("start", _rank(F.col("kind")).alias("rank"), "end", "kind", "base")
    grouped = s.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(order)).alias("all"), *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS])

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    grouped = grouped.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), *[f"n_{k}" for k in KINDS], text(F.filter("all", lambda x: x["base"])).alias("base"), text(F.col("all")).alias("spans"))
    own = texts(docs).select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"))
    out = own.join(grouped, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets ([EMAIL]); spans that overlap or touch inside another become one."""
    s = found(docs)
    own_id, own_key, spans, last, key = apart(docs.columns, "pii_id", "pii_own", "pii_spans", "pii_end", "pii_key")
    by = Window.partitionBy("doc_id", "key").orderBy("start", _rank(F.col("kind")), "end").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("done", F.coalesce(F.max("end").over(by), F.lit(0)))
    s = s.groupBy(F.col("doc_id").alias(own_id), F.col("key").alias(own_key)).agg(F.array_sort(F.collect_list(F.struct("start", _rank(F.col("kind")).alias("rank"), "end", "kind", "done"))).alias(spans), F.max("end").alias(last))
    text = F.col("text").cast("string")
    d = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(text, F.lit(""))))
    d = d.join(s, F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_key)), "left")

    def piece(x: Column) -> Column:
        gap = F.substring(text, x["done"].cast("int") + 1, F.greatest(F.lit(0), x["start"] - x["done"]).cast("int"))
        return F.when(x["start"] >= x["done"], F.concat(gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")

    new = F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, F.col(last).cast("int") + 1, F.lit(2**31 - 1)))
    return d.withColumn("text", F.coalesce(new, text)).select(*docs.columns)
