"""Similarity links between sets that share tokens, and connected components, without ever pairing a whole group.

Input rows (token, node, n, pos, hot) say that a set (node, of n elements) holds a
token at place pos of its ordered prefix. Only rows that meet a set of fitting
length at their token go on; they are found by one shuffle on the token, which the few hot
tokens skip. In each round every set is tested
against a few members of one of its tokens (first the one that shares most with
others), so candidates grow with the sets and not with the square of a group,
and the links give components. Later rounds only look at sets outside the
largest component of a token, and only at tokens that several components hold.
When a round finds
no link or few pairs are left, each set outside a token's largest component is
tested against all sets of other components there, in salted parts of bounded size. Pairs inside one component
need no test, and no pair is tested twice, so no component is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import pieces
from .common import Stages, staged

#: Bits of the filter that says which rows a later join may need; a table of at most _BITS / 64 rows.
_BITS = 1 << 24
#: Most rounds; in each but the first: members of a token's largest component that are offered, candidates of a set that are looked at,
#: and that are tested. Pairs per row that the last step may compare by their traits without further rounds.
ROUNDS, LEADS, LOOKED, TESTS, EACH = 2, 8, 32, 4, 50
#: Rows of a token that one part of the last step's join holds.
PART = 4096
#: Most frequent tokens that are told apart, and the number of their rows from which one is hot.
HEAVY, HOT = 1 << 17, 4096
#: 64-bit integers of a signature (512 bits).
WORDS = 8
#: (node, text) of the nodes asked for; the sorted distinct 64-bit hashes of each text of a column.
Fetch = Callable[[DataFrame], DataFrame]
Sets = Callable[[pa.Array], Iterator[np.ndarray]]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b): component is the least node reachable.

    Alternating large-star and small-star steps; minima are aggregated before
    the shuffle and joined back, so a node with many edges is not one group.
    They end when every node is either a centre or has one edge, to a centre.
    """
    stage = Stages(edges.sparkSession)
    e = stage(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct(), "edges")
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = stage(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = joined.select(F.col("u").alias("hi"), F.col("m").alias("lo")).unionByName(joined.select(F.col("v").alias("hi"), F.col("m").alias("lo"))).filter("hi <> lo")
        e = stage(small.distinct(), "edges")
        ends = e.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").limit(1).count():
            break
    out = staged(e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()), "parts")
    stage.drop()
    return out


def frequent(counts: DataFrame, most: int = HEAVY) -> list:
    """Rows (token, n) of the tokens with the greatest sums of n in counts (token, n), `most` at most: a histogram of the sums says from which one on they are taken."""
    stage = Stages(counts.sparkSession)
    total = stage(counts.groupBy("token").agg(F.sum("n").alias("n")), "frequent")
    level = F.when(F.col("n") < 256, F.col("n")).otherwise(128 + F.floor(16 * F.log2("n"))).cast("int")
    sizes = {r["level"]: r["count"] for r in total.groupBy(level.alias("level")).count().collect()}  # some 1200 levels at most
    least, taken = None, 0
    for k in sorted(sizes, reverse=True):
        taken += sizes[k]
        if taken > most:
            break
        least = k
    rows = total.filter(level >= least).collect() if least is not None else []
    stage.drop()
    return rows


def among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is among wanted's (and few others): a broadcast table of _BITS bits stands for wanted."""
    def bit(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(_BITS))

    bits = wanted.select(bit(F.col(key)).alias("bit")).groupBy(F.expr("bit div 64").alias("bits_at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    x = bit(F.col(key))
    found = rows.join(F.broadcast(bits), F.floor(x / 64) == F.col("bits_at"))
    return found.filter(F.expr("shiftright(bits, cast(pmod(xxhash64({0}), {1}) % 64 as int)) & 1 = 1".format(key, _BITS))).select(*rows.columns)


def long_enough(n: Column, m: Column, num: int, den: int) -> Column:
    """Length filter of Jaccard similarity num / den."""
    return F.least(n, m) * den >= F.greatest(n, m) * num


def verified(pairs: DataFrame, texts: DataFrame, sets: Sets, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) have sets of Jaccard similarity num / den or more."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "left"):
            same = []
            for x, y in zip(sets(b["left"]), sets(b["right"]), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                same.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.record_batch([b["a"], b["b"]], ["a", "b"]).filter(pa.array(same, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def bits_of(of: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
    """Signatures: for n sets, WORDS 64-bit integers each, with the bits of their elements' hashes g; of: the set of each element."""
    seen = np.zeros((n, 64 * WORDS), np.uint8)
    seen[of, (g >> np.uint64(64 - 9)).astype(np.int64)] = 1
    return np.packbits(seen, axis=1, bitorder="little").view("<i8").reshape(n, WORDS)


def overlap(x: Column, y: Column, n: Column, m: Column) -> Column:
    """Upper bound of the overlap of two sets of n and m elements by their signatures x and y (structs s0 ..): each bit that only one has is an element that only it has."""
    def only(p: Column, q: Column) -> Column:
        return sum((F.bit_count(p[f"s{i}"].bitwiseAND(F.bitwise_not(q[f"s{i}"]))) for i in range(WORDS)), F.lit(0))

    return F.least(n - only(x, y), m - only(y, x))


def meeting(tokens: DataFrame, num: int, den: int) -> DataFrame:
    """(token, node, n, pos, rows) of the rows of tokens that may meet another set of fitting length at their token, and those of hot tokens; rows: sets that hold the token."""
    columns = ("token", "node", "n", "pos")
    own = tokens.filter("NOT hot").select(*columns).repartition("token").dropDuplicates(["token", "node"])
    group = Window.partitionBy("token")
    by = group.orderBy("n", "node")  # the next ones by length tell whether any fits
    n = F.col("n")
    fits = F.coalesce(F.lag("n").over(by) * den >= n * num, F.lit(False)) | F.coalesce(n * den >= F.lead("n").over(by) * num, F.lit(False))
    own = own.withColumns({"fits": fits, "rows": F.count(F.lit(1)).over(group)}).filter("fits").drop("fits")
    hot = tokens.filter("hot").select(*columns).dropDuplicates(["token", "node"])
    sizes = hot.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    return own.unionByName(hot.join(sizes, "token").select(*columns, "rows"))


def linked(tokens: DataFrame, fetch: Fetch, sets: Sets, num: int, den: int, traits: DataFrame, fits: Callable[[Column, Column], Column], prune: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> DataFrame:
    """(node, component) of all sets with a link.

    tokens: token, node, n, pos, hot (for HEAVY tokens at most, which many sets
    hold); fetch gives (node, text) of the nodes asked
    for and sets the sorted hashes of each text; traits: node and trait (a
    struct); fits(x, y) is false only for traits of sets that can't be linked,
    and prune(pairs) drops only such pairs (a, b) before their texts are fetched.
    If traits hold `tokens`, the few tokens of a set, a pair is met once.
    """
    stage = Stages(tokens.sparkSession)
    live = stage(meeting(tokens, num, den), "shared")
    # what many others share most of is most likely near to all of them: it leads
    live = stage(live.join(live.groupBy("node").agg(F.sum("rows").alias("fame")), "node"), "shared")
    traits = stage(among(traits, "node", live).dropDuplicates(["node"]), "traits")

    def near(n: Column, pos: Column, m: Column, at: Column) -> Column:
        left = F.least(n - pos, m - at) * (num + den) >= num * (n + m)  # positional filter, for the first common token
        return long_enough(n, m, num, den) & left

    part, edges, tested, found = None, None, None, 0
    for turn in range(ROUNDS + 1):
        who = F.struct("node", "n", "pos")
        leads = F.array(F.max_by(who, F.struct("fame", "node")), *[F.min_by(who, F.xxhash64("node", F.lit(LEADS * turn + i))) for i in range(1, LEADS if turn else 1)])
        if part is None:  # every set is on its own
            few = live.join(live.groupBy("token").agg(leads.alias("leads")), "token")
        else:
            rows = live.drop("rows").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
            held = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("rows"))
            mixed = held.groupBy("token").agg(F.max_by("component", F.struct("rows", "component")).alias("major"), F.sum("rows").alias("rows"), F.max("rows").alias("most")).filter("rows > most")
            rest = stage(rows.join(mixed, "token"), "rest")
            live = rest.select("token", "node", "n", "pos", "fame", "rows")  # sets that are one component stay so
            sizes = rest.agg(F.sum(F.when(F.col("component") != F.col("major"), F.col("rows"))).alias("pairs"), F.count(F.lit(1)).alias("rows")).first()
            if turn == ROUNDS or (sizes["pairs"] or 0) <= EACH * sizes["rows"] or not found:
                break
            led = rest.filter("component = major").groupBy("token").agg(leads.alias("leads"))
            few = rest.filter("component <> major").join(led, "token")
        few = few.select(F.col("node").alias("x"), "n", "pos", "rows", "fame", F.explode("leads").alias("lead")).filter((F.col("x") != F.col("lead.node")) & near(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos")))
        if part is None:
            at = F.struct("rows", "lead.node")  # its most and its least shared token
            few = few.groupBy("x").agg(F.array(F.max_by("lead.node", at), F.min_by("lead.node", at)).alias("y")).select("x", F.explode("y").alias("y"))
        else:
            few = _some(few.select("x", F.col("lead.node").alias("y")).distinct(), LOOKED, turn)
            few = few.join(traits.select(F.col("node").alias("x"), F.col("trait").alias("xt")), "x").join(traits.select(F.col("node").alias("y"), F.col("trait").alias("yt")), "y")
            few = _some(few.filter(fits(F.col("xt"), F.col("yt"))).select("x", "y"), TESTS, turn)
        pairs = _new(stage, few.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), tested)
        new = stage(_tested(stage, pairs, prune, fetch, sets, num, den), "links")
        found = new.limit(1).count()
        tested = pairs if tested is None else tested.unionByName(pairs)
        edges = new if edges is None else edges.unionByName(new)
        if found or part is None:
            part = components(edges)
    cross = _new(stage, _apart(rest, traits, near, fits), tested)
    more = stage(_tested(stage, cross, prune, fetch, sets, num, den), "links")
    if more.limit(1).count():
        part = components(edges.unionByName(more))
    stage.drop()
    return part


def _apart(rest: DataFrame, traits: DataFrame, near: Callable[..., Column], fits: Callable[[Column, Column], Column]) -> DataFrame:
    """All pairs (a, b) of sets of different components at a token that the filters let pass, one of them outside the token's largest component.

    What a token's others are compared with is dealt to parts of PART rows, and the others to each of them, so that no token is one group.
    """
    parts = F.ceil(F.col("rows") / PART).cast("int")
    rest = rest.select("token", "node", "n", "pos", "component", "major", parts.alias("parts")).join(traits.select("node", "trait"), "node")
    few = rest.filter(F.col("component") != F.col("major")).select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("node").alias("x"), F.col("n").alias("xn"), F.col("pos").alias("xp"), F.col("component").alias("xc"), "major", F.col("trait").alias("xt"))
    many = rest.select("token", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.col("node").alias("y"), F.col("n").alias("yn"), F.col("pos").alias("yp"), F.col("component").alias("yc"), F.col("trait").alias("yt"))
    other = (F.col("xc") != F.col("yc")) & ((F.col("yc") == F.col("major")) | (F.col("xc") < F.col("yc")))
    once = "tokens" in traits.schema["trait"].dataType.names
    met = few["token"] == F.array_min(F.array_intersect("xt.tokens", "yt.tokens")) if once else F.lit(True)
    cross = few.join(many, (few["token"] == many["token"]) & (few["part"] == many["part"]) & other & near(F.col("xn"), F.col("xp"), F.col("yn"), F.col("yp")) & fits(F.col("xt"), F.col("yt")) & met)
    return cross.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _some(pairs: DataFrame, most: int, turn: int) -> DataFrame:
    """Up to `most` pairs of each x, for one round; what is left is for later rounds and the last step, which looks at all."""
    n = F.row_number().over(Window.partitionBy("x").orderBy(F.xxhash64("y", "x", F.lit(turn)), "y"))
    return pairs.withColumn("nth", n).filter(F.col("nth") <= most).drop("nth")


def _new(stage: Stages, pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    return stage(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")


def _tested(stage: Stages, pairs: DataFrame, prune: Callable[[DataFrame], DataFrame], fetch: Fetch, sets: Sets, num: int, den: int) -> DataFrame:
    left = stage(prune(pairs), "pairs")
    return verified(left, fetch(nodes_of(left)), sets, num, den)


def nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
