"""Mixing sources by temperature: p_i in proportion to (token share of source i) ** alpha.

alpha is bisected so that the mixture's entropy reaches `entropy` of the greatest possible one (the logarithm of the
number of sources), and raised if need be until no source is repeated more than `repeats` times within the budget; a
limit that even alpha = 1, the sources' own shares, breaks is an error. Each source then has a quota of budget * p_i tokens. Its documents are dealt in a fresh pseudo-random order each epoch until
the quota is met, and the place within the quota says into which of the equally large blocks a document goes, so every
block holds all sources in the target weights; inside a block the order is pseudo-random again.

Running sums never gather a source in one task: each source's order is cut into ranges of the permutation's hash, ranges
are summed, their sums are accumulated, and only rows of one range are sorted together. No text is shuffled.

Defined results: an empty table gives no rows; a null source is the source ""; a null or empty text has no tokens and is dealt like any other; sources
without tokens get nothing; with no tokens at all the result is empty; repeated rows are dealt one by one; a document's
last draw may exceed the quota by less than that document. Extra columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import DOC_ID, TEXT, written

ENTROPY, REPEATS = 0.92, 4.0
BLOCK_TOKENS = 1 << 18
RANGE_ROWS = 2_000
#: Up to so many sources are bisected on the driver; more are summed by Spark in each step.
MOST_SOURCES = 100_000
STEPS = 60
_SPACE = r"[\t-\r ]+"


class Mixture(NamedTuple):
    alpha: float
    entropy: float
    repeats: float


def tokens(text: Column) -> Column:
    """Maximal runs of characters that are not ASCII white space."""
    parts = F.split(F.coalesce(text, F.lit("")), _SPACE)
    return F.size(parts) - F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == ""), 1).otherwise(0)


def bisect(good: Callable[[float], bool], low: float, high: float) -> float:
    """The border in [low, high] below which `good` holds; low if it never does, high if it always does."""
    if good(high):
        return high
    for _ in range(STEPS):
        middle = (low + high) / 2
        if good(middle):
            low = middle
        else:
            high = middle
    return low


def temperature(measure: Callable[[float], Mixture], sources: int, entropy: float, repeats: float) -> float:
    """The greatest alpha in [0, 1] whose entropy suffices, raised to the least that keeps the repetition limit."""
    if sources < 2:
        return 1.0
    wanted = entropy * math.log(sources)
    alpha = bisect(lambda a: measure(a).entropy >= wanted, 0.0, 1.0)
    if measure(alpha).repeats > repeats:
        alpha = 1 - bisect(lambda a: measure(1 - a).repeats <= repeats, 0.0, 1 - alpha)
    return alpha


def check_limit(found: Mixture, repeats: float) -> None:
    if found.repeats > repeats * (1 + 1e-9):
        raise ValueError(f"the budget repeats a source {found.repeats:.2f} times at least; the limit is {repeats}")


def local_measure(shares: list[float], budget_ratio: float) -> Callable[[float], Mixture]:
    """budget_ratio: budget over all tokens."""

    def measure(alpha: float) -> Mixture:
        raised = [s**alpha for s in shares]
        total = sum(raised)
        p = [r / total for r in raised]
        return Mixture(alpha, -sum(x * math.log(x) for x in p if x > 0), max(budget_ratio * x / s for x, s in zip(p, shares, strict=True)))

    return measure


def _spark_measure(sizes: DataFrame, total: int, ratio: float) -> Callable[[float], Mixture]:
    def measure(alpha: float) -> Mixture:
        share = F.col("size") / total
        r = F.pow(share, F.lit(alpha))
        z, zlog, most = sizes.agg(F.sum(r), F.sum(r * F.log(r)), F.max(r / share)).first()
        return Mixture(alpha, math.log(z) - zlog / z, ratio * most / z)

    return measure


def mix(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, block_tokens: int = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, block, slot): the draws; budget is in tokens, all tokens of docs by default."""
    schema = "doc_id long, source string, n_tokens long, epoch int, block long, slot int"
    spark = docs.sparkSession
    own = written(docs.select(F.col(DOC_ID).cast("long").alias(DOC_ID), F.coalesce("source", F.lit("")).alias("source"), tokens(F.col(TEXT)).cast("long").alias("n_tokens")), "tokens")
    sizes = written(own.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("rows")).where("size > 0"), "sources")
    n, total = sizes.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return spark.createDataFrame([], schema)
    budget = budget or total
    if n <= MOST_SOURCES:
        measure = local_measure([r[0] / total for r in sizes.select("size").orderBy("source").collect()], budget / total)
    else:
        measure = _spark_measure(sizes, total, budget / total)
    alpha = temperature(measure, n, entropy, repeats)
    check_limit(measure(alpha), repeats)
    raised = F.pow(F.col("size") / total, F.lit(alpha))
    whole = sizes.agg(F.sum(raised)).first()[0]
    quota = sizes.withColumn("quota", raised / whole * budget).withColumn("ranges", F.ceil(F.col("rows") / RANGE_ROWS))
    drawn = own.join(quota, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.ceil(F.col("quota") / F.col("size")) - 1).cast("int")))))
    # the permutation's hash, and the range of it that a row falls in
    drawn = drawn.withColumn("h", F.xxhash64(F.lit(seed), "epoch", DOC_ID, "source"))
    drawn = drawn.withColumn("range", F.shiftright(F.shiftrightunsigned("h", 33) * F.col("ranges"), 31))
    sums = drawn.groupBy("source", "epoch", "range").agg(F.sum("n_tokens").alias("own"))
    ahead = W.partitionBy("source", "epoch").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("own").over(ahead), F.lit(0))).drop("own")
    inside = W.partitionBy("source", "epoch", "range").orderBy(F.shiftrightunsigned("h", 1), "h", DOC_ID, "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    placed = drawn.join(sums, ["source", "epoch", "range"]).withColumn("at", F.col("epoch") * F.col("size") + F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed = placed.where(F.col("at") < F.col("quota"))
    blocks = max(1, math.ceil(budget / block_tokens))
    placed = placed.withColumn("block", F.least(F.lit(blocks - 1), F.floor(F.col("at") / F.col("quota") * blocks)))
    order = W.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "h", "source"), DOC_ID, "epoch", "n_tokens")
    return placed.withColumn("slot", F.row_number().over(order) - 1).select(DOC_ID, "source", "n_tokens", "epoch", F.col("block").cast("long").alias("block"), "slot")
