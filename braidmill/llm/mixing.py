"""Mixing sources to target weights by Poisson replication.

A source with weight w among the weights W of all sources present gets the
mean repetition rate w / W * budget / rows.  Each document draws its count by
inverting the Poisson distribution of that mean at a number seeded by its id,
is exploded by the count, and goes to a place of the global order given by the
digest of id and copy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, quoted

SEED = 20240
#: Weight of each source; sources not named here weigh ``OTHER``.
WEIGHTS = {"src0": 4.0}
OTHER = 1.0
#: Sources of a table small enough to be broadcast; more are joined by salted keys.
BROADCAST_SOURCES = 10_000
SALTS = 64
_RANGE = float(1 << 52)
#: Means above this are drawn as sums of draws of this mean, so that exp(-mean) never vanishes.
_STEP = 16.0


def _uniform(key: Column) -> Column:
    """In (0, 1), from 52 bits of the key's digest."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(_RANGE)


def poisson(u: Column, mean: Column) -> Column:
    """The smallest k whose distribution function reaches ``u``, for a mean up to 16.

    The series ends when the sum reaches u or can grow no more; u has 53 bits,
    and beyond the last step less than 2 ** -60 is left of the distribution.
    """
    state = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("s"))

    def step(a: Column, i: Column) -> Column:
        p = a["p"] * mean / i
        more = F.struct((a["k"] + 1).alias("k"), p.alias("p"), (a["s"] + p).alias("s"))
        return F.when((a["s"] < u) & ((i <= mean) | (a["s"] + p > a["s"])), more).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.ceil(mean + 10 * F.sqrt(mean)).cast("int") + 24), state, step, lambda a: a["k"])


def source_rates(docs: DataFrame, weights: dict[str, float], other: float, budget: float | None) -> DataFrame:
    """(bm_source, bm_rate): the mean repetition rate of every source in ``docs``."""
    rows = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("bm_source")).agg(F.count("*").alias("n"))
    weight = F.lit(float(other))
    for name, w in sorted(weights.items()):
        weight = F.when(F.col("bm_source") == name, F.lit(float(w))).otherwise(weight)
    rows = rows.withColumn("w", weight)
    total = rows.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    target = F.lit(float(budget)) if budget is not None else F.col("all_n")
    share = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w")).otherwise(0.0)
    return rows.crossJoin(F.broadcast(total)).select("bm_source", (share * target / F.col("n")).alias("bm_rate"))  # the other side is one row


def _with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(rates), "bm_source")
    salted = rates.withColumn("bm_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("bm_salt", F.pmod(F.xxhash64("bm_key"), F.lit(SALTS)).cast("int")).join(salted, ["bm_source", "bm_salt"])


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, other: float = OTHER, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` replicated and shuffled, plus bm_copy, bm_copies, bm_order.

    ``budget`` is the expected number of rows of the result, by default that of
    ``docs``.  ``bm_copies`` is the document's count, ``bm_copy`` runs from 1,
    and ``bm_order`` (a digest of id and copy) sorts the result into its global
    order; each partition holds its rows in that order.  Columns of ``docs``
    are returned as they are; where one is called like the three, these get
    underscores behind their names.  A null source is the source ``''``; a null
    doc_id draws as the key ``null``.  Equal rows share their counts and are
    both kept.  A null or empty text is replicated like any other.  A weight of
    0 drops a source, and where all sources present weigh 0 nothing is left; an
    empty table stays empty.  Weights and budgets that are negative, infinite or
    not numbers are refused.
    """
    weights = WEIGHTS if weights is None else weights
    for name, w in [*weights.items(), ("other", other), ("budget", 0.0 if budget is None else budget)]:
        if not (math.isfinite(w) and w >= 0):
            raise ValueError(f"the weight or budget of {name!r} is {w}; it must be a finite number from 0 on")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("bm_key")
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("bm_doc"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("bm_source"), key)
    rated = _with_rates(rows, materialize(source_rates(docs, weights, other, budget)))
    key = F.col("bm_key")
    parts = F.greatest(F.lit(1), F.ceil(F.col("bm_rate") / _STEP).cast("int"))
    single = poisson(_uniform(F.concat(key, F.lit(":0"))), F.col("bm_rate"))
    several = F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda a, i: a + poisson(_uniform(F.concat(key, F.lit(":"), i.cast("string"))), F.col("bm_rate") / parts))
    counted = rated.withColumn("bm_copies", F.when(parts == 1, single).otherwise(several)).where("bm_copies > 0")
    copies = counted.withColumn("bm_copy", F.explode(F.sequence(F.lit(1), F.col("bm_copies"))))
    copies = copies.withColumn("bm_order", F.md5(F.concat(key, F.lit("#"), F.col("bm_copy").cast("string"))))
    spread = F.xxhash64("bm_order", *[F.col(f"bm_doc.{c}") for c in ("text",) if c in docs.columns])
    out = copies.select("bm_doc", "bm_copy", "bm_copies", "bm_order").repartition(spread).sortWithinPartitions("bm_order")
    names = {c: free_name(docs.columns, c) for c in ("bm_copy", "bm_copies", "bm_order")}
    return out.select("bm_doc.*", *[F.col(c).alias(n) for c, n in names.items()])
