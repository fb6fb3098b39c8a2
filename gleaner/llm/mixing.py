"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate ``budget * weight / size``; each
document draws its number of copies by inverting the Poisson distribution of
that mean at a uniform value hashed from the seed and its id, is exploded into
so many copies, and the copies are dealt and sorted by a second hash, which
is a global shuffle.  Equal seeds give equal copies on any cluster; the second
hash also takes the row's number, so that rows of one id, or without one, are
dealt over all tasks.

Defined results: a null source is a source of its own; a null text has size
0 (each document counts 1 at least); rows with equal ``doc_id`` draw equal
counts, those without one as if it were empty text; a source without a weight
in ``weights`` gets none; an empty table gives no rows; other columns are
carried along, but a ``copy_no`` of the input is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import lookup_join, numbered_columns, restored
from gleaner.scratch import materialize

SEED = "mix-1"
#: Weights are sizes to this power unless they are given.
TEMPERATURE = 0.5
#: Means above it are summed from near the mean.
LARGE = 400


def uniform(*parts: Column | str) -> Column:
    """A value in [0, 1) of 52 bits hashed from the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def log_factorial(n: Column) -> Column:
    """By Stirling's series, which is exact to a double from about 100 on."""
    return n * F.log(n) - n + F.log(2 * math.pi * n) / 2 + 1 / (12 * n) - 1 / (360 * F.pow(n, F.lit(3))) + 1 / (1260 * F.pow(n, F.lit(5)))


def poisson_quantile(u: Column, rate: Column) -> Column:
    """The least k with P(X <= k) > u for X of Poisson distribution with mean ``rate``.

    Terms up to mean + 12 deviations + 20 are summed, beyond any u below
    1 - 2 ** -52; for a mean above ``LARGE``, whose first term is too small for
    a double, from mean - 12 deviations - 20 on.
    """
    large = rate > LARGE
    first = F.when(large, F.floor(rate - 12 * F.sqrt(rate) - 20)).otherwise(F.lit(0)).cast("int")
    most = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    p = F.when(large, F.exp(first * F.log(rate) - rate - log_factorial(F.greatest(first, F.lit(1)).cast("double")))).otherwise(F.exp(-rate))
    start = F.struct(p.alias("p"), p.alias("c"), first.alias("k"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), (s["k"] + F.when(s["c"] <= u, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(first + 1, most), start, step, lambda s: s["k"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, budget_chars: float | None = None) -> DataFrame:
    """``_source, _rate`` of each source: sizes are characters, the budget all of them unless given."""
    size = F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("long")
    sizes = docs.groupBy(F.col("source").alias("_source")).agg(F.sum(size).alias("_size"))
    if weights is None:
        weight = F.pow(F.col("_size").cast("double"), F.lit(temperature))
    else:
        given = docs.sparkSession.createDataFrame([*weights.items()], "_name string, _given double")
        sizes = sizes.join(F.broadcast(given), F.col("_source").eqNullSafe(F.col("_name")), "left")
        weight = F.coalesce("_given", F.lit(0.0))
    sizes = sizes.withColumn("_weight", weight)
    sizes = materialize(sizes.select("_source", "_size", "_weight"), "sources")
    total = sizes.agg(F.sum("_size").cast("double"), F.sum("_weight")).first()  # one row
    everything, weights_sum = float(total[0] or 0), float(total[1] or 0)
    budget = everything if budget_chars is None else float(budget_chars)
    rate = F.lit(budget) * F.col("_weight") / F.lit(weights_sum) / F.col("_size") if weights_sum > 0 else F.lit(0.0)
    return sizes.select("_source", rate.alias("_rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = SEED, temperature: float = TEMPERATURE, budget_chars: float | None = None) -> DataFrame:
    """The columns of ``docs`` and ``copy_no`` (from 0), a row for each copy, in shuffled order."""
    names = [c for c in docs.columns if c.lower() != "copy_no"]
    rates = materialize(source_rates(docs.select("source", "text"), weights, temperature, budget_chars), "rates")
    plain, place = numbered_columns(docs, names)
    rated = lookup_join(plain, rates, F.col(place["source"]).eqNullSafe(F.col("_source")))
    count = poisson_quantile(uniform(seed, F.col(place["doc_id"])), F.col("_rate"))
    copies = (
        rated.withColumn("_n", F.when(F.col("_rate") > 0, count).otherwise(0))
        .where("_n > 0")
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("_place", F.xxhash64(F.lit(f"{seed}:place"), place["doc_id"], "copy_no", "_row"))
    )
    return copies.repartition("_place").sortWithinPartitions("_place").select(*restored(place, names, []), "copy_no")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The copies that ``mix`` makes, with the columns of ``docs`` alone, whatever their names."""
    plain, place = numbered_columns(docs, docs.columns)
    named = {place[c]: c for c in ("doc_id", "text", "source")}
    copies = mix(plain.withColumnsRenamed(named), **options)
    return copies.select(*[F.col(named.get(place[c], place[c])).alias(c) for c in docs.columns])
