"""Points in intervals as an equi-join: which of many overlapping periods a date lies in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.sizes import BROADCAST_ROWS
from gleaner.scratch import materialize

#: Beginnings and ends of periods that one task sums up.
EDGES = 100_000


def stretches(periods: DataFrame, edges: int = EDGES) -> DataFrame:
    """``route, start, stop, n, label``: the stretches between the beginnings and ends of a route's periods that lie in some, in how many, and the label of an only one.

    Running sums over the edges say how many periods hold; the sum of the
    numbers of those that do is the number of an only one.  Edges are dealt by
    ranges of routes and times, so that only the ranges' sums meet.
    """
    held = periods.where(F.col("route").isNotNull() & (F.col("stop") - F.col("start") > 0)).select("route", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "label")
    held = materialize(held.withColumn("id", F.monotonically_increasing_id().cast("decimal(20,0)")), "periods")
    edge = lambda at, sign: F.struct(F.col(at).alias("at"), F.lit(sign).alias("n"), (F.lit(sign) * F.col("id")).cast("decimal(20,0)").alias("id"))
    each = held.select("route", F.inline(F.array(edge("start", 1), edge("stop", -1)))).groupBy("route", "at").agg(F.sum("n").alias("n"), F.sum("id").alias("id"))
    each = materialize(each, "edges")
    ranges = each.repartitionByRange(each.count() // edges + 1, "route", "at")
    dealt = materialize(ranges.withColumn("_range", F.spark_partition_id()), "ranges")
    line, inside = Window.partitionBy("route").orderBy("_range"), Window.partitionBy("route", "_range").orderBy("at")
    before, sums = line.rowsBetween(Window.unboundedPreceding, -1), dealt.groupBy("route", "_range").agg(F.sum("n").alias("n"), F.sum("id").alias("id"), F.min("at").alias("first"))
    sums = sums.select("route", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("id").over(before), F.lit(0)).alias("id0"), F.lead("first").over(line).alias("next"))
    run = lambda c: F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = dealt.join(sums, ["route", "_range"]).select("route", F.col("at").alias("start"), F.coalesce(F.lead("at").over(inside), "next").alias("stop"), (F.col("n0") + run("n")).alias("n"), (F.col("id0") + run("id")).alias("sum"))
    cut = cut.where("n > 0").withColumn("_only", F.when(F.col("n") == 1, F.col("sum")).cast("decimal(20,0)"))
    return cut.join(held.select(F.col("id").alias("_only"), "label"), "_only", "left").select("route", "start", "stop", "n", "label")


def in_periods(points: DataFrame, at: Column, route: Column, periods: DataFrame, key: str | None = None) -> DataFrame:
    """``points`` with ``n_periods``, the periods of its route that it lies in, and ``label`` and ``status``.

    ``periods`` has ``route, start, stop, label``; ``at``, ``start`` and ``stop``
    are whole numbers (days, seconds), ``start`` belongs to a period, ``stop``
    doesn't.  ``status`` is ``exactly_one``, ``none`` or ``several``, and
    ``label`` is known for exactly one.  ``key`` isn't needed any more.

    Periods become stretches that don't overlap, so a point meets at most one,
    however many periods lie over each other, and points are neither multiplied
    nor grouped.  A stretch lies in at most two cells of the least power of 16
    that is as long as it is; points meet stretches by route and cell, in one
    join for each power that stretches have, without a shuffle where these are
    few.
    """
    power = F.greatest(F.lit(0), F.ceil(F.log2((F.col("stop") - F.col("start")).cast("double")) / 4).cast("int")) * 4
    cell = lambda x, p: F.floor(x / F.pow(F.lit(2.0), p)).cast("long")
    celled = stretches(periods).withColumn("_power", power)
    celled = celled.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(F.col("start"), F.col("_power")), cell(F.col("stop") - 1, F.col("_power"))))))
    celled = materialize(celled.select(F.col("route").alias("_route"), "_power", "_cell", F.col("start").alias("_start"), F.col("stop").alias("_stop"), "n", "label"), "stretches")
    sizes = {r[0]: r[1] for r in celled.groupBy("_power").count().collect()}  # at most 16 numbers
    few = sum(sizes.values()) <= BROADCAST_ROWS
    found = points.select(*points.columns, at.cast("long").alias("_at"), route.alias("_own"))
    for p in sorted(sizes):
        one = celled.where(F.col("_power") == p).select("_route", "_cell", "_start", "_stop", F.struct("n", "label").alias(f"_met{p}"))
        met = (F.col("_own") == F.col("_route")) & (cell(F.col("_at"), F.lit(p)) == F.col("_cell")) & (F.col("_start") <= F.col("_at")) & (F.col("_at") < F.col("_stop"))
        found = found.join(F.broadcast(one) if few else one, met, "left").drop("_route", "_cell", "_start", "_stop")
    met = F.coalesce(F.lit(None).cast(celled.select(F.struct("n", "label")).schema[0].dataType), *[F.col(f"_met{p}") for p in sorted(sizes)])
    n = F.coalesce(met["n"], F.lit(0).cast("long"))
    status = F.when(n == 1, "exactly_one").when(n == 0, "none").otherwise("several")
    return found.select(*points.columns, n.alias("n_periods"), F.when(n == 1, met["label"]).alias("label"), status.alias("status"))
