"""Budgets over queues: round robin with a cap that binds part of the way, and staged admission.

Both are sequential rules of which the sequence needn't be walked: what is
taken before a cap binds, and after it, has a closed form, and where it binds is
a rank.  Ranks are those of the first rows of a group or of all, as many as a
budget holds, which Spark cuts in each task before it shuffles; so no task gets
a whole queue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.scratch import materialize


def queue_budget(rows: DataFrame, bucket: str, order: list[Column], capped: Column, budget: int, cap: int) -> DataFrame:
    """The rows that a round robin over the buckets' queues takes, with their ``place`` from 1.

    Buckets take turns by name, each giving the next row of its queue, until
    ``budget`` rows are taken.  Of ``capped`` rows at most ``cap`` are taken;
    further ones are passed over, so that their bucket gives the next other
    row in the same turn.  Rows without a bucket aren't taken.
    """
    rows = rows.where(F.coalesce(F.col(bucket).cast("string"), F.lit("")) != "")
    of_kind, of_bucket = (Window.partitionBy(bucket, *more).orderBy(*order) for more in (["_capped"], []))
    marked = rows.withColumn("_capped", F.coalesce(capped, F.lit(False)))
    # no row further back in its kind can be reached
    near = materialize(marked.withColumn("_k", F.row_number().over(of_kind)).where(F.col("_k") <= budget).withColumn("_turn", F.row_number().over(of_bucket)), "queues")
    line = Window.orderBy("_turn", bucket)
    # the first rows of all queues as if nothing were capped: at most ``budget``
    plain = near.orderBy("_turn", bucket).limit(budget).withColumns({"place": F.row_number().over(line), "_seen": F.count_if("_capped").over(line)})
    plain = materialize(plain, "plain")
    binds = plain.where(F.col("_capped") & (F.col("_seen") > cap)).orderBy("place").limit(1).select(F.col("_turn").alias("_t"), F.col(bucket).alias("_b"), F.col("place").alias("_p"))
    met = plain.crossJoin(F.broadcast(binds.agg(F.first("_p").alias("_p")))).where(F.col("_p").isNull() | (F.col("place") < F.col("_p"))).drop("_p")
    # after it, each bucket goes on with its next rows of the other kind
    rest = near.where(~F.col("_capped")).join(F.broadcast(binds), (F.col("_turn") > F.col("_t")) | ((F.col("_turn") == F.col("_t")) & (F.col(bucket) >= F.col("_b"))))
    later = rest.withColumn("_turn", F.col("_t") - 1 + F.row_number().over(of_bucket) + F.when(F.col(bucket) < F.col("_b"), 1).otherwise(0))
    later = later.orderBy("_turn", bucket).limit(budget).withColumn("place", F.col("_p") - 1 + F.row_number().over(line)).where(F.col("place") <= budget)
    return met.select(*rows.columns, "place").unionByName(later.select(*rows.columns, "place"))


def admit(rows: DataFrame, target: int, route_cap: int, total: int) -> DataFrame:
    """Staged admission of results, taken by ``ord``: ``rows`` with ``outcome`` and ``lookup``.

    ``rows`` has ``ord``, ``stops`` (whether its stage ends once ``target``
    rows are admitted; such stages come first), ``eligible``, ``needs`` (it
    passes only by a lookup), ``resolves`` (its lookup finds what is needed),
    ``url``, ``route``, ``key`` and ``scored``.  Lookups are granted in order,
    ``total`` of them and ``route_cap`` per route; one for each url, whose
    later rows share it.  A row that passes is a duplicate if one that passed
    before has its key; else it is admitted if it is ``scored``.  Outcomes:
    ``admitted``, ``low_score``, ``duplicate``, ``unresolved``, ``no_budget``,
    ``ineligible`` and ``not_reached``.
    """
    known = materialize(rows, "results")

    def lookups(part: DataFrame, used: DataFrame | None, left: int) -> DataFrame:
        """The urls of ``part`` that are granted a lookup, with where; ``used`` has the lookups granted before, by route."""
        first = part.where("eligible AND needs").groupBy("url").agg(F.min(F.struct("ord", "route")).alias("f")).select("url", F.col("f.ord").alias("at"), F.col("f.route").alias("route"))
        room = F.lit(route_cap)
        if used is not None:
            first = first.join(used.select(F.col("url").alias("_u")), F.col("url").eqNullSafe(F.col("_u")), "left_anti")
            spent = used.groupBy(F.col("route").alias("_r")).agg(F.count("*").alias("spent"))
            first, room = first.join(F.broadcast(spent.limit(total)), F.col("route").eqNullSafe(F.col("_r")), "left"), F.lit(route_cap) - F.coalesce("spent", F.lit(0))
        ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("route").orderBy("at"))).where(F.col("n") <= route_cap).where(F.col("n") <= room)
        return materialize(ranked.orderBy("at").limit(left).select("url", "route", "at"), "lookups")

    def judged(part: DataFrame, granted: DataFrame) -> DataFrame:
        side = granted.select(F.col("url").alias("_u")).distinct().withColumn("granted", F.lit(True))
        met = part.join(F.broadcast(side), F.col("url").eqNullSafe(F.col("_u")), "left").drop("_u").withColumn("granted", F.coalesce("granted", F.lit(False)) & F.col("eligible") & F.col("needs"))
        return met.withColumn("_passes", F.col("eligible") & (~F.col("needs") | (F.col("granted") & F.col("resolves"))))

    def firsts(part: DataFrame) -> DataFrame:
        return part.where("_passes").groupBy("key").agg(F.min("ord").alias("_f")).select(F.col("key").alias("_k"), "_f")

    early, late = known.where("stops"), known.where("NOT stops")
    granted = lookups(early, None, total)
    tried = judged(early, granted)
    tried = materialize(tried.join(firsts(tried), F.col("key").eqNullSafe(F.col("_k")), "left").drop("_k"), "tried")
    admitted = F.col("_passes") & (F.col("_f") == F.col("ord")) & F.col("scored")
    # the row that fills the target is the last one that these stages take
    last = tried.where(admitted).orderBy("ord").limit(target).agg(F.max("ord").alias("m"), F.count("*").alias("n")).first()
    end = last["m"] if last["n"] >= target else None
    reached = F.lit(True) if end is None else F.col("ord") <= F.lit(end)
    spent = granted if end is None else materialize(granted.where(F.col("at") <= end), "spent")
    more = lookups(late, spent, total - spent.count())
    after = judged(late, spent.select("url").unionByName(more.select("url")))
    both = tried.withColumn("_reached", reached).drop("_f").unionByName(after.withColumn("_reached", F.lit(True)))
    both = materialize(both.withColumn("_passes", F.col("_passes") & F.col("_reached")), "judged")
    met = both.join(firsts(both), F.col("key").eqNullSafe(F.col("_k")), "left")
    outcome = (
        F.when(~F.col("_reached"), "not_reached").when(~F.col("eligible"), "ineligible").when(F.col("needs") & ~F.col("granted"), "no_budget").when(~F.col("_passes"), "unresolved")
        .when(F.col("_f") < F.col("ord"), "duplicate").when(F.col("scored"), "admitted").otherwise("low_score")
    )
    return met.select(*rows.columns, outcome.alias("outcome"), (F.col("granted") & F.col("_reached")).alias("lookup"))
