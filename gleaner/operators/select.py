"""Budgeted, balanced and diverse selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks whose running sums one task makes.
RANK_BLOCK = 100_000


def per_group(rows: DataFrame, group: str, order: list[Column], most: int | Column) -> DataFrame:
    """At most ``most`` rows of each group. The rank limit is pushed below the shuffle by the optimizer's window-group limit."""
    columns = rows.columns
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("_rn") <= most).select(*columns)


def round_robin(rows: DataFrame, group: str, order: list[Column], positions: dict[str, int], most: int) -> DataFrame:
    """One row of each group a round, groups by their position, up to ``most`` rows: exact, as the order within a group is fixed."""
    columns = rows.columns
    place = F.create_map(*[F.lit(x) for kv in positions.items() for x in kv])[F.col(group)]
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where((F.col("_rn") <= most) & place.isNotNull())
    return ranked.withColumn("_pos", place).orderBy("_rn", "_pos").limit(most).withColumn("pick", (F.row_number().over(Window.orderBy("_rn", "_pos"))).cast("int")).select(*columns, "pick")


def backfill(chosen: DataFrame, pool: DataFrame, key: str, order: list[Column], target: int, cap: int) -> DataFrame:
    """``chosen`` and the best of ``pool`` that it lacks: as many as are short of ``target``, at most ``cap``."""
    short = max(0, min(cap, target - chosen.limit(target).count()))
    rest = pool.join(chosen.select(key), key, "left_anti").orderBy(*order).limit(short)
    return chosen.withColumn("filled", F.lit(False)).unionByName(rest.withColumn("filled", F.lit(True)))


def budget_lanes(rows: DataFrame, lane: str, order: list[Column], budgets: dict[str, int], rest: int) -> DataFrame:
    """Each named lane's best up to its budget, then the best ``rest`` of all other rows as lane ``general``."""
    columns = rows.columns
    named = F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv])[F.col(lane)]
    rn = F.row_number().over(Window.partitionBy(lane).orderBy(*order))
    laned = rows.where(named.isNotNull()).withColumn("_rn", rn).where(F.col("_rn") <= named)
    general = rows.where(named.isNull()).orderBy(*order).limit(rest)
    return laned.select(*columns, F.col(lane).alias("budget_lane")).unionByName(general.withColumn("budget_lane", F.lit("general")))


def interleave(rows: DataFrame, route: str, order: list[Column], route_order: str) -> DataFrame:
    """``pick``: first rows of all routes in the routes' order, then second rows, and so on.

    The order over all rows comes from counts: rows of earlier ranks, then
    earlier routes of the same rank, so no task numbers the whole table.
    """
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(route).orderBy(*order)))
    starts = ranked.groupBy(route).agg(F.min(route_order).alias("_first"))
    # ranks by routes: the number of rows of rank r is the number of routes with at least r rows
    per_rank = ranked.groupBy("_rn").agg(F.count("*").alias("_width")).select(F.col("_rn").alias("_r"), "_width")
    # running sums of ranks by blocks of them, so that only the blocks' sums meet in one task
    per_rank = per_rank.withColumn("_b", F.floor(F.col("_r") / RANK_BLOCK))
    blocks = per_rank.groupBy("_b").agg(F.sum("_width").alias("_sum")).select("_b", (F.sum("_sum").over(Window.orderBy("_b")) - F.col("_sum")).alias("_start"))
    inside = F.sum("_width").over(Window.partitionBy("_b").orderBy("_r")) - F.col("_width")
    before = per_rank.withColumn("_inside", inside).join(blocks, "_b").select("_r", (F.col("_start") + F.col("_inside")).alias("_before"))
    within = Window.partitionBy("_rn").orderBy("_first", route)
    placed = ranked.join(starts, route).withColumn("_w", F.row_number().over(within))
    return placed.join(before, F.col("_rn") == F.col("_r")).withColumn("pick", F.col("_before") + F.col("_w")).select(*rows.columns, "pick")


def water_fill(groups: list[str], budget: int, most: int, start: int = 2) -> dict[str, int]:
    """Even shares of a budget: ``start`` each as far as it goes, then one by one in turn up to ``most``."""
    if not groups:
        return {}
    shares = dict.fromkeys(groups, min(start, budget // len(groups), most))
    left = budget - sum(shares.values())
    while left > 0 and (room := [g for g in groups if shares[g] < most]):
        for g in room[:left]:
            shares[g] += 1
        left -= min(left, len(room))
    return shares


def diverse(rows: DataFrame, group: str, score: str, traits: list[str], k: int, penalty: float, ord_column: str) -> DataFrame:
    """In each group ``k`` picks, one by one: the row of highest score less ``penalty`` for each trait value that was picked before, the number of times it was.

    Per group only the ``k`` best of each combination of traits can be picked,
    which bounds what a task gets before the sequential part.
    """
    bounded = per_group(rows.withColumn("_combo", F.concat_ws("\x1f", F.col(group), *[F.coalesce(F.col(t).cast("string"), F.lit("")) for t in traits])), "_combo", [F.desc(score), F.asc(ord_column)], k)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        left, seen, out = pdf.sort_values([score, ord_column], ascending=[False, True]), {}, []
        while len(left) and len(out) < k:
            cost = sum(left[t].map(lambda v, t=t: seen.get((t, v), 0)) for t in traits)
            best = (left[score] - penalty * cost).idxmax()
            row = left.loc[best]
            for t in traits:
                seen[t, row[t]] = seen.get((t, row[t]), 0) + 1
            out.append((row[group], row[ord_column], len(out) + 1))
            left = left.drop(best)
        return pd.DataFrame(out, columns=[group, ord_column, "pick"])

    kinds = dict(rows.dtypes)
    return bounded.select(group, ord_column, score, *traits).groupBy(group).applyInPandas(pick, f"{group} {kinds[group]}, {ord_column} {kinds[ord_column]}, pick int")


def source_diverse(rows: DataFrame, group: str, score: str, source: str, k: int, bonus: float, ord_column: str) -> DataFrame:
    """In each group ``k`` picks, one by one, with a bonus for a source that hasn't been picked."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        left, seen, out = pdf.sort_values([score, ord_column], ascending=[False, True]), set(), []
        while len(left) and len(out) < k:
            best = (left[score] + bonus * ~left[source].isin(seen)).idxmax()
            seen.add(left.loc[best, source])
            out.append((left.loc[best, group], left.loc[best, ord_column], len(out) + 1))
            left = left.drop(best)
        return pd.DataFrame(out, columns=[group, ord_column, "pick"])

    kinds = dict(rows.dtypes)
    bounded = per_group(rows.withColumn("_combo", F.concat_ws("\x1f", group, source)), "_combo", [F.desc(score), F.asc(ord_column)], k)
    return bounded.select(group, ord_column, score, source).groupBy(group).applyInPandas(pick, f"{group} {kinds[group]}, {ord_column} {kinds[ord_column]}, pick int")


def rebalance(rows: DataFrame, group: str, bucket: str, score: str, k: int, tolerance: float, ord_column: str, recent: str | None = None, most_recent: float = 0.6) -> DataFrame:
    """In each group the ``k`` best, then for each bucket without one its best row in place of the weakest row of a bucket that has several, where the score is at most ``tolerance`` less.

    With ``recent``, a boolean column, the weakest recent rows then give way to
    the best older ones until at most ``most_recent`` of the chosen are recent.
    """
    keys = [group, bucket] if recent is None else [group, bucket, recent]

    def swap(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, ord_column], ascending=[False, True])
        chosen = pdf.head(k)
        order = lambda x: x.sort_values([score, ord_column], ascending=[False, True])
        for b in sorted(set(pdf[bucket]) - set(chosen[bucket])):
            best = pdf[pdf[bucket] == b].iloc[0]
            several = chosen[chosen[bucket].map(chosen[bucket].value_counts()) > 1]
            if len(several) and several.iloc[-1][score] - best[score] <= tolerance:
                chosen = order(pd.concat([chosen.drop(several.index[-1]), pdf.loc[[best.name]]]))
        if recent is not None:
            limit, older = int(len(chosen) * most_recent), pdf[~pdf[recent].astype(bool)].drop(chosen.index, errors="ignore")
            for at in older.index:
                now = chosen[chosen[recent].astype(bool)]
                if len(now) <= limit:
                    break
                chosen = order(pd.concat([chosen.drop(now.index[-1]), pdf.loc[[at]]]))
        return chosen[[group, ord_column, bucket]]

    kinds = dict(rows.dtypes)
    bounded = per_group(rows.withColumn("_combo", F.concat_ws("\x1f", *keys)), "_combo", [F.desc(score), F.asc(ord_column)], k)
    return bounded.select(*keys, ord_column, score).groupBy(group).applyInPandas(swap, f"{group} {kinds[group]}, {ord_column} {kinds[ord_column]}, {bucket} {kinds[bucket]}")


def protect_coverage(chosen: DataFrame, pool: DataFrame, key: str, kind: Column, order: list[Column], target: int) -> DataFrame:
    """``chosen``, at most ``target`` rows, with one of the kind: where it has none, the pool's best of it is added, or takes the place of the last if ``chosen`` is full."""
    if chosen.where(kind).limit(1).count():
        return chosen
    best = pool.where(kind).join(chosen.select(key), key, "left_anti").orderBy(*order).limit(1)
    room = target if not best.limit(1).count() else target - 1
    return chosen.orderBy(*order).limit(room).unionByName(best)


def top_excluded(rows: DataFrame, reason: str, score: Column, order: list[Column], most: int = 20) -> DataFrame:
    """The best of the rows that have a reason against them."""
    return rows.where(F.col(reason).isNotNull()).withColumn("rank_score", score).orderBy(F.desc("rank_score"), *order).limit(most)
