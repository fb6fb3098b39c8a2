"""Funnels, status tables, streaks and change attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enabled_key_counts(rows: DataFrame, flags: str, group: list[str]) -> DataFrame:
    """Rows by group and by each key of a map that is true."""
    return rows.select(*group, F.explode(flags).alias("key", "on")).where("on").groupBy(*group, "key").agg(F.count("*").alias("n"))


def list_counts(rows: DataFrame, items: str, group: list[str]) -> DataFrame:
    return rows.select(*group, F.explode(items).alias("item")).groupBy(*group, "item").agg(F.count("*").alias("n"))


def status_pivot(rows: DataFrame, group: list[str], status: str, values: list[str]) -> DataFrame:
    """Rows by group, a column for each status, 0 where there are none."""
    return rows.groupBy(*group).agg(*[F.count_if(F.col(status) == v).alias(v) for v in values])


def months_with_gaps(rows: DataFrame, date: Column, first: str, last: str) -> DataFrame:
    """``month, n`` of every calendar month from ``first`` to ``last``."""
    spark = rows.sparkSession
    calendar = spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}', interval 1 month)) AS month")
    counts = rows.groupBy(F.trunc(date, "MM").alias("month")).agg(F.count("*").alias("n"))
    return calendar.join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def streaks(rows: DataFrame, group: list[str], order: str, ordinal: Column, holds: Column) -> DataFrame:
    """Runs of consecutive ordinals for which the condition holds: ``start, length``."""
    window = Window.partitionBy(*group).orderBy(order)
    island = rows.where(holds).withColumn("_ord", ordinal).withColumn("_isl", F.col("_ord") - F.row_number().over(window))
    return island.groupBy(*group, "_isl").agg(F.min(order).alias("start"), F.count("*").alias("length")).drop("_isl")


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """The share rounded, null for an empty whole."""
    return F.round(F.try_divide(part, whole), digits)


def variant_metrics(rows: DataFrame, variant: str, relevant: Column, classifiable: Column, empty: Column, duplicate: Column, least: int = 10, least_classifiable: int = 5) -> DataFrame:
    """Precision over what is classifiable, contamination, rates of empty and duplicate rows, and whether the sample is low."""
    n, c = F.count("*"), F.count_if(classifiable)
    return rows.groupBy(variant).agg(
        n.alias("n"),
        share(F.count_if(classifiable & relevant), c).alias("precision"),
        share(F.count_if(classifiable & ~relevant), c).alias("contamination"),
        share(F.count_if(empty), n).alias("empty_rate"),
        share(F.count_if(duplicate), n).alias("duplicate_rate"),
        ((n < least) | (c < least_classifiable)).alias("low_sample"),
    )


def gate_changes(before: Column, after: Column) -> Column:
    """``gained:`` and ``lost:`` gates between two maps of booleans, sorted."""
    on = lambda m: F.map_keys(F.map_filter(m, lambda k, v: v))
    gained = F.transform(F.array_except(on(after), on(before)), lambda g: F.concat(F.lit("gained:"), g))
    lost = F.transform(F.array_except(on(before), on(after)), lambda g: F.concat(F.lit("lost:"), g))
    return F.array_sort(F.concat(gained, lost))


def grouping_summary(rows: DataFrame, sets: list[list[str]], measures: list[Column]) -> DataFrame:
    """Counts by several groupings in one pass: ``dimension`` names the grouping, ``value`` its values joined."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(F.grouping_id().alias("_g"), *measures)
    # a column's bit is set where it isn't part of the grouping
    absent = {i: c for i, c in enumerate(reversed(names))}
    label = F.concat_ws("+", *[F.when((F.col("_g").bitwiseAND(1 << i)) == 0, F.lit(c)) for i, c in sorted(absent.items(), reverse=True)])
    value = F.concat_ws("+", *[F.when((F.col("_g").bitwiseAND(1 << i)) == 0, F.coalesce(F.col(c).cast("string"), F.lit("null"))) for i, c in sorted(absent.items(), reverse=True)])
    return grouped.withColumn("dimension", label).withColumn("value", value).drop("_g", *names)


def source_health(rows: DataFrame, source: str, outcome: Column, fallback: Column) -> DataFrame:
    """Per source its runs by outcome, each run in one bucket, and over them those that used a fallback."""
    o = outcome
    buckets = {n: F.count_if(o == n) for n in ("ok", "empty", "error")}
    return rows.groupBy(source).agg(*[c.alias(n) for n, c in buckets.items()], F.count_if(~o.isin("ok", "empty", "error")).alias("other"), F.count_if(fallback).alias("fallback"))


def recent_share(rows: DataFrame, group: list[str], date: Column, today: Column, days: int = 60) -> DataFrame:
    """``n, n_recent, share`` of each group: rows of the latest ``days`` before ``today``, of those with a date."""
    dated = rows.where(date.isNotNull())
    recent = F.count_if(date > F.date_sub(today, days))
    return dated.groupBy(*group).agg(F.count("*").alias("n"), recent.alias("n_recent"), share(recent, F.count("*")).alias("share"))
