"""Verdicts on reports: checks of every block, and of the report, reduced to what is to be done.

A check that fails has a level.  ``repair``: the record has what is right, and
overwrites it.  ``retry``: the report is to be written again.  ``hold``: writing
it again mends nothing, as what is lacking isn't in the record.  ``block``: the
judge itself has failed, so nothing may be written again on its word.  A
report's verdict follows from the levels of all that failed: ``ok`` without
any, ``repairable`` where all can be repaired, ``fail`` where something blocks
or nothing can be retried, else ``retry``.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("repair", "retry", "hold", "block")
ISSUE = "struct<name:string,level:string>"


class Check(NamedTuple):
    name: str
    failed: Column
    level: str = "retry"


def issues(checks: Iterable[Check]) -> Column:
    """``array<struct(name, level)>`` of the checks that fail, in their order; a null condition doesn't."""
    checks = list(checks)
    if bad := [c.name for c in checks if c.level not in LEVELS]:
        raise ValueError(f"no such level: {bad}")
    return F.array_compact(F.array(F.lit(None).cast(ISSUE), *[F.when(c.failed, F.struct(F.lit(c.name).alias("name"), F.lit(c.level).alias("level"))) for c in checks]))


def verdict(has_any: Column, repair_only: Column, blocked: Column, retry: Column) -> Column:
    return F.when(~has_any, "ok").when(repair_only, "repairable").when(blocked | ~retry, "fail").otherwise("retry")


def judge(blocks: DataFrame, report: str, pos: str, of_block: Iterable[Check], of_report: DataFrame | None = None) -> DataFrame:
    """Per report ``verdict``, ``n_issues``, ``n_failed_blocks``, ``first_block``, ``first_issue`` and ``counts``, the failed checks with their numbers.

    ``of_report`` has a row ``report, name, level`` for each failed check of a
    whole report, such as a section that isn't there; a report may be known by
    it alone.  ``first_block`` is the first block with an issue, ``first_issue``
    its first one (that of the report by name, where no block has one).  Levels
    are added up in each task before reports meet, and a report's issues are
    counts by name, however many blocks it has.
    """
    judged = blocks.select(F.col(report).alias("_report"), F.col(pos).cast("long").alias("_pos"), issues(of_block).alias("_issues"))
    of_blocks = judged.select("_report", "_pos", F.posexplode_outer("_issues").alias("_place", "_issue")).select("_report", "_pos", "_place", "_issue.name", "_issue.level")
    whole = of_report.select(F.col(report).alias("_report"), F.lit(None).cast("long").alias("_pos"), F.lit(None).cast("int").alias("_place"), "name", "level") if of_report is not None else of_blocks.limit(0)
    each = of_blocks.unionByName(whole)
    by_name = each.groupBy("_report", "name", "level").agg(F.count("name").alias("n"), F.min(F.when(F.col("name").isNotNull() & F.col("_pos").isNotNull(), F.struct("_pos", "_place"))).alias("at"))
    known, at_level = F.col("name").isNotNull(), lambda level: F.coalesce(F.bool_or(F.col("level") == level), F.lit(False))
    one = by_name.groupBy("_report").agg(
        F.bool_or(known).alias("any"), at_level("repair").alias("repair"), at_level("retry").alias("retry"), at_level("hold").alias("hold"), at_level("block").alias("block"), F.sum("n").alias("n_issues"),
        F.min(F.when(known, F.struct(F.col("at").isNull().alias("late"), "at", "name"))).alias("first"), F.map_from_entries(F.array_sort(F.collect_list(F.when(known, F.struct("name", "n"))))).alias("counts"),
    )
    failed = judged.groupBy(F.col("_report").alias("_r")).agg(F.count_if(F.size("_issues") > 0).alias("n_failed_blocks"))
    met = one.join(failed, F.col("_report").eqNullSafe(F.col("_r")), "left")
    said = verdict(F.col("any"), F.col("repair") & ~F.col("retry") & ~F.col("hold") & ~F.col("block"), F.col("block"), F.col("retry"))
    return met.select(F.col("_report").alias(report), said.alias("verdict"), "n_issues", F.coalesce("n_failed_blocks", F.lit(0).cast("long")).alias("n_failed_blocks"), F.col("first.at._pos").alias("first_block"), F.col("first.name").alias("first_issue"), "counts")
