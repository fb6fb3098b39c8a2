"""Gates: predicates that tell every reason why a row fails, or the first one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truth(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def failures(checks: list[tuple[str, Column]]) -> Column:
    """The names of all checks that don't hold (null is no), in their order."""
    return F.array_compact(F.array(*[F.when(~truth(ok), F.lit(name)) for name, ok in checks]))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; null when none does, which means keep."""
    out = F
    for name, bad in rules:
        out = out.when(truth(bad), F.lit(name))
    return out.otherwise(None)


def gated(df: DataFrame, checks: list[tuple[str, Column]], failed: str = "failures", passed: str = "passed") -> DataFrame:
    return df.withColumn(failed, failures(checks)).withColumn(passed, F.size(failed) == 0)


def matrix(gates: dict[str, Column]) -> Column:
    """``map(gate, holds)``."""
    return F.map_from_arrays(F.array(*[F.lit(n) for n in gates]), F.array(*[truth(c) for c in gates.values()]))


def three_state(report: Column, watch: Column) -> Column:
    return F.when(truth(report), "report_eligible").when(truth(watch), "watchlist").otherwise("rejected")


def contract(required: list[str], rules: list[tuple[str, Column]] | None = None) -> Column:
    """Violations of an entry contract: ``missing:<column>`` for nulls and empty texts, then the names of broken rules."""
    present = [(f"missing:{c}", F.col(c).isNotNull() & (F.col(c).cast("string") != "")) for c in required]
    return failures([*present, *(rules or [])])


def reason_counts(df: DataFrame, reason: str, kept: str = "kept") -> DataFrame:
    """The funnel: rows by reason, ``kept`` for those without one."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit(kept)).alias(reason)).agg(F.count("*").alias("n"))


def beyond_title(evidence_tokens: Column, title_tokens: Column) -> Column:
    """The evidence has tokens that its title hasn't."""
    return F.size(F.array_except(evidence_tokens, title_tokens)) > 0
