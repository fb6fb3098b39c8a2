"""Date functions on columns: parsing chains, calendar buckets and recency policies."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import _col

RFC = r"(\d{1,2} [A-Z][a-z]{2} \d{4})"


def iso_date(text: Column) -> Column:
    """The date of a text that begins with yyyy-mm-dd."""
    return F.try_to_date(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")


def rfc_date(text: Column) -> Column:
    """The date of a mail header's form, whatever the weekday."""
    return F.try_to_date(F.regexp_extract(text, RFC, 1), "d MMM yyyy")


def loose_date(text: Column | str, unknown: Iterable[str] = ()) -> Column:
    """The first reading that applies; none for a text with a mark of an ``unknown`` date: yyyy-m-d or yyyy/m/d of this century between other characters than digits (null if it is no date), a mail date, an ISO date, a Chinese date, a year's first day."""
    t = F.coalesce(_col(text), F.lit(""))
    if marks := "|".join(re.escape(m) for m in unknown):
        t = F.when(t.rlike(marks), "").otherwise(t)
    numbers = F.regexp_extract(t, r"(?<!\d)(20\d{2}[-/]\d{1,2}[-/]\d{1,2})(?!\d)", 1)
    chinese = F.regexp_replace(F.regexp_extract(t, r"(\d{4}年\d{1,2}月\d{1,2}日)", 1), "[年月]", "-")
    year = F.regexp_extract(t, r"\b(20\d{2})\b", 1)
    return F.when(numbers != "", _numbers_date(numbers)).otherwise(
        F.coalesce(rfc_date(t), iso_date(t), F.try_to_date(F.regexp_replace(chinese, "日", ""), "yyyy-M-d"), F.try_to_date(F.when(year != "", F.concat(year, F.lit("-01-01"))), "yyyy-MM-dd"))
    )


def _numbers_date(numbers: Column) -> Column:
    return F.try_to_date(F.replace(numbers, F.lit("/"), F.lit("-")), "yyyy-M-d")


def path_date(*urls: Column | str) -> Column:
    """The first real date yyyy/mm/dd, else yyyy-mm-dd, between other characters than digits in the unquoted path of the first url that has one."""
    found = []
    for url in urls:
        raw = F.regexp_extract(F.coalesce(_col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
        path = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
        found += [_numbers_date(F.regexp_extract(path, rf"(?<!\d)(20\d{{2}}{mark}\d{{1,2}}{mark}\d{{1,2}})(?!\d)", 1)) for mark in "/-"]
    return F.coalesce(*found)


def publication_date(text: Column | str) -> Column:
    t = F.coalesce(_col(text), F.lit(""))
    return F.coalesce(iso_date(t), rfc_date(t))


def is_recent(date: Column, cutoff: Column, undated: bool) -> Column:
    """After the cutoff; ``undated`` is the policy for rows without a date: pass (open) or fail (closed)."""
    return F.coalesce(date > cutoff, F.lit(undated))


def in_period(date: Column, today: Column, lookback_days: int, future_days: int = 1) -> Column:
    """Not older than the lookback, held between 1 and 365 days, nor more than ``future_days`` ahead; fails for no date."""
    return F.coalesce(date.between(F.date_sub(today, max(1, min(365, lookback_days))), F.date_add(today, future_days)), F.lit(False))


def date_value(kinds: list[tuple[str, Column]]) -> Column:
    """``struct(value, kind)`` of the first kind that has a date."""
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("value"), F.lit(k).alias("kind"))) for k, c in kinds])


def quarter_label(date: Column) -> Column:
    return F.concat(F.year(date), F.lit("-Q"), F.quarter(date))


def previous_month(date: Column) -> Column:
    """``struct(first, last)`` day of the month before."""
    first = F.trunc(F.add_months(date, -1), "MM")
    return F.struct(first.alias("first"), F.last_day(first).alias("last"))


def quarter_buckets(periods: DataFrame, start: str, stop: str) -> DataFrame:
    """Rows of ``periods`` by calendar quarter: ``label, bucket_start, bucket_end`` of the half-open period [start, stop), clipped to it."""
    first = F.explode(F.sequence(F.trunc(F.col(start), "QUARTER"), F.date_sub(F.col(stop), 1), F.expr("interval 3 months")))
    q = periods.where(F.col(start) < F.col(stop)).withColumn("_q", first)
    return q.select(*periods.columns, quarter_label(F.col("_q")).alias("label"), F.greatest("_q", start).alias("bucket_start"), F.least(F.add_months("_q", 3), stop).alias("bucket_end"))


def verify(date: Column, bucket_start: Column, bucket_end: Column, conflict: Column | None = None) -> Column:
    """The status of a date against its half-open bucket."""
    out = F.when(bucket_start.isNull(), "not_applicable").when(date.isNull(), "missing_date")
    if conflict is not None:
        out = out.when(conflict, "conflicting_date_evidence")
    return out.when((date < bucket_start) | (date >= bucket_end), "out_of_window").otherwise("verified")


def verify_route(status: Column, date: Column, bucket: Column, routed: Column, route_start: Column, route_stop: Column, route_bucket: Column) -> Column:
    """The status of a date that its own bucket has verified against the route that found it: a route without a window, one that the date is out of, one of another bucket."""
    lacking = route_start.isNull() | route_stop.isNull()
    return (
        F.when((status != "verified") | ~F.coalesce(routed, F.lit(False)), status).when(lacking, "route_metadata_invalid")
        .when((date < route_start) | (date >= route_stop), "route_window_conflict").when(~route_bucket.eqNullSafe(bucket), "route_bucket_conflict").otherwise("verified")
    )
