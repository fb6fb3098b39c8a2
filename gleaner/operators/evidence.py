"""What counts as evidence for a title, and the cascade of places where it is looked for."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as texts
from gleaner.functions import urls
from gleaner.scratch import materialize


@dataclass(frozen=True)
class Shells:
    """What pages look like that are no articles: segments of their paths, and markers in their folded texts."""

    search_segments: tuple[str, ...] = ()
    index_segments: tuple[str, ...] = ()
    search_markers: tuple[str, ...] = ()
    index_markers: tuple[str, ...] = ()
    navigation_markers: tuple[str, ...] = ()
    stopwords: tuple[str, ...] = ()
    url_rules: dict = field(default_factory=lambda: {"blocked_paths": [], "blocked_hosts": [], "blocked_suffixes": []})


def _markers(folded: Column, markers: Iterable[str]) -> Column:
    return sum((F.when(folded.contains(m), 1).otherwise(0) for m in markers), F.lit(0))


def evidence_reason(title: Column, text: Column, url: Column, shells: Shells, least: int = 120, most: int = 6000) -> Column:
    """Why a fetched text is no evidence for a title, the first reason in order; null for evidence.

    ``insufficient_text``, ``missing_target_title`` (no word to look for),
    ``non_article_url``, ``search_results_page`` (by its path),
    ``search_results_shell`` and ``index_or_navigation_shell`` (two markers, or
    one where the title isn't met; the latter also by its path where it isn't),
    ``generic_navigation_boilerplate`` (four markers where it isn't) and
    ``target_title_mismatch``.  A title is met by one of its words if it has at
    most two, else by two.  No url is no reason.
    """
    known = F.coalesce(F.trim(url), F.lit("")) != ""
    segments = F.split(F.lower(urls.path(url)), "/")
    within = lambda names: known & F.coalesce(F.arrays_overlap(segments, F.array(*[F.lit(n) for n in names])), F.lit(False)) if names else F.lit(False)
    words = texts.meaningful_tokens(title, shells.stopwords)

    def seen(cleaned: Column) -> Column:
        return F.struct(F.length(cleaned).alias("size"), texts.fold(cleaned).alias("folded"), words.alias("words"))

    def held(s: Column) -> Column:
        enough = (s["size"] >= least) & (F.size(s["words"]) > 0)
        common = F.when(enough, F.size(F.array_intersect(s["words"], F.split(s["folded"], r"(?U)[^\w]+"))))
        marks = [_markers(s["folded"], m).alias(name) for name, m in (("search", shells.search_markers), ("index", shells.index_markers), ("navigation", shells.navigation_markers))]
        return F.struct(s["size"].alias("size"), F.size(s["words"]).alias("n"), (common >= F.when(F.size(s["words"]) <= 2, 1).otherwise(2)).alias("met"), *marks)

    def judged(h: Column) -> Column:
        met, shell = h["met"], lambda found: (found >= 2) | ((found >= 1) & ~h["met"])
        return (
            F.when(h["size"] < least, "insufficient_text").when(h["n"] == 0, "missing_target_title").when(known & urls.reject_reason(url, **shells.url_rules).isNotNull(), "non_article_url")
            .when(within(shells.search_segments), "search_results_page").when(shell(h["search"]), "search_results_shell").when(shell(h["index"]) | (~within(shells.search_segments) & within(shells.index_segments) & ~met), "index_or_navigation_shell")
            .when((h["navigation"] >= 4) & ~met, "generic_navigation_boilerplate").when(~met, "target_title_mismatch")
        )

    # a text is cleaned, folded and cut into words once, however many conditions look at it
    shortened = texts.once(texts.clean_text(text), lambda t: texts.shorten(t, most))
    return texts.once(texts.once(texts.once(shortened, seen), held), judged)


def cascade(wanted: DataFrame, key: str, title: str, places: list[tuple[str, DataFrame]], shells: Shells, **limits: int) -> tuple[DataFrame, list[DataFrame]]:
    """The first valid evidence for each row of ``wanted``, looked for in ``places`` (name, landed ``key, text, url``, one row per key) one after the other.

    Only rows that no earlier place satisfied are joined with the next.
    Returns ``key, place, text, reason`` (place and text null, and the last
    reason, where nothing is valid; ``not_found`` where nothing was there) and
    the tables of what was tried at each place.
    """
    left = materialize(wanted.select(F.col(key).alias("_k"), F.col(title).alias("_title"), F.lit("not_found").alias("_last")), "wanted")
    found, tried = None, []
    for name, landed in places:
        side = landed.select(F.col(key).alias("_s"), F.col("text").alias("_text"), F.col("url").alias("_url"))
        met = left.join(side, F.col("_k") == F.col("_s"), "left")
        there = F.coalesce(F.length("_text"), F.lit(0)) > 0
        judged = met.withColumn("_reason", F.when(there, evidence_reason(F.col("_title"), F.col("_text"), F.col("_url"), shells, **limits)).otherwise("not_there"))
        judged = materialize(judged.select("_k", "_title", "_last", "_text", "_reason"), "tried")
        tried.append(judged)
        good = judged.where(F.col("_reason").isNull()).select("_k", F.lit(name).alias("place"), F.col("_text").alias("text"), F.lit(None).cast("string").alias("reason"))
        found = good if found is None else found.unionByName(good)
        last = F.when(F.col("_reason") == "not_there", F.col("_last")).otherwise(F.col("_reason"))
        left = judged.where(F.col("_reason").isNotNull()).select("_k", "_title", last.alias("_last"))
    none = left.select("_k", F.lit(None).cast("string").alias("place"), F.lit(None).cast("string").alias("text"), F.col("_last").alias("reason"))
    return (none if found is None else found.unionByName(none)).withColumnRenamed("_k", key), tried
