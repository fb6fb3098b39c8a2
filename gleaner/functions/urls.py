"""URL functions on columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import _col, term_regex

# fixed values: parameters that tell of campaigns only
TRACKING = ("fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "ref", "spm")


def domain(url: Column | str) -> Column:
    """The authority in lower case without ``www.``; the port stays; empty without one."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(_col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), r"^www\.", "")


def path(url: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(_col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def host_matches(host: Column, parent: Column | str) -> Column:
    """The host is the domain or one below it."""
    parent = F.lit(parent) if isinstance(parent, str) else parent
    return (host == parent) | host.endswith(F.concat(F.lit("."), parent))


def host_suffixes(host: Column) -> Column:
    """The host and the domains above it, the longest first: keys by which a host meets domain rules in an equi-join."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def alias(value: Column, names: dict[str, str]) -> Column:
    """The value, or the name that it is an alias of."""
    if not names:
        return value
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(pairs[value], value)


def original_domain(href: Column, url: Column, query: Column, label: Column | None = None) -> Column:
    """The first that is known: the source's own domain, the url's, the query's ``site:``, a domain in the label."""
    site = F.regexp_extract(F.coalesce(query, F.lit("")), r"site:([A-Za-z0-9.\-]+)", 1)
    hints = [domain(href), domain(url), F.lower(site)]
    if label is not None:
        hints.append(F.regexp_extract(F.lower(F.coalesce(label, F.lit(""))), r"([a-z0-9\-]+(?:\.[a-z0-9\-]+)+)", 1))
    return F.coalesce(*[F.nullif(h, F.lit("")) for h in hints])


def reject_reason(url: Column | str, *, blocked_paths: Iterable[str], blocked_hosts: Iterable[str], blocked_suffixes: Iterable[str], low_value_hosts: Iterable[str] = (), allowed_hosts: Iterable[str] = ()) -> Column:
    """The first reason against a url, in a fixed order; null for a valid one."""
    u = F.trim(F.coalesce(_col(url), F.lit("")))
    host, at = domain(u), F.lower(path(u))
    of = lambda hosts: F.exists(host_suffixes(host), lambda h: h.isin(*hosts)) if hosts else F.lit(False)
    hosts, low, allowed = list(blocked_hosts), list(low_value_hosts), list(allowed_hosts)
    return (
        F.when(u == "", "empty")
        .when(u.startswith("/"), "relative")
        .when(~u.rlike(r"^(?i)https?://"), "scheme")
        .when(F.regexp_replace(at, "/", "") == "", "homepage")
        .when(at.rlike("|".join(blocked_paths) or "(?!)"), "blocked_path")
        .when(of(low), "low_value_host")
        .when(at.rlike(r"\.(?:" + ("|".join(blocked_suffixes) or "(?!)") + ")$"), "blocked_suffix")
        .when(of(hosts), "blocked_host")
        .when(~of(allowed) if allowed else F.lit(False), "not_allowed")
    )


def dedupe_url(url: Column | str) -> Column:
    """Without parameters, query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(_col(url), F.lit(""))), r"[;?#].*$", ""), "/+$", "")


def _decoded(part: Column) -> Column:
    """Without percent escapes, + as a space; as it is where an escape is broken."""
    return F.coalesce(F.try_url_decode(part), part)


def _encoded(part: Column) -> Column:
    """Percent escapes for all but letters, digits and ``_.-~``, + for spaces."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def hostname(url: Column | str) -> Column:
    """The host in lower case without user, port and ``www.``."""
    authority = F.regexp_extract(F.coalesce(_col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@|:\d*$", "")), r"^www\.", "")


def canonical_key(*urls: Column, tracking: Iterable[str] = TRACKING) -> Column:
    """The article's key from the first url with a web scheme: https, the host's name, the unquoted path with single slashes, / at least, and the query's non-empty values, sorted and encoded anew, without tracking; null without such a url."""
    url = F.coalesce(*[F.when(F.trim(u).rlike("^https?://"), F.trim(u)) for u in urls])
    place = F.regexp_replace(F.regexp_replace(_decoded(F.replace(path(url), F.lit("+"), F.lit("%2B"))), "/{2,}", "/"), "/$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    values = F.transform(F.filter(F.split(query, "&"), lambda p: p.rlike("=.")), lambda p: F.struct(_decoded(F.regexp_extract(p, "(?s)^([^=]*)=", 1)).alias("k"), _decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v")))
    held = F.array_sort(F.filter(values, lambda s: ~F.lower(s["k"]).startswith("utm_") & ~F.lower(s["k"]).isin(*tracking)))
    fields = F.array_join(F.transform(held, lambda s: F.concat(_encoded(s["k"]), F.lit("="), _encoded(s["v"]))), "&")
    return F.when(url.isNotNull(), F.concat(F.lit("https://"), hostname(url), F.when(place == "", "/").otherwise(place), F.when(fields != "", F.concat(F.lit("?"), fields)).otherwise("")))


def ladder(rules: Iterable[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds; null conditions don't."""
    out = F
    for condition, name in rules:
        out = out.when(F.coalesce(condition, F.lit(False)), F.lit(name))
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def page_kind(url: Column | str, title: Column | str, rules: list[tuple[str, str, list[str]]]) -> Column:
    """``rules``: name, pattern of the path, terms of the title; the first that either meets; a dated or numbered article otherwise."""
    at = F.lower(path(url))
    named = [(at.rlike(p) | (F.lower(F.coalesce(_col(title), F.lit(""))).rlike(term_regex(terms)) if terms else F.lit(False)), name) for name, p, terms in rules]
    return ladder([(F.regexp_replace(at, "/", "") == "", "home"), *named, (at.rlike(r"/\d{2,}(?:[./]|$)"), "article")], "unresolved")


def source_class(host: Column, classes: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The first class whose domains hold the host."""
    under = lambda domains: F.arrays_overlap(host_suffixes(host), F.array(*[F.lit(d) for d in domains]))
    return ladder([(under(domains), name) for name, domains in classes], otherwise)


def join_host_rules(pages: DataFrame, host: str, rules: DataFrame) -> DataFrame:
    """Left join with the rule ``rules(domain, ...)`` of the longest domain that holds the host; ``rules`` is a dimension of one row per domain."""
    matched = (
        pages.select(F.col(host).alias("_host")).distinct().withColumn("domain", F.explode(host_suffixes(F.col("_host")))).join(rules, "domain")
        .groupBy("_host").agg(F.max_by(F.struct(*rules.columns), F.length("domain")).alias("rule"))
    )
    return pages.join(matched, F.col(host) == F.col("_host"), "left").select(*pages.columns, "rule.*")


def source_tier(host: Column, rules: list[tuple[str, str, list[str]]], label: Column | None = None, labels: list[tuple[str, str, list[str]]] = (), otherwise: tuple[str, str] = ("C", "other")) -> Column:
    """``struct(tier, reason)``: of the first rule ``(tier, reason, domains)`` that holds the host, else of the first of ``labels`` (tier, reason, terms) that the source's label has."""
    named = lambda tier, reason: F.struct(F.lit(tier).alias("tier"), F.lit(reason).alias("reason"))
    under = [F.when(F.arrays_overlap(host_suffixes(F.coalesce(host, F.lit(""))), F.array(*[F.lit(d) for d in domains])), named(t, r)) for t, r, domains in rules]
    said = [F.when(F.lower(F.coalesce(label, F.lit(""))).rlike(term_regex(terms)), named(t, r)) for t, r, terms in labels] if label is not None else []
    return F.coalesce(*under, *said, named(*otherwise))
