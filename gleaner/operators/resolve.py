"""Resolution of attributes from several pieces of evidence: precedence, claims, aliases, coalescing cascades."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import fold, term_regex
from gleaner.functions.urls import alias, host_suffixes
from gleaner.operators.sizes import dimension, small


def evidence(value: Column, precedence: int, position: Column | int = 0, field: str = "", method: str = "", eligible: Column | bool = True) -> Column:
    """A piece of evidence; lower precedence wins, then the order of gathering, then the position."""
    position = F.lit(position) if isinstance(position, int) else position
    eligible = F.lit(eligible) if isinstance(eligible, bool) else eligible
    return F.struct(F.lit(precedence).alias("precedence"), position.cast("int").alias("position"), value.alias("value"), F.lit(field).alias("field"), F.lit(method).alias("method"), F.coalesce(eligible, F.lit(False)).alias("eligible"))


def resolve(pieces: list[Column], most: int = 30, conflicts: int = 12) -> Column:
    """``struct(winner, conflicts)``: the least eligible piece with a value, by (precedence, order, position), and up to ``conflicts`` others of another value."""
    numbered = [F.when(p["value"].isNotNull(), F.struct(p["precedence"].alias("precedence"), F.lit(i).alias("ord"), p["position"].alias("position"), p["value"].alias("value"), p["field"].alias("field"), p["method"].alias("method"), p["eligible"].alias("eligible"))) for i, p in enumerate(pieces)]
    held = F.slice(F.array_compact(F.array(*numbered)), 1, most)
    winner = F.array_min(F.filter(held, lambda p: p["eligible"]))
    return F.struct(winner.alias("winner"), F.slice(F.filter(held, lambda p: p["value"] != winner["value"]), 1, conflicts).alias("conflicts"))


def claim(gate: str, category: str, dominance: int, holds: Column) -> Column:
    return F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(dominance).alias("dominance"), F.lit(category).alias("category"), F.lit(gate).alias("gate")))


def strongest_claim(claims: list[Column], otherwise: str = "excluded") -> Column:
    """``struct(category, gate, rejected)``: the claim of most dominance, and the losers' other categories."""
    held = F.array_compact(F.array(*claims))
    best = F.array_max(held)
    return F.struct(
        F.coalesce(best["category"], F.lit(otherwise)).alias("category"),
        best["gate"].alias("gate"),
        F.transform(F.filter(F.array_sort(held), lambda c: c["category"] != best["category"]), lambda c: c["category"]).alias("rejected"),
    )


def longest_alias(texts: DataFrame, text: str, aliases: DataFrame) -> DataFrame:
    """Left join with ``aliases(alias, name)``: the name of the longest alias that the folded text has.

    ``aliases`` is a dimension; it becomes one array literal of the plan, not a join of every text with every alias.
    """
    rows = sorted((r["alias"].lower(), r["name"]) for r in dimension(aliases.select("alias", "name")).collect())
    pairs = F.array(*[F.struct(F.lit(len(a)).alias("n"), F.lit(a).alias("alias"), F.lit(n).alias("name")) for a, n in rows])
    found = F.array_max(F.filter(pairs, lambda p: F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), p["alias"])))
    return texts.withColumn("alias", found["alias"]).withColumn("name", found["name"])


def text_region(text: Column, tiers: list[list[tuple[str, str]]]) -> Column:
    """The region of the first entry, tier by tier in the order given, whose term the folded text has."""
    out = F
    folded = F.lower(F.coalesce(text, F.lit("")))
    for tier in tiers:
        for term, region in tier:
            out = out.when(F.contains(folded, F.lit(term)), F.lit(region))
    return out.otherwise(None)


def evidence_class(snippet_size: Column, article_size: Column, least: int = 120) -> Column:
    """``struct(provenance, richness)`` of what is known of a text, from the lengths of its trimmed snippet and article: both, one of them, or none.

    Lengths, not texts, so that what is joined for it is narrow.
    """
    has_article = F.coalesce(article_size >= least, F.lit(False))
    has_snippet = F.coalesce(snippet_size > 0, F.lit(False))
    provenance = F.when(has_article & has_snippet, "article_and_snippet").when(has_article, "article").when(has_snippet, "snippet").otherwise("none")
    richness = F.when(has_article, "rich").when(has_snippet & (snippet_size >= least), "moderate").when(has_snippet, "thin").otherwise("empty")
    return F.struct(provenance.alias("provenance"), richness.alias("richness"))


def token_validity(title_tokens: Column, text_tokens: Column, text: Column, least: int = 120) -> Column:
    """Why a fetched text doesn't count for a title, or ``valid``: too short, no tokens, or too few of them in it (one of up to two, else two)."""
    shared = F.size(F.array_intersect(title_tokens, text_tokens))
    need = F.when(F.size(title_tokens) <= 2, 1).otherwise(2)
    return F.when(F.coalesce(F.length(text), F.lit(0)) < least, "short").when(F.size(title_tokens) == 0, "no_title_tokens").when(shared < need, "title_mismatch").otherwise("valid")


def multi_label(fields: dict[str, Column], labels: dict[str, list[str]], negators: list[str], per_label: int = 6, most: int = 16) -> Column:
    """The labels of a taxonomy with the fields and terms that speak for them, at most ``per_label`` each and ``most`` in all."""
    from gleaner.functions.text import positive_hits

    found = [F.struct(F.lit(label).alias("label"), positive_hits(fields, terms, negators, per_label).alias("hits")) for label, terms in labels.items()]
    return F.slice(F.filter(F.array(*found), lambda f: F.size(f["hits"]) > 0), 1, most)


def attach_once(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Left join in which each right row is used once: the k-th left row of a key meets the k-th right row of it."""
    from pyspark.sql import Window

    window = Window.partitionBy(*keys).orderBy(order)
    a, b = left.withColumn("_k", F.row_number().over(window)), right.withColumn("_k", F.row_number().over(window)).drop(order)
    return a.join(b, [*keys, "_k"], "left").drop("_k")


def roll_up(rows: DataFrame, region: str, members: DataFrame) -> DataFrame:
    """Rows whose region is selected or part of a selected one: a semi-join with ``members(region)``, a dimension."""
    return rows.join(small(members.select(F.col("region").alias("_r")).distinct()), F.col(region) == F.col("_r"), "left_semi")


def pick_publication(values: list[tuple[str, Column]]) -> Column:
    """``struct(value, origin, conflicts)``: the first date that is known, where it is from, and the names of others that differ."""
    value = F.coalesce(*[v for _, v in values])
    origin = F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for n, v in values])
    return F.struct(value.alias("value"), origin.alias("origin"), F.array_compact(F.array(*[F.when(v != value, F.lit(n)) for n, v in values])).alias("conflicts"))


def correct_labels(labels: Column, add: list[tuple[Column, str]], remove: list[tuple[Column, str]]) -> Column:
    """A set of labels after rules that add one and rules that take one away, in this order, sorted."""
    out = labels
    for condition, label in add:
        out = F.when(F.coalesce(condition, F.lit(False)), F.array_union(out, F.array(F.lit(label)))).otherwise(out)
    for condition, label in remove:
        out = F.when(F.coalesce(condition, F.lit(False)), F.array_remove(out, label)).otherwise(out)
    return F.array_sort(out)


def accept_title(ratio: Column, exact: Column, truncated: Column, n_tokens: Column, is_prefix: Column, agrees: Column, least: float = 0.93) -> Column:
    """An exact or near title, or a truncated one of four words or more that the other begins with; the rest of the metadata must agree."""
    return F.coalesce((exact | (ratio >= least) | (truncated & (n_tokens >= 4) & is_prefix)) & agrees, F.lit(False))


def apply_article(article: Column, valid: Column, most: int = 6000, least: int = 120) -> Column:
    """The article's text cut to ``most`` characters, if it is valid and long enough; else null."""
    return F.when(F.coalesce(valid, F.lit(False)) & (F.length(article) >= least), F.substring(article, 1, most))


def located(text: Column | str, places: dict[str, list[str]], cues: list[tuple[str, list[str]]], distance: int = 45) -> Column:
    """``array<struct(region, method)>`` of regions one of whose names has a cue within ``distance`` characters, such as of a factory: the first cue that any of its names has. Evidence of where things are made or sold, never of where they run."""
    t = fold(text)

    def found(name: str, names: list[str]) -> Column:
        near = lambda terms: t.rlike(rf"(?s)(?:{'|'.join(map(re.escape, terms))}).{{0,{distance}}}(?:{term_regex(names, 'token')})|(?:{term_regex(names, 'token')}).{{0,{distance}}}(?:{'|'.join(map(re.escape, terms))})")
        method = F.coalesce(F.lit(None).cast("string"), *[F.when(near(terms), F.lit(m)) for m, terms in cues])
        return F.when(method.isNotNull(), F.struct(F.lit(name).alias("region"), method.alias("method")))

    return F.array_compact(F.array(*[found(n, names) for n, names in places.items()]))


def write_back(current: Column, found: Column, method: Column, asked: Column, names: dict[str, str], vague: list[str], fallbacks: list[str], unknown: str = "unknown") -> Column:
    """``struct(region, conflict)``: what was found replaces what a row has, nothing found leaves it unknown, aliases take their name; a conflict is a region other than the one that was asked for, unless that is vague or the region was only taken from the question."""
    given = F.nullif(F.trim(F.coalesce(current, F.lit(""))), F.lit(""))
    region = F.when(found.isNull() & (method == "unresolved"), F.lit(unknown)).otherwise(F.coalesce(found, given, F.lit(unknown)))
    region = alias(region, names)
    meant = F.coalesce(asked, F.lit(""))
    conflict = (meant != "") & ~meant.isin(*vague) & ~F.coalesce(method.isin(*fallbacks), F.lit(False)) & (region != meant)
    return F.struct(region.alias("region"), conflict.alias("conflict"))


def source_label(source: Column, host: Column, labels: dict[str, str], proxies: list[str], generic: list[str], official: Column, suffix: str = " (official)", unknown: str = "unknown source") -> Column:
    """What a source is called: by the longest domain that has a label, else its own name, marked if official, else its host; proxies have neither."""
    suffixes = F.transform(host_suffixes(F.coalesce(host, F.lit(""))), lambda h: F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[h])
    known = F.element_at(F.filter(suffixes, lambda x: x.isNotNull()), 1) if labels else F.lit(None).cast("string")
    name = F.nullif(F.trim(F.coalesce(source, F.lit(""))), F.lit(""))
    at = F.when((F.coalesce(host, F.lit("")) != "") & ~host.isin(*proxies), host)
    own = F.when(name.isNotNull() & ~name.isin(*generic), F.when(official & ~name.contains(suffix.strip()), F.concat(name, F.lit(suffix))).otherwise(name))
    return F.coalesce(F.when(F.size(F.filter(suffixes, lambda x: x.isNotNull())) > 0, known), own, at, F.lit(unknown))


def pick_by_provider(provider: Column, priorities: dict[str, list[str]], values: dict[str, Column], otherwise: list[str]) -> Column:
    """``pick_publication`` in the order of the row's provider."""
    of = lambda names: pick_publication([(n, values[n]) for n in names])
    return F.coalesce(*[F.when(provider == p, of(names)) for p, names in priorities.items()], of(otherwise))
