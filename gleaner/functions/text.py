"""Text functions on columns: term matching, normalisation and extraction.

Terms are data.  A rule pack is a list of terms; it is compiled once, on the
driver, to one regular expression, so a whole pack costs one pass over a text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Which terms match only between characters that are no ASCII letters or digits; all others match anywhere.
BOUNDED = {
    "phrase": lambda t: re.fullmatch(r"[a-z0-9][a-z0-9\s/&.\-]*", t),
    "token": lambda t: re.fullmatch(r"[a-z0-9.\-]+", t),
    "short": lambda t: t.isascii() and len(t) < 5,
    "tiny": lambda t: t.isascii() and len(t) <= 4,
    "never": lambda t: False,
}
CLAUSE_ENDS = ".!?;:。！？；：\n"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(text: Column | str) -> Column:
    """Lower case with ß as ss; null is empty."""
    return F.replace(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit("ß"), F.lit("ss"))


def term_regex(terms: Iterable[str], mode: str = "phrase") -> str:
    """One expression for all terms, folded; longer terms first."""
    ordered = sorted({t.casefold() for t in terms if t}, key=lambda t: (-len(t), t))
    if ordered and all(BOUNDED[mode](t) for t in ordered):  # what stands before is looked at once for all
        return rf"(?<![a-z0-9])(?:{'|'.join(map(re.escape, ordered))})(?![a-z0-9])"
    return "|".join(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])" if BOUNDED[mode](t) else re.escape(t) for t in ordered) or "(?!)"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it; a plain column would be put in at each place."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _words(terms: Iterable[str]) -> list[str]:
    return sorted({t.casefold() for t in terms if re.fullmatch("[a-z0-9]+", t.casefold())})


def known_words(folded: Column, terms: Iterable[str]) -> Column:
    """Those of the terms that are single words and that a folded text has, found in one pass over it."""
    words = F.array(*[F.lit(w) for w in _words(terms)]).cast("array<string>")
    return F.array_intersect(F.split(folded, "[^a-z0-9]+"), words)


def has_term(folded: Column, known: Column, terms: Iterable[str]) -> Column:
    """``contains_any`` of a folded text whose ``known_words`` are at hand: only terms of several words are looked for in the text."""
    terms = list(terms)
    words, others = _words(terms), [t for t in terms if t and not re.fullmatch("[a-z0-9]+", t.casefold())]
    tests = [F.arrays_overlap(known, F.array(*[F.lit(w) for w in words]))] if words else []
    tests += [folded.rlike(term_regex(others))] if others else []
    return reduce(lambda a, b: a | b, tests, F.lit(False)) if len(tests) != 1 else tests[0]


def contains_any(text: Column | str, terms: Iterable[str], mode: str = "phrase") -> Column:
    """Whether a folded text has any of the terms; false for null."""
    return fold(text).rlike(term_regex(terms, mode))


def term_count(text: Column | str, terms: Iterable[str], mode: str = "phrase") -> Column:
    return F.regexp_count(fold(text), F.lit(term_regex(terms, mode)))


def clauses(text: Column | str) -> Column:
    return F.split(fold(text), f"[{CLAUSE_ENDS}]")


def contains_positive(text: Column | str, terms: Iterable[str], negators: Iterable[str], mode: str = "phrase") -> Column:
    """Whether some clause has a term with no negator before it."""
    term, negator = term_regex(terms, mode), term_regex(negators, mode)
    # a clause's first term has the shortest prefix, so it is the one that can be free of negators
    return F.exists(clauses(text), lambda c: c.rlike(term) & ~F.element_at(F.split(c, term, 2), 1).rlike(negator))


def positive_hits(fields: dict[str, Column], terms: Iterable[str], negators: Iterable[str], most: int, mode: str = "phrase") -> Column:
    """``struct(field, term)`` of each field and term found un-negated, at most ``most``."""
    hits = [F.when(contains_positive(c, [t], negators, mode), F.struct(F.lit(name).alias("field"), F.lit(t).alias("term"))) for name, c in fields.items() for t in terms]
    return F.slice(F.array_compact(F.array(*hits)), 1, most)


def first_span(text: Column | str, terms: Iterable[str], mode: str = "token") -> Column:
    """``struct(start, stop)`` of the first match, start from 0; null without one."""
    pattern = term_regex(terms, mode)
    at = F.length(F.element_at(F.split(fold(text), pattern, 2), 1))
    found = F.regexp_extract(fold(text), f"({pattern})", 1)
    return F.when(fold(text).rlike(pattern), F.struct(at.alias("start"), (at + F.length(found)).alias("stop")))


def normalize_title(text: Column | str) -> Column:
    """Folded, every run of other than letters, digits and _ a space."""
    return F.trim(F.regexp_replace(fold(text), r"(?U)[^\w]+", " "))


def slug(text: Column | str) -> Column:
    """Unquoted and folded, & as and; letters, digits and Han characters stay."""
    plain = F.coalesce(F.try_url_decode(F.replace(_col(text), F.lit("+"), F.lit("%2B"))), _col(text), F.lit(""))
    return F.regexp_replace(F.replace(fold(plain), F.lit("&"), F.lit("and")), r"[^a-z0-9\x{3400}-\x{9FFF}]", "")


def clean_text(text: Column | str) -> Column:
    """Without tags, white space collapsed."""
    bare = F.replace(F.regexp_replace(F.coalesce(_col(text), F.lit("")), "<[^>]+>", " "), F.lit("&nbsp;"), F.lit(" "))
    return F.trim(F.regexp_replace(bare, r"[\s\x{00A0}]+", " "))


def shorten(text: Column, most: int) -> Column:
    """At most ``most`` characters; what is cut ends in an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def compact_words(text: Column, most: int) -> Column:
    """The longest beginning of whole words that has at most ``most`` characters."""
    return F.when(F.length(text) <= most, text).otherwise(F.rtrim(F.regexp_extract(text, rf"(?s)^(.{{0,{most}}})(?!\S)", 1)))


def strip_noise(text: Column | str, patterns: Iterable[str]) -> Column:
    out = F.coalesce(_col(text), F.lit(""))
    for p in patterns:
        out = F.regexp_replace(out, p, " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def wordish_count(text: Column | str) -> Column:
    """Runs of Latin letters and digits, and single Han characters."""
    return F.regexp_count(F.coalesce(_col(text), F.lit("")), F.lit(r"[A-Za-z0-9]+|[\x{4E00}-\x{9FFF}]"))


def tags(text: Column | str, patterns: dict[str, str]) -> Column:
    """The names of the patterns that a folded text matches, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(fold(text).rlike(p), F.lit(name)) for name, p in patterns.items()])))


def fragments(text: Column | str) -> Column:
    """Sentences, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(_col(text), F.lit("")), r"[.!?。！？\n]+"), F.trim), lambda s: s != "")


def any_fragment(text: Column | str, *groups: Iterable[str]) -> Column:
    """Whether one sentence has a term of every group."""
    expressions = [term_regex(g) for g in groups]

    def all_in(s: Column) -> Column:
        ok = F.lit(True)
        for e in expressions:
            ok = ok & fold(s).rlike(e)
        return ok

    return F.exists(fragments(text), all_in)


def token_set(text: Column | str, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(fold(text), F.lit(f"({pattern})"), F.lit(1))))


def conflicting(a: Column, b: Column) -> Column:
    """Both sets have members and share none."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def meaningful_tokens(text: Column | str, stopwords: Iterable[str], least: int = 3) -> Column:
    """Distinct folded words of at least ``least`` letters or digits that are no stopwords, sorted."""
    stop = F.array(*[F.lit(w) for w in sorted(stopwords)]) if stopwords else F.expr("cast(array() as array<string>)")
    words = F.filter(F.split(fold(text), r"(?U)[^\w]+"), lambda w: F.length(w) >= least)
    return F.array_sort(F.array_except(F.array_distinct(words), stop))


def injuries(text: Column | str, patterns: Iterable[str], many: Iterable[str] = (), vague: tuple[str, int, int] = ("14", 14, 12)) -> Column:
    """How many were hurt, by the first of the patterns that applies (its first group); null without any.

    A text that speaks of many without a number has the first or the second
    number of ``vague``, as it has the mark there or not.
    """
    mark, marked, other = vague

    def said(t: Column) -> Column:
        numbers = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")).cast("int") for p in patterns]
        unsaid = F.when(t.contains(mark), marked).otherwise(other)
        return F.coalesce(F.lit(None).cast("int"), *numbers, F.when(t.rlike("|".join(map(re.escape, many)) or "(?!)"), unsaid))

    return once(fold(text), said)


def near(text: Column | str, terms: Iterable[str], pattern: str, distance: int = 80) -> Column:
    """Whether the pattern occurs within ``distance`` characters of a term."""
    t = term_regex(terms)
    return fold(text).rlike(rf"(?s)(?:{t}).{{0,{distance}}}(?:{pattern})|(?:{pattern}).{{0,{distance}}}(?:{t})")


def has_script(text: Column | str, script: str) -> Column:
    return F.coalesce(_col(text), F.lit("")).rlike(rf"\p{{Is{script}}}")


def loose_json(text: Column | str) -> Column:
    """The JSON in a model's answer: that of a fenced block, else from the first brace to the last; null if neither parses."""
    t = F.coalesce(_col(text), F.lit(""))
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.coalesce(*[F.when(F.try_parse_json(c).isNotNull(), c) for c in (fenced, braces)])


def doi(text: Column | str) -> Column:
    """The first DOI, in lower case, without punctuation at its end; null without one."""
    return F.nullif(F.rtrim(F.regexp_extract(F.lower(F.coalesce(_col(text), F.lit(""))), r"(10\.\d{4,9}/[^\s\"<>]+)", 1), F.lit(".,;)]")), F.lit(""))


def standard_id(text: Column | str, bodies: Iterable[str]) -> Column:
    """The first identifier such as ``ABC 1234-5`` of one of the bodies, single-spaced; null without one. A number of more than six digits is none, and no number is cut."""
    found = F.regexp_extract(F.coalesce(_col(text), F.lit("")), rf"\b((?:{'|'.join(bodies)})[\s-]?\d{{2,6}}(?:-\d{{1,3}})*)(?!\d)", 1)
    return F.nullif(F.regexp_replace(found, r"\s+", " "), F.lit(""))


def standard_body(text: Column | str, identifier: Column, bodies: Iterable[tuple[str, str]]) -> Column:
    """Who issues a standard: the first of ``bodies`` (name, pattern of the folded text) that is named, else what its identifier begins with; null without either."""
    t = fold(text)
    named = [F.when(t.rlike(pattern), F.lit(name)) for name, pattern in bodies]
    return F.coalesce(*named, F.nullif(F.regexp_extract(F.coalesce(identifier, F.lit("")), r"^([^\s\d-]+)", 1), F.lit("")))


def update_kind(text: Column | str, kinds: Iterable[tuple[str, list[str]]]) -> Column:
    """The first kind of update (name, terms) that a text has a term of; null without one."""
    t = fold(text)
    return F.coalesce(F.lit(None).cast("string"), *[F.when(t.rlike(term_regex(terms)), F.lit(name)) for name, terms in kinds])


def edition_year(text: Column | str, words: Iterable[str], within: int = 14) -> Column:
    """The year 20xx that follows one of the words within so many other characters than digits; null without one."""
    found = F.regexp_extract(fold(text), rf"(?:{'|'.join(re.escape(w.casefold()) for w in words)})[^\d]{{0,{within}}}(20\d{{2}})", 1)
    return F.nullif(found, F.lit("")).cast("int")


def is_truncated(title: Column | str) -> Column:
    """Whether a title ends in an ellipsis."""
    return F.coalesce(_col(title), F.lit("")).rlike(r"(?:\.\.\.|[…﹍︙])\s*$")


def is_generic_title(title: Column | str, names: Iterable[str], words: Iterable[str], stopwords: Iterable[str], most: int = 3) -> Column:
    """Whether a title names no work: it has no meaningful word, is one of ``names``, or has at most ``most`` words, all of them of ``words``."""
    tokens, known = meaningful_tokens(title, stopwords), list(names)
    listed = normalize_title(title).isin(*known) if known else F.lit(False)
    common = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    return (F.size(tokens) == 0) | listed | ((F.size(tokens) <= most) & (F.size(F.array_except(tokens, common)) == 0))


def gate_view(title: Column, evidence: Column, source: Column, url: Column, patterns: dict[str, str]) -> Column:
    """What gates look at: title, evidence, source, the url and its path's words, and the tags that these match."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://[^/]+/([^?#]*)", 1), r"[-_/.]+", " ")
    base = F.concat_ws(" ", title, evidence, source, url, path)
    return F.concat_ws(" ", base, F.array_join(tags(base, patterns), " "))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def paraphrase(summary: Column | str, title: Column | str, low: float = 0.72, high: float = 0.999, least: int = 12, slack: int = 36) -> Column:
    """Whether a summary says little but its title: a ratio from ``low`` to below ``high`` of both without marks.

    Neither may be shorter than ``least`` characters, nor the summary longer
    than the title by more than ``slack``; only then is the ratio computed.
    """
    bare = lambda c: F.regexp_replace(fold(c), r"(?U)[\W_]+", "")
    s, t = bare(summary), bare(title)
    comparable = (F.length(t) >= least) & (F.length(s) >= least) & (F.length(s) <= F.length(t) + slack)
    ratio = similarity(F.when(comparable, t), F.when(comparable, s))
    return comparable & (ratio >= low) & (ratio < high)


def running_sums(numbers: Column) -> Column:
    """For each number of an array the sum of those before it, in blocks of the square root of their number: an array that grows is copied at each step, so no long one is grown."""
    wide = F.greatest(F.ceil(F.sqrt(F.size(numbers))).cast("int"), F.lit(1))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1)), wide), lambda i: F.slice(numbers, i, wide))

    def before(values: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(values, begin, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), before(totals, F.lit(0)).alias("start")), lambda z: before(z["block"], z["start"])))

    return once(parts, joined)


def spans(text: Column | str, terms: Iterable[str], mode: str = "token") -> Column:
    """``array<struct(start, stop)>`` of all matches that don't overlap, from the left, start from 0."""
    pattern, t = term_regex(terms, mode), fold(text)
    sizes = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: F.length(m))
    gaps = F.transform(F.split(t, pattern, -1), lambda g: F.length(g))
    pieces = F.filter(F.arrays_zip(gaps.alias("gap"), sizes.alias("size")), lambda p: p["size"].isNotNull())

    def placed(found: Column) -> Column:
        begins = running_sums(F.transform(found, lambda p: p["gap"] + p["size"]))
        return F.zip_with(found, begins, lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["size"]).alias("stop")))

    return once(pieces, placed)


def span_distance(a: Column, b: Column) -> Column:
    """The least number of characters between a span of ``a`` and one of ``b``, 0 where they overlap; null if either has none."""
    return F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.greatest(F.lit(0), y["start"] - x["stop"], x["start"] - y["stop"])))))
