"""Secrets in texts, sorted by how many repositories and owners share them.  DataFrame functions only.

Patterns propose spans; each candidate's hash is counted over the whole
corpus by distinct repositories and owners.  A value that many owners hold,
or that lies in many repositories whoever's they are, is a copied example; one
that a single owner holds in few repositories and that is varied enough to be
a key looks live.

Where matches begin is told by the lengths of what stands between them, summed
up in blocks of the square root of their number: a text of n hits takes
n ** 1.5 steps, so one of 100,000 is a matter of seconds.

Defined results: a null or empty text has no spans; null repositories and
owners count as one repository or owner each; repeated rows give repeated
results but count as one repository; an empty table gives no rows; of other
columns those that are asked for are carried along.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import lookup_join, numbered_columns, restored
from gleaner.scratch import materialize


class Kind(NamedTuple):
    name: str
    pattern: str
    #: The group that is the secret itself, and its least length (the whole match's where it is 0).
    group: int
    least: int
    #: Texts without any of these have no match (all texts may have one where there are none).
    marks: tuple[str, ...] = ()


BASE = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Kind("access", r"(AKIA[A-Z0-9]+)", 0, 18, ("AKIA",)),
    Kind("hex", r"([0-9a-f]{16,})", 0, 16),
)
#: Formats that services publish for their keys; none of them is a base kind.
MORE = (
    Kind("github", r"(gh[pousr]_[A-Za-z0-9]{36,})", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Kind("slack", r"(xox[abprs]-[A-Za-z0-9-]{10,})", 0, 15, ("xox",)),
    Kind("jwt", r"(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 0, 35, ("eyJ",)),
    Kind("google", r"(AIza[A-Za-z0-9_-]{35})", 0, 39, ("AIza",)),
    Kind("pem", r"(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)", 0, 30, ("PRIVATE KEY-----",)),
)
KINDS = BASE + MORE
#: A value that this many owners hold is a copied example; one owner's value with this many different characters looks live.
SHARED_OWNERS, SHARED_REPOSITORIES = 3, 20
LIVE_CHARACTERS = 8
COUNTS = ["n_live", "n_shared", "most_owners", "most_repositories"]

SPANS = "array<struct<start:int,rank:int,stop:int,kind:string,value:string>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(lengths: Column) -> Column:
    """For each number the sum of those before it, in blocks of the square root of their number."""
    wide = F.greatest(F.ceil(F.sqrt(F.size(lengths))).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), wide), lambda i: F.slice(lengths, i, wide))

    def sums(numbers: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
        return F.aggregate(numbers, begin, step, lambda s: s["out"])

    def joined(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), sums(whole, F.lit(0)).alias("start")), lambda z: sums(z["block"], z["start"])))

    return let(blocks, joined)


def has_kind(text: Column, kind: Kind) -> Column:
    marked = reduce(Column.__or__, (F.contains(text, F.lit(m)) for m in kind.marks)) if kind.marks else F.lit(True)
    return marked & text.rlike(kind.pattern)


def spans_of(text: Column, rank: int, kind: Kind) -> Column:
    """The spans of one kind: what stands between the matches, measured in code points, tells where they begin."""
    pattern = F.lit(kind.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(kind.group)) if kind.group else whole
    sizes = F.transform(whole, lambda w: F.length(w))
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda g: F.length(g))

    def located(p: Column) -> Column:
        # the text after the last match is the last gap, which has no size and no value
        each = F.zip_with(p["gap"], p["size"], lambda g, w: g + F.coalesce(w, F.lit(0)))
        return F.arrays_zip(let(each, running).alias("before"), p["gap"].alias("gap"), p["size"].alias("size"), p["value"].alias("value"))

    def span(p: Column) -> Column:
        start = p["before"] + p["gap"]
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + p["size"]).alias("stop"), F.lit(kind.name).alias("kind"), p["value"].alias("value"))

    pieces = let(F.struct(gaps.alias("gap"), sizes.alias("size"), value.alias("value")), located)
    found = F.transform(F.filter(pieces, lambda p: F.length(p["value"]) >= kind.least), span)
    return F.when(has_kind(text, kind), found).otherwise(F.expr(f"cast(array() as {SPANS})"))


def find_spans(docs: DataFrame, text: str = "text", out: str = "_spans") -> DataFrame:
    """``docs`` with the array ``out`` of all spans ordered by start, then kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(out, F.array_sort(F.concat(*[spans_of(t, r, k) for r, k in enumerate(KINDS)])))


def ownership(found: DataFrame) -> DataFrame:
    """``_value, n_repositories, n_owners`` of each candidate hash in ``_values, _repository, _owner``."""
    # an owner or repository counts once for a value: equal rows meet before the counts, so no value is hot
    once = found.select(F.explode("_values").alias("_value"), "_owner", "_repository").distinct()
    owners = once.groupBy("_value", "_owner").agg(F.count("*").alias("_n"))
    return owners.groupBy("_value").agg(F.sum("_n").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, repository: str, owner: str, carry: list[str]) -> DataFrame:
    """Of each row the columns ``carry``, ``_spans``, the numbers ``n_live``, ``n_shared`` of its distinct values that look live or are copied examples, and the most owners and repositories that one of its values has."""
    plain, place = numbered_columns(docs, [*carry, repository, owner, "text"])
    named = plain.select(*dict.fromkeys(place[c] for c in carry), F.col(place[repository]).alias("_repository"), F.col(place[owner]).alias("_owner"), F.col(place["text"]).alias("_text"))
    spans = find_spans(named, "_text").drop("_text").withColumn("_uid", F.monotonically_increasing_id())
    hashed = F.array_distinct(F.transform("_spans", lambda s: F.sha2(s["value"].cast("binary"), 256)))
    varied = F.transform(F.array_distinct(F.transform("_spans", lambda s: s["value"])), lambda v: F.struct(F.sha2(v.cast("binary"), 256).alias("h"), (F.size(F.array_distinct(F.split(v, ""))) >= LIVE_CHARACTERS).alias("v")))
    found = materialize(spans.withColumn("_values", hashed).withColumn("_varied", varied), "secrets")
    some = found.where(F.size("_values") > 0)
    shares = materialize(ownership(some), "owners")
    each = some.select("_uid", F.explode("_varied").alias("_e")).select("_uid", F.col("_e.h").alias("_h"), F.col("_e.v").alias("_v"))
    judged = lookup_join(each, shares, each["_h"] == shares["_value"])
    copied = (F.col("n_owners") >= SHARED_OWNERS) | (F.col("n_repositories") >= SHARED_REPOSITORIES)
    live = (F.col("n_owners") == 1) & ~copied & F.col("_v")
    per_row = judged.groupBy("_uid").agg(F.sum(live.cast("long")).alias("n_live"), F.sum(copied.cast("long")).alias("n_shared"), F.max("n_owners").alias("most_owners"), F.max("n_repositories").alias("most_repositories"))
    out = found.join(per_row, "_uid", "left")
    return out.select(*restored(place, carry, ["_spans", *COUNTS]), "_spans", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS])


def count_of(kind: Kind, spans: str = "_spans") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind.name)).cast("long")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


#: What is replaced of each kind: the value of an assignment of sufficient length, all of the others.
MASKS = {"assign": (BASE[0].pattern.rsplit("([A-Za", 1)[0], "[A-Za-z0-9+/_.=-]{12,}"), "access": ("", "AKIA[A-Z0-9]{14,}")}


def mask(docs: DataFrame, out: str = "text") -> DataFrame:
    """``docs`` with every secret value of the text replaced by ``<SECRET>``; what stands before an assigned value stays, as do values below the least length, and null texts."""
    text = F.col("text")
    for kind in KINDS:
        before, value = MASKS.get(kind.name, ("", kind.pattern))
        hidden = F.regexp_replace(text, f"({before}){value}", "$1<SECRET>")
        text = F.when(reduce(Column.__or__, (F.contains(text, F.lit(m)) for m in kind.marks)), hidden).otherwise(text) if kind.marks else hidden
    return docs.withColumn(out, text)
