"""Checks of generated reports against their records."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import loose_json
from gleaner.operators.sizes import small
from gleaner.scratch import materialize

MARKER = r"<!--\s*candidate_id:\s*(\d+)\s*-->"


def blocks(reports: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """One row for each marked block: ``pos, candidate_id, block``; what stands before the first marker is left out."""
    # cut before each marker, so no sign is needed that a text might have; what is put in front makes the first part one without a marker
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(F.col(text), F.lit(""))), f"(?={MARKER})")
    out = reports.select(*carry, F.posexplode(parts).alias("pos", "part")).where("pos > 0")
    return out.select(*carry, "pos", F.regexp_extract("part", f"^{MARKER}", 1).try_cast("long").alias("candidate_id"), F.regexp_replace(F.regexp_replace("part", f"^{MARKER}", ""), r"^\s+|\s+$", "").alias("block"))


def id_integrity(found: DataFrame, expected: DataFrame, group: list[str], key: str) -> DataFrame:
    """``missing``, ``unknown`` and ``duplicate`` keys of each group."""
    n = found.groupBy(*group, key).agg(F.count("*").alias("n"))
    want = expected.select(*group, key).distinct().withColumn("_want", F.lit(True))
    both = n.join(want, [*group, key], "full_outer")
    issue = F.when(F.col("n").isNull(), "missing").when(F.col("_want").isNull(), "unknown").when(F.col("n") > 1, "duplicate")
    return both.select(*group, key, issue.alias("issue")).where("issue IS NOT NULL")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def grounded(quote: Column, evidence: Column) -> Column:
    """A quote, white space collapsed, stands in the evidence; an empty quote doesn't."""
    q = squeeze(quote)
    return (q != "") & F.contains(squeeze(evidence), q)


def verdict(claims: DataFrame, key: str, supported: str) -> DataFrame:
    """Per record: supported if all claims are, unsupported if none, else mixed."""
    all_of, any_of = F.bool_and(supported), F.bool_or(supported)
    return claims.groupBy(key).agg(F.when(all_of, "supported").when(~any_of, "unsupported").otherwise("mixed").alias("verdict"), F.count("*").alias("n_claims"))


def find_quotes(texts: DataFrame, text: str, carry: list[str], quotes: DataFrame, quote: str, quote_key: str, probe: int = 6) -> DataFrame:
    """Pairs of a text and a quote that stands in it whole, white space collapsed.

    Quotes meet texts in an equi-join on windows of words: each quote by the
    first ``probe`` words after its first one, which may be the end of a longer
    word in the text, each text by all its distinct windows of as many; then
    the whole quote is looked for.  Quotes of one or two words must stand at whole words.
    """
    split = lambda c: F.split(squeeze(c), " ")
    n_words = F.size("_words")
    q = quotes.select(F.col(quote_key).alias("quote_key"), squeeze(F.col(quote)).alias("_quote")).where("_quote <> ''").withColumn("_words", split(F.col("_quote")))
    q = q.withColumn("_n", F.greatest(F.lit(1), F.least(F.lit(probe), n_words - 2))).withColumn("_probe", F.array_join(F.slice("_words", F.when(n_words > 2, 2).otherwise(1), F.col("_n")), " "))
    # only numbers of texts and hashes of windows are joined; a text is looked at again for the quotes that it may hold
    held = materialize(texts.select(*carry, squeeze(F.col(text)).alias("_text")).withColumn("_id", F.monotonically_increasing_id()), "texts")
    words = held.select("_id", F.split("_text", " ").alias("_words"))
    parts = []
    for n in sorted(r["_n"] for r in q.select("_n").distinct().collect()):  # at most ``probe`` of them
        windows = NGram(n=n, inputCol="_words", outputCol="_windows").transform(words)
        hashes = windows.select("_id", F.explode(F.array_distinct(F.transform("_windows", lambda w: F.xxhash64(w)))).alias("_hash"))
        parts.append(hashes.join(small(q.where(F.col("_n") == n).select(F.xxhash64("_probe").alias("_hash"), "quote_key", "_quote")), "_hash").select("_id", "quote_key", "_quote"))
    if not parts:
        return texts.select(*carry, F.lit(None).cast(q.schema["quote_key"].dataType).alias("quote_key")).limit(0)
    met = materialize(reduce(DataFrame.unionByName, parts), "quotes")
    return held.join(small(met), "_id").where(F.contains("_text", F.col("_quote"))).select(*carry, "quote_key")


def payload(fields: dict[str, Column]) -> Column:
    """JSON of the known fields in the order given, for a prompt."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def overwrite(blocks: DataFrame, records: DataFrame, key: str, label: str, value: str) -> DataFrame:
    """Blocks whose line ``label: ...`` tells what their record has: put right, or added at the end."""
    line = F.concat(F.lit(f"{label}: "), F.col("_value"))
    side = records.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    has = F.col("block").rlike(rf"(?m)^{label}: ")
    right = F.concat(F.regexp_extract("block", rf"(?s)^(.*?)(?m:^{label}: [^\n]*)", 1), line, F.regexp_extract("block", rf"(?s)^.*?(?m:^{label}: [^\n]*)(.*)$", 1))
    fixed = F.when(F.col("_value").isNull(), F.col("block")).when(has, right).otherwise(F.concat("block", F.lit("\n"), line))
    return blocks.join(side, F.col(key) == F.col("_key"), "left").withColumn("block", fixed).drop("_key", "_value")


def merge_sections(blocks: DataFrame, report: list[str], section: str, at: str, identity: Column, block: str, separator: str = "\n\n") -> DataFrame:
    """One section for each key of a report: ``at`` of its first block, ``n_blocks`` and ``body``.

    All blocks of sections of one key are joined in order; of blocks of one
    identity (an id, an address, a title) the first stays.
    """
    firsts = blocks.groupBy(*report, section, identity.alias("_identity")).agg(F.min(F.struct(F.col(at).alias("at"), F.col(block).alias("block"))).alias("_b"))
    in_order = F.array_sort(F.collect_list("_b"))
    return firsts.groupBy(*report, section).agg(F.min("_b.at").alias("at"), F.count("*").alias("n_blocks"), F.array_join(F.transform(in_order, lambda b: b["block"]), separator).alias("body"))


def selected_ids(answer: Column, candidates: Column, most: int, least: int) -> Column:
    """``struct(ids, method)`` of a model's answer: which of ``candidates`` (an array of ids) it selects, at most ``most``, in its order.

    By the ``json`` in it (``selected_ids``, numbers or objects with an id);
    else by ``mention`` (id, # and so on before a number); else by ``list``, a
    number at the beginning of a line; else the first ``least`` candidates
    (``fallback``).  Ids that aren't candidates don't count, nor do repeated ones.
    """
    parsed = loose_json(answer)
    listed = F.coalesce(F.get_json_object(parsed, "$.selected_ids"), F.lit("[]"))
    plain = F.transform(F.from_json(listed, "array<string>"), lambda v: F.coalesce(F.get_json_object(v, "$.id"), v).try_cast("long"))
    numbers = lambda found: F.transform(found, lambda v: v.try_cast("long"))
    mentioned = numbers(F.regexp_extract_all(answer, F.lit(r"(?i)(?:candidate|id|#)\s*[:：]?\s*(\d{1,3})"), F.lit(1)))
    lines = numbers(F.regexp_extract_all(answer, F.lit(r"(?m)^[^\S\n]*(\d{1,3})[.、)]"), F.lit(1)))
    known = lambda ids: F.slice(F.filter(F.array_distinct(F.coalesce(ids, F.expr("cast(array() as array<bigint>)"))), lambda i: F.array_contains(candidates, i)), 1, most)
    ways = F.array(*[F.struct(known(ids).alias("ids"), F.lit(name).alias("method")) for name, ids in (("json", plain), ("mention", mentioned), ("list", lines))])
    return F.coalesce(F.get(F.filter(ways, lambda w: F.size(w["ids"]) > 0), 0), F.struct(F.slice(candidates, 1, min(least, most)).alias("ids"), F.lit("fallback").alias("method")))
