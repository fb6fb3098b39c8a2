"""Quality rules with host verdicts.

Each document is measured and held against document rules; failures are added
up by host, and each host's failure rate is shrunk towards a beta prior fitted
to all hosts by their moments, net of the variance that comes from a host
having few documents.  A host's shrunk rate is the prior probability that a
document of it is bad.  Joined back to the document it is weighed with the
document's own evidence, a likelihood ratio: above 1 for each soft rule that
it fails, by how far it fails, and ``PASSES`` if it passes all.  A document
goes if a base rule fails or if the odds that it is bad exceed one.  So a text
slightly over a limit stays at a host whose texts are good, and goes at one
whose texts fail often; at a host where almost all fail (``host_rejected``),
texts that pass go as well.

Defined results: a null text has no words and fails the base rules; a null
host is a host of its own; repeated rows count as often as they occur; an
empty table gives no rows; other columns are carried along, but those that
have the names of added ones are replaced.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import Words, append_column, lookup_join, mix, numbered_columns, restored, windows_of
from gleaner.scratch import materialize

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]
MEASURES = T.StructType([T.StructField(n, T.LongType()) for n in COUNTS])
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
#: Likelihood ratios of bad against good: of a text at the limit of each soft rule, and of one that passes all rules.
SYMBOL_RATIO, LINE_RATIO, LENGTH_RATIO, PASSES = 9.0, 3.0, 9.0, 0.1
ADDED = ["_quality", "_base_failed", "_host_rate", "_host_rejected", "_kept"]


def repeated_words(words: Words, width: int = 3) -> np.ndarray:
    """For each text the number of its words in windows of ``width`` words that it has twice or more."""
    starts, cut = windows_of(words.offsets, width)
    inside = np.zeros(len(words.codes) + 1, bool)
    if len(starts):
        row = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        parts = [row, *(words.codes[starts + j] for j in range(width))]
        key = np.zeros(len(starts), np.uint64)
        for p in parts:
            key = mix(key + p.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        for p in parts:
            same &= p[order[1:]] == p[order[:-1]]
        twice = np.zeros(len(starts), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for j in range(width):
            inside[starts[twice] + j] = True
    run = np.r_[0, np.cumsum(inside[:-1])]
    return run[words.offsets[1:]] - run[words.offsets[:-1]]


def repeated_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text its lines with a word, and how many of them equal an earlier one."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    sizes = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
    coded = lines.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)), 0).to_numpy(zero_copy_only=False)[codes]
    row, kinds = np.repeat(np.arange(len(sizes)), sizes)[real], max(1, len(coded.dictionary))
    n = np.bincount(row, minlength=len(sizes))
    distinct = np.bincount(np.unique(row * kinds + codes[real]) // kinds, minlength=len(sizes))
    return n, n - distinct


def _measure(texts: pa.Array) -> pa.Array:
    words = Words(texts)
    chars = pc.utf8_length(words.unique).to_numpy(zero_copy_only=False).astype(np.int64)
    symbols = pc.count_substring_regex(words.unique, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64)
    lines, again = repeated_lines(texts)
    found = [words.counts, words.total(chars), words.total(symbols), again, lines, repeated_words(words)]
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in found], names=COUNTS)


def measure(docs: DataFrame, out: str = "_quality", drop: bool = False, text: str = "text") -> DataFrame:
    """``docs`` with the struct ``out`` of counts over its whole ``text``; ``drop`` leaves the text out."""
    return append_column(docs, out, MEASURES, text, lambda part: _measure(part.column(text)), drop)


def base_failed(q: str = "_quality") -> Column:
    words = F.col(f"{q}.n_words")
    return (words < MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > 50 * words)


def soft_rules(q: str = "_quality") -> list[tuple[Column, Column]]:
    """Of each soft rule whether it fails, and the likelihood ratio where it does: symbols, repeated lines, short and long words."""
    words, chars = F.col(f"{q}.n_words"), F.col(f"{q}.word_chars")
    symbols, again, lines = (F.col(f"{q}.{n}") for n in ("n_symbols", "n_dup_lines", "n_lines"))
    return [
        (10 * symbols > words, SYMBOL_RATIO * (10 * symbols / words)),
        (100 * again > 30 * lines, LINE_RATIO * (100 * again / (30 * lines))),
        (chars < 2 * words, LENGTH_RATIO * (2 * words / chars)),
        (chars > 15 * words, LENGTH_RATIO * (chars / (15 * words))),
    ]


def rule_failed(q: str = "_quality") -> Column:
    """A base rule or one of the rules on symbols, repeated lines and the length of words fails."""
    return reduce(Column.__or__, (failed for failed, _ in soft_rules(q)), base_failed(q))


def evidence(q: str = "_quality") -> Column:
    """The likelihood ratio of a document that passes the base rules."""
    rules = soft_rules(q)
    ratio = reduce(Column.__mul__, (F.when(failed, by).otherwise(1.0) for failed, by in rules))
    return F.when(reduce(Column.__or__, (failed for failed, _ in rules)), ratio).otherwise(PASSES)


def host_verdicts(marked: DataFrame) -> DataFrame:
    """``_host, host_rate, host_rejected`` of documents ``_host, _failed``.

    The prior is beta(m * s, (1 - m) * s): m the mean of the hosts' rates and
    s = m * (1 - m) / v - 1, held between 1 and 10,000, v the variance of the
    rates less m * (1 - m) times the mean of 1 / n, their binomial part.
    """
    hosts = materialize(marked.groupBy("_host").agg(F.count("*").alias("_n"), F.sum(F.col("_failed").cast("long")).alias("_bad")), "hosts")
    rate = F.col("_bad") / F.col("_n")
    mean, variance, each = (float(x or 0) for x in hosts.agg(F.avg(rate), F.var_pop(rate), F.avg(1.0 / F.col("_n"))).first())  # one row
    room = mean * (1 - mean)
    variance = max(variance - room * each, 0.0)
    strength = 10000.0 if variance * 10001 <= room else max(1.0, room / variance - 1)
    shrunk = (F.col("_bad") + mean * strength) / (F.col("_n") + strength)
    return hosts.select("_host", shrunk.alias("host_rate"), (shrunk * (1 + PASSES) > 1).alias("host_rejected"))


def quality_rules(docs: DataFrame, host: str = "source", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all unless named) of ``docs`` with ``_quality``, ``_base_failed``, ``_host_rate``, ``_host_rejected`` and ``_kept``."""
    carry = docs.columns if carry is None else carry
    plain, place = numbered_columns(docs, [*carry, host, "text"])
    measured = measure(plain, drop="text" not in [*carry, host], text=place["text"])
    measured = measured.select(*[place[c] for c in carry], F.col(place[host]).alias("_host"), "_quality")
    marked = materialize(measured.withColumn("_failed", rule_failed()), "quality")
    verdicts = materialize(host_verdicts(marked), "verdicts").withColumnsRenamed({"_host": "_h", "host_rate": "_host_rate", "host_rejected": "_host_rejected"})
    joined = lookup_join(marked, verdicts, marked["_host"].eqNullSafe(verdicts["_h"]))
    kept = ~base_failed() & ~(F.col("_host_rate") * (1 + evidence()) > 1)
    return joined.select(*restored(place, carry, ADDED), "_quality", base_failed().alias("_base_failed"), "_host_rate", "_host_rejected", kept.alias("_kept"))


def kept_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    plain, place = numbered_columns(docs, [*docs.columns, host, "text"])
    judged = quality_rules(plain.withColumnsRenamed({place["text"]: "text", place[host]: "host"}), "host")
    named = {"text": "text", host: "host"}
    return judged.where("_kept").select(*[F.col(named.get(c, place[c])).alias(c) for c in docs.columns])
