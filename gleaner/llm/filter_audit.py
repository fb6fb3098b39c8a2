"""Interaction of filters: what each removes in every order of applying them.

A document's failures of five filters are five bits.  Which filter removes it
is the first failed one in the order, a lookup in a table of 32 failure sets
by 120 orders; each task indexes the table with its documents, adds up
removals by part, order and step, and by label, and hands on one row of sums
per part and cell.  The sums of all tasks are added by Spark, and one row per
part, order and step is made of them.

The fifth filter, E, fails a text that a smaller key has anywhere in the
table: texts are compared by their SHA-256 and length, the smallest key of a
digest is a minimum that is pre-aggregated before the shuffle, and a digest
that holds a large share of all rows is split by AQE when it is joined back.

Defined results: a null text is empty; a null key is smaller than none and has
no smaller one; labels of a key are taken together (any 1 counts); a null part
is an empty string; repeated rows count as often as they occur, and don't fail
E by each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Words, slices, small_batches
from gleaner.scratch import materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: For each order, the number of the filter at each step.
STEPS = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
MIN_WORDS, SYMBOLS = 200, "[#$%&*|]"
#: Documents whose 120 lookups are held at a time, and parts whose sums a task holds.
ROWS, PARTS = 4096, 256
#: Sums of a part: by order and step (the sixth: kept) all documents, good ones and toxic ones; then documents by failure set.
CELLS = len(ORDERS) * 6
SUMS = 3 * CELLS + 32
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def first_failures() -> np.ndarray:
    """For each set of failures (bit i: filter i) and order, the step of the first failed filter, 5 where none is."""
    sets = (np.arange(32)[:, None] >> np.arange(5)) & 1
    fails = np.concatenate([sets[:, STEPS], np.ones((32, len(ORDERS), 1), int)], axis=2)
    return fails.argmax(axis=2)


FIRST = first_failures()


def failures(texts: pa.Array) -> np.ndarray:
    """The set of the filters A to D that each text fails."""
    texts = pc.fill_null(texts, "")
    words = Words(texts)
    kinds = max(1, len(words.unique))
    distinct = np.bincount(np.unique(words.rows() * kinds + words.codes) // kinds, minlength=len(words.counts))
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    capitals = words.total(pc.count_substring_regex(words.unique, "[A-Z]").to_numpy(zero_copy_only=False).astype(np.int64))
    symbols = words.total(pc.match_substring_regex(words.unique, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64))
    failed = [words.counts < MIN_WORDS, 100 * distinct < 50 * words.counts, 100 * capitals > 3 * chars, symbols > 0]
    return sum(f.astype(np.int64) << i for i, f in enumerate(failed))


class Sums:
    """Removals by part, order and step of the documents that a task has seen."""

    def __init__(self):
        self.of: dict[str, np.ndarray] = {}

    def add(self, part: str, sets: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> None:
        sums = self.of.setdefault(part, np.zeros(SUMS, np.int64))
        place = np.arange(len(ORDERS)) * 6
        for a in range(0, len(sets), ROWS):
            cell = FIRST[sets[a : a + ROWS]] + place
            for i, rows in enumerate((slice(None), good[a : a + ROWS], toxic[a : a + ROWS])):
                sums[i * CELLS : (i + 1) * CELLS] += np.bincount(cell[rows].ravel(), minlength=CELLS)
        sums[3 * CELLS :] += np.bincount(sets, minlength=32)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """All sums that aren't 0, and none are left."""
        for part, sums in self.of.items():
            cell = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), pa.array(sums[cell])], names=["part", "cell", "n"])
        self.of = {}


def result_rows(part: str, sums: np.ndarray) -> pd.DataFrame:
    """The 600 rows of a part."""
    removed, good, toxic = (sums[i * CELLS : (i + 1) * CELLS].reshape(-1, 6)[:, :5] for i in range(3))
    sets, bit = sums[3 * CELLS :], (np.arange(32)[:, None] >> np.arange(5)) & 1
    fails, unique = sets @ bit, sets[1 << np.arange(5)]
    shapley = np.array([removed[STEPS == f].sum() for f in range(5)])
    columns = {"kept": sets.sum() - removed.cumsum(axis=1), "removed": removed, "redundant": fails[STEPS] - removed, "unique_fails": unique[STEPS], "good_lost": good, "toxic_lost": toxic, "shapley": shapley[STEPS]}
    frame = {"part": part, "filter_order": np.repeat(ORDERS, 5), "step": np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS))}
    return pd.DataFrame(frame | {n: c.ravel() for n, c in columns.items()})


def failure_sets(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``part, fails, good, toxic``: for each document the set of filters that it fails (bit i: filter i), and its labels."""
    small_batches(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("key", "part", "digest", "n")), pa.array(failures(piece.column("t")).astype(np.int32))], names=["key", "part", "digest", "n", "fails"])

    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"), F.length(whole).alias("n"), whole.alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    rows = materialize(rows.mapInArrow(measure, f"key {kind}, part string, digest binary, n int, fails int"), "failures")
    firsts = rows.groupBy("digest", "n").agg(F.min("key").alias("least"), F.count("*").alias("times")).where("times > 1 AND least IS NOT NULL").drop("times")
    marks = labels.groupBy(F.col(f"`{key}`").alias("key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    again = F.when(F.col("key") > F.col("least"), 1 << FILTERS.index("E")).otherwise(0)
    joined = rows.join(firsts, ["digest", "n"], "left").join(marks, "key", "left")
    return joined.select("part", (F.col("fails") + again).alias("fails"), *[F.coalesce(F.col(c), F.lit(0)).cast("boolean").alias(c) for c in ("good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            coded = batch.column("part").dictionary_encode()
            codes = coded.indices.to_numpy()
            sets, good, toxic = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fails", "good", "toxic"))
            for i, name in enumerate(coded.dictionary.to_pylist()):
                sums.add(name, sets[codes == i], good[codes == i], toxic[codes == i])
                if len(sums.of) >= PARTS:
                    yield from sums.rows()
        yield from sums.rows()

    def rows(frame: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros(SUMS, np.int64)
        sums[frame["cell"].to_numpy()] = frame["n"].to_numpy()
        return result_rows(frame["part"].iloc[0], sums)

    partial = failure_sets(docs, labels, key, text, part).mapInArrow(count, "part string, cell int, n long")
    total = partial.groupBy("part", "cell").agg(F.sum("n").alias("n"))
    return total.groupBy("part").applyInPandas(rows, RESULT)
