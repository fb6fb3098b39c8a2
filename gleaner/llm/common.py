"""Helpers that the operators share: joins by a small table, and Arrow batches of words.

Conventions: a word is ``[^\\x20\\x09-\\x0D]+``; a null text is an empty text;
columns that an operator adds to its input replace input columns of that name.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a lookup table that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bytes that a Python worker gets in a batch, and bytes of text that it holds as words at a time.
BATCH_BYTES, SLICE_BYTES = 8 << 20, 4 << 20


def lookup_join(left: DataFrame, table: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Join with a materialised table: broadcast if its counted rows are few, else a shuffle join that AQE may split."""
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return left.join(F.broadcast(table) if small else table, on, how)


def numbered_columns(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The columns ``names`` of ``df`` as c0, c1, ..., and what each is called, so that no name of an operator clashes with one of theirs."""
    place = {n: f"c{i}" for i, n in enumerate(dict.fromkeys(names))}
    return df.select(*[F.col(f"`{n}`").alias(c) for n, c in place.items()]), place


def restored(place: dict[str, str], names: list[str], added: list[str]) -> list[Column]:
    """The columns ``names`` under their own names, but those that an operator's ``added`` columns replace."""
    gone = {a.lower() for a in added}
    return [F.col(place[n]).alias(n) for n in names if n.lower() not in gone]


def crc_bucket(key: str | Column, n: int) -> Column:
    """``crc32(key as text) mod n``; a null key counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - 1) // most
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession) -> None:
    """Hold what Spark sends to a Python worker at a time to ``BATCH_BYTES``; rows here are whole texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name)  # bytes, as in 67108864b
    if not held.rstrip("b").isdigit() or int(held.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def append_column(df: DataFrame, name: str, kind: T.DataType, text: str, fn: Callable[[pa.RecordBatch], pa.Array], drop: bool = False) -> DataFrame:
    """Add the column ``name`` that ``fn`` makes of each slice of rows; a column of that name is replaced. ``drop``: the text doesn't come back."""
    small_batches(df.sparkSession)
    base = df.drop(name)
    kept = [i for i, c in enumerate(base.columns) if not (drop and c == text)]
    schema = T.StructType([*(base.schema.fields[i] for i in kept), T.StructField(name, kind)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), fn(part)], names=names)

    return base.mapInArrow(run, schema)


class Words:
    """The words of a slice of texts: ``codes`` into ``unique``, those of text i at ``offsets[i]:offsets[i + 1]``."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "")
        if lower:
            texts = pc.ascii_lower(texts)
        parts = pc.ascii_split_whitespace(texts)
        flat, cut = parts.flatten(), np.r_[0, np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))].astype(np.int64)
        real = pc.greater(pc.binary_length(flat), 0)
        self.offsets = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))].astype(np.int64)[cut]
        coded = flat.filter(real).dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.unique = coded.dictionary
        self.counts = np.diff(self.offsets)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def total(self, of_word: np.ndarray) -> np.ndarray:
        """For each text the sum over its words of what ``of_word`` has for each unique word."""
        run = np.concatenate([np.zeros(1, of_word.dtype), np.cumsum(of_word[self.codes])])
        return run[self.offsets[1:]] - run[self.offsets[:-1]]

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the unique words."""
        return hash_words(self.unique)


def hash_words(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them (the finaliser of splitmix64)."""
    # fixed values of the published generator
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows_of(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of ``width`` words begin that lie in one text, and the offsets of each text's windows."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    cut = np.r_[0, np.cumsum(counts)]
    starts = np.arange(cut[-1]) + np.repeat(offsets[:-1] - cut[:-1], counts)
    return starts, cut


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
