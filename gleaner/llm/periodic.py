"""Stretches of a text that repeat with a period, and texts without the repetitions.

A run is a stretch of consecutive words with smallest period q that is at
least ``min_exponent`` periods and ``min_words`` words long and that no
neighbouring word extends.  The words of a text are numbers; the array of them
is compared with itself shifted by each lag q up to n / ``min_exponent``, for
all texts of a batch at once, and stretches in which both agree are measured
by their ends.  A stretch that is long enough agrees at all of some eight
evenly spaced places, so a shift is compared at these first and in full only
around where they agree; no lag is left out.

A text of more than ``LONG_CHARS`` characters is dealt over tasks by ranges of
lags: each task gets the word numbers (not the text) and a range, and returns
the runs whose smallest period lies in it.

Defined results: a null or empty text has no runs and an empty collapsed text;
a null key is not rewritten; repeated rows are rows of their own; an empty
table gives no rows; other columns are carried along, but those that have the
names of added ones are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import Words, crc32, numbered_columns, restored, slices, small_batches
from gleaner.scratch import materialize

MIN_EXPONENT, MIN_WORDS = 3, 24
#: Characters above which the lags of a text are dealt over tasks; lags of a task at least, and tasks of a text at most (and one).
LONG_CHARS, RANGE_LAGS, RANGES = 65_536, 4096, 64
#: Places at which a shift is compared first, for each stretch that is just long enough.
PLACES = 8
ADDED = ["_runs", "_collapsed"]
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

#: Of keys and word offsets, which word stands at each place (numbers into all words of the batch).
Rewrite = Callable[[list, np.ndarray], np.ndarray]


def stretches(agree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, agree, False]))
    return edge[::2], edge[1::2] - edge[::2]


def prime_factors(n: int) -> list[int]:
    found, f = [], 2
    while f * f <= n:
        if n % f == 0:
            found.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return found + [n] * (n > 1)


def smallest_period(words: np.ndarray, period: int) -> int:
    """The smallest period of ``words``, which are at least two ``period``s long and repeat with it; it divides ``period``."""
    for f in prime_factors(period):
        while period % f == 0 and (words[period // f :] == words[: -(period // f)]).all():
            period //= f
    return period


def scan_lags(words: np.ndarray, cut: np.ndarray, low: int, high: int, min_exponent: int = MIN_EXPONENT, min_words: int = MIN_WORDS) -> np.ndarray:
    """The runs with a smallest period from ``low`` to ``high``, as rows of first word, length and period.

    ``words`` are numbers, those of text i at ``cut[i]:cut[i + 1]``; no two
    texts share a number and longer texts come first.
    """
    sizes = np.diff(cut)
    found: list[tuple[int, int, int]] = []
    due: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # runs by the next multiple of their period
    for lag in range(low, min(high, int(sizes[0]) // min_exponent if len(sizes) else 0) + 1):
        texts = int(np.searchsorted(-sizes, -max(min_words, min_exponent * lag), side="right"))
        end = int(cut[texts]) - lag
        if end <= 0:
            break
        known = due.pop(lag, [])
        for run in known:
            if run[1] >= min_exponent * (lag + run[2]):
                due[lag + run[2]].append(run)
        need = max(min_words - lag, (min_exponent - 1) * lag, 1)
        step = max(1, need // PLACES)
        least = need // step
        hits = np.flatnonzero(words[:end:step] == words[lag : lag + end : step])
        if len(hits) < least or not (hits[least - 1 :] - hits[: len(hits) - least + 1] == least - 1).any():
            continue
        breaks = np.flatnonzero(np.diff(hits) != 1)
        first, last = hits[np.r_[0, breaks + 1]] * step, hits[np.r_[breaks, len(hits) - 1]] * step
        good = last - first >= (least - 1) * step
        known.sort()
        starts = np.array([k[0] for k in known], np.int64)
        for a, b in zip(first[good].tolist(), last[good].tolist(), strict=True):
            at = int(np.searchsorted(starts, a, side="right")) - 1
            if at >= 0 and known[at][0] + known[at][1] > b + lag:
                continue  # a run of a shorter period that divides the lag
            x, y = max(0, a - step + 1), min(end, b + step)
            begin, size = stretches(words[x:y] == words[x + lag : y + lag])
            for s, k in zip((begin[size >= need] + x).tolist(), (size[size >= need] + lag).tolist(), strict=True):
                period = smallest_period(words[s : s + k], lag)
                if period == lag:
                    found.append((s, k, lag))
                if k >= min_exponent * (lag + period):
                    due[lag + period].append((s, k, period))
    return np.array(found, np.int64).reshape(-1, 3)


def runs_of(codes: list[np.ndarray], low: int, high: int, min_exponent: int = MIN_EXPONENT, min_words: int = MIN_WORDS) -> list[np.ndarray]:
    """For each text, given as numbers of its words, its runs by start and period: rows of start, length and period."""
    order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
    cut = np.r_[0, np.cumsum([len(codes[i]) for i in order])].astype(np.int64)
    top = max((int(c.max()) for c in codes if len(c)), default=0) + 1
    words = np.concatenate([codes[i].astype(np.int64) + top * place for place, i in enumerate(order)] or [np.zeros(0, np.int64)])
    runs = scan_lags(words, cut, low, high, min_exponent, min_words)
    place = np.searchsorted(cut, runs[:, 0], side="right") - 1
    runs[:, 0] -= cut[place]
    sort = np.lexsort((runs[:, 2], runs[:, 0], place))
    runs, place = runs[sort], place[sort]
    bounds = np.searchsorted(place, np.arange(len(codes) + 1))
    out: list[np.ndarray] = [runs[:0]] * len(codes)
    for p, i in enumerate(order):
        out[i] = runs[bounds[p] : bounds[p + 1]]
    return out


class Texts:
    """The words of a slice of texts, rewritten where asked for."""

    def __init__(self, part: pa.RecordBatch, text: str, key: str | None, rewrite: Rewrite | None):
        words = Words(part.column(text))
        self.unique, self.offsets = words.unique, words.offsets
        self.codes = words.codes[rewrite(part.column(key).to_pylist(), words.offsets)] if rewrite else words.codes

    def each(self) -> list[np.ndarray]:
        return np.split(self.codes, self.offsets[1:-1]) if len(self.offsets) > 1 else []

    def collapsed(self, runs: list[np.ndarray]) -> pa.Array:
        """The texts without words that repeat those one period before them in a run, joined by spaces."""
        dropped = np.zeros(len(self.codes) + 1, np.int64)
        for base, of_text in zip(self.offsets.tolist(), runs, strict=False):
            np.add.at(dropped, base + of_text[:, 0] + of_text[:, 2], 1)
            np.add.at(dropped, base + of_text[:, 0] + of_text[:, 1], -1)
        keep = np.cumsum(dropped)[:-1] == 0
        bounds = np.r_[0, np.cumsum(keep)][self.offsets]
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), self.unique.take(pa.array(self.codes[keep])))
        return pc.binary_join(lists, " ")


def _run_array(runs: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
    bounds = np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(RUN_TYPE.value_type)))


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, rewrite: Rewrite | None = None, min_exponent: int = MIN_EXPONENT, min_words: int = MIN_WORDS, long_chars: int = LONG_CHARS, range_lags: int = RANGE_LAGS) -> DataFrame:
    """The columns ``carry`` (all unless named) of ``docs`` with ``_runs``, by start and period, and ``_collapsed``, the text without repetitions.

    ``rewrite`` says which word stands at each place before runs are looked for.
    """
    carry = docs.columns if carry is None else carry
    small_batches(docs.sparkSession)
    plain, place = numbered_columns(docs, [*carry, key, text])
    k, t = place[key], place[text]
    keep = [place[c] for c in dict.fromkeys(carry)]
    schema = T.StructType([*(plain.schema[c] for c in keep), T.StructField("_runs", T._parse_datatype_string(RUN)), T.StructField("_collapsed", T.StringType())])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, t):
                texts = Texts(part, t, k, rewrite)
                runs = runs_of(texts.each(), 1, 1 << 62, min_exponent, min_words)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), _run_array(runs), texts.collapsed(runs)], names=schema.names)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, t):
                codes = Texts(part, t, k, rewrite).each()
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array([len(c) for c in codes], pa.int64()), pa.array([c.astype(np.int32).tobytes() for c in codes], pa.binary())], names=["_row", "_n", "_codes"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple[int, int], list[int]] = defaultdict(list)
            for i, of_row in enumerate(zip(batch.column("_low").to_pylist(), batch.column("_high").to_pylist(), strict=True)):
                groups[of_row].append(i)
            for (low, high), rows in groups.items():
                codes = [np.frombuffer(batch.column("_codes")[i].as_buffer(), np.int32) for i in rows]
                found = runs_of(codes, low, high, min_exponent, min_words)
                flat = np.concatenate(found)
                row = batch.column("_row").take(pa.array(np.repeat(rows, [len(f) for f in found]), pa.int64()))
                yield pa.RecordBatch.from_arrays([row, *(pa.array(flat[:, c]) for c in range(3))], names=["_row", "start", "length", "period"])

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, t):
                given = pc.fill_null(part.column("_runs"), pa.scalar([], RUN_TYPE)).to_pylist()
                runs = [np.array([[r["start"], r["length"], r["period"]] for r in of_text], np.int64).reshape(-1, 3) for of_text in given]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), _run_array(runs), Texts(part, t, k, rewrite).collapsed(runs)], names=schema.names)

    is_long = F.coalesce(F.length(t), F.lit(0)) > long_chars
    here = plain.where(~is_long).mapInArrow(short, schema)
    far = materialize(plain.where(is_long).withColumn("_row", F.monotonically_increasing_id()), "long-texts")
    coded = materialize(far.select(*dict.fromkeys([k, t]), "_row").mapInArrow(numbers, "_row long, _n long, _codes binary"), "word-numbers")
    most = F.floor(F.col("_n") / min_exponent)
    width = F.greatest(F.lit(range_lags), F.ceil(most / RANGES))
    dealt = coded.where(most >= 1).select("*", width.alias("_width"), most.alias("_most"))
    dealt = dealt.select("_row", "_codes", "_width", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_most"), F.col("_width"))).alias("_low"))
    dealt = dealt.withColumn("_high", F.col("_low") + F.col("_width") - 1).drop("_width")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = dealt.repartition(tasks, "_row", "_low").mapInArrow(ranges, "_row long, start long, length long, period long")
    of_text = runs.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("_found"))
    # by start, then period: two runs that start at one word differ in both
    by_start = F.transform(F.array_sort(F.transform("_found", lambda r: F.struct(r["start"], r["period"], r["length"]))), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    there = far.join(of_text.withColumn("_runs", by_start).drop("_found"), "_row", "left").mapInArrow(collapse, schema)
    return here.unionByName(there).select(*restored(place, carry, ADDED), *ADDED)


def planted_repeats(keys: list, offsets: np.ndarray) -> np.ndarray:
    """A rewriting that plants repetitions by key: of a tenth of the texts, all words from some place on repeat with some period."""
    at = np.arange(offsets[-1])
    for key, begin, end in zip(keys, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        h = 1 if key is None else crc32(str(key).encode())
        n, g = end - begin, h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            at[begin + a : end] = begin + a + np.arange(n - a) % p
    return at


def strongest(runs: str | Column = "_runs") -> Column:
    """The run of greatest length / period, compared exactly; ties: smallest start, then period. Null where there is none."""
    runs = F.col(runs) if isinstance(runs, str) else runs

    def better(x: Column, y: Column) -> Column:
        mine, other = x["length"] * y["period"], y["length"] * x["period"]
        return (mine > other) | ((mine == other) & (F.struct(x["start"], x["period"]) < F.struct(y["start"], y["period"])))

    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.try_element_at(runs, F.lit(1)), lambda best, r: F.when(better(r, best), r).otherwise(best))


def listed(runs: str | Column = "_runs") -> Column:
    """``start,length,period`` and a line feed for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
