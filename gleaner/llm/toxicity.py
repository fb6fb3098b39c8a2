"""Toxicity by a factorization machine over hashed terms.

score(text) = sigmoid(b + sum of w_t x_t + sum over pairs of terms of <v_t, v_u> x_t x_u),
the sums over the text's terms: the pairs hold what additive weights miss, such
as an insult beside a group's name.  Terms are the lower-case words, without
the punctuation around them, and their beginnings, each as found once, twice
or three times, hashed into ``SPACE`` places; a place counts once for a text.
x_t is how clearly the labelled rows tell the classes apart by t, between 0
and 1: z / (z + ``DOUBT``), z the distance of its number of label 1 from the
expected one in deviations, of a variance no less than ``DOUBT``.  No term is
left out: rare and unclear ones weigh little.

The machine is fitted on at most ``rows`` labelled rows of each class, those
of smallest hash; every whole text is then scored.

Defined results: a null or empty text gets the score of no terms; of several
labels of a document the highest counts, and of several texts of a labelled
``doc_id`` the least in the order of strings; rows with equal ``doc_id`` are
scored one by one; a null ``doc_id`` is empty text for the fold; without
labels of both classes all scores are the share of label 1; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import Words, append_column, crc_bucket, hash_words, mix, slices, small_batches
from gleaner.scratch import materialize

#: Bound of the fit: labelled rows of each class.
ROWS = 3000
#: Places that terms are hashed into.
SPACE = 1 << 18
FACTORS, EPOCHS, RATE, PENALTY, DOUBT = 4, 60, 0.1, 1e-4, 4.0
THRESHOLD = 0.7
#: Lengths of the beginnings of words that are terms.
PREFIXES = (4, 5, 6, 7)
EDGES = r"^[^\pL\pN]+|[^\pL\pN]+$"


@dataclass
class Machine:
    """Of each place of the hash space how much it counts, its weight and its factors."""

    bias: float
    clear: np.ndarray
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` texts whose terms are the distinct pairs ``row, term``."""
        x = self.clear[term]
        z = self.bias + np.bincount(row, self.linear[term] * x, n)
        for f in self.factors:
            by = f[term] * x
            z += 0.5 * (np.bincount(row, by, n) ** 2 - np.bincount(row, by**2, n))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def word_terms(unique: pa.Array) -> list[np.ndarray]:
    """Hashes of the terms of each unique word: the word, and its beginnings, which inflected forms share; 0 where it is too short for one."""
    clean = pc.utf8_lower(pc.replace_substring_regex(unique, EDGES, ""))
    sizes = pc.utf8_length(clean).to_numpy(zero_copy_only=False)
    out = [np.where(sizes > 0, hash_words(clean), np.uint64(0))]
    for n in PREFIXES:
        marked = pc.binary_join_element_wise(pc.utf8_slice_codeunits(clean, 0, n), "", "*")
        out.append(np.where(sizes > n, hash_words(marked), np.uint64(0)))
    return out


def text_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs ``row, term`` of texts, terms as places in the hash space."""
    words = Words(texts)
    row, found = words.rows(), [np.zeros(0, np.int64)]
    for hashes in word_terms(words.unique):
        kinds, place = np.unique(hashes, return_inverse=True)
        if not len(kinds):
            continue
        pairs, n = np.unique(row * len(kinds) + place[words.codes], return_counts=True)
        for times in (1, 2, 3):
            at = pairs[(n >= times) & (kinds[pairs % len(kinds)] > 0)]
            term = mix(kinds[at % len(kinds)] + np.uint64(times)) % np.uint64(SPACE)
            found.append(at // len(kinds) * SPACE + term.astype(np.int64))
    pairs = np.unique(np.concatenate(found))
    return pairs // SPACE, pairs % SPACE


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, fold: int, folds: int) -> DataFrame:
    """``doc_id, y, text`` of at most ``rows`` labelled documents of each class outside the held-out fold."""
    known = labels.where(crc_bucket("doc_id", folds) != fold).groupBy("doc_id").agg(F.max(label).alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("y = 1").orderBy(*order).limit(rows).unionByName(known.where("y <> 1").orderBy(*order).limit(rows))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * rows
    return texts.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))


def fit(sample: DataFrame, factors: int = FACTORS, epochs: int = EPOCHS) -> Machine:
    """A machine fitted to the ``sample`` of ``labelled``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, term = text_terms(part.column("text"))
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(term.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pc.equal(part.column("y"), 1), lists], names=["doc_id", "y", "terms"])

    small_batches(sample.sparkSession)
    found = sample.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y boolean, terms array<int>")
    got = materialize(found, "terms").toArrow().sort_by("doc_id").combine_chunks()  # at most 2 * rows texts
    y = got.column("y").to_numpy().astype(np.float64)
    lists = got.column("terms").combine_chunks()
    row = np.repeat(np.arange(len(y), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return learn(row, lists.flatten().to_numpy(zero_copy_only=False), y, factors, epochs)


def clearness(row: np.ndarray, term: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How clearly each place of the hash space tells the classes apart, from 0 to 1."""
    share = y.mean()
    n, ones = np.bincount(term, minlength=SPACE), np.bincount(term, y[row], SPACE)
    z = np.abs(ones - n * share) / np.sqrt(n * share * (1 - share) + DOUBT)
    return (z / (z + DOUBT)) ** 2


def learn(row: np.ndarray, term: np.ndarray, y: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS) -> Machine:
    """Adam over all rows at a time, both classes weighing the same, of the distinct pairs ``row, term`` of texts with labels ``y``."""
    if not len(y) or y.mean() in (0.0, 1.0):
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return Machine(float(np.log(share / (1 - share))), np.zeros(SPACE), np.zeros(SPACE), np.zeros((factors, SPACE)))
    clear = clearness(row, term, y)
    used, term = np.unique(term, return_inverse=True)
    x = clear[used][term]
    rng, n, size = np.random.default_rng(7), len(y), len(used)
    p = [np.zeros(1), np.zeros(size), rng.normal(0, 0.05, (factors, size))]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / n
    for t in range(1, epochs + 1):
        sums = [np.bincount(row, f[term] * x, n) for f in p[2]]
        z = p[0] + np.bincount(row, p[1][term] * x, n)
        for f, q in zip(p[2], sums, strict=True):
            z += 0.5 * (q**2 - np.bincount(row, (f[term] * x) ** 2, n))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        of = g[row] * x
        mass = np.bincount(term, of * x, size)
        grads = [np.array([g.sum()]), np.bincount(term, of, size) + PENALTY * p[1]]
        grads.append(np.stack([np.bincount(term, of * q[row], size) - mass * f + PENALTY * f for f, q in zip(p[2], sums, strict=True)]))
        for i, grad in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * grad
            s[i] = 0.999 * s[i] + 0.001 * grad**2
            p[i] = p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-6)
    linear, wide = np.zeros(SPACE), np.zeros((factors, SPACE))
    linear[used], wide[:, used] = p[1], p[2]
    return Machine(float(p[0][0]), clear, linear, wide)


def apply(docs: DataFrame, machine: Machine, out: str = "score", drop: bool = False) -> DataFrame:
    """``docs`` with the machine's score of each whole text; ``drop`` leaves the text out."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # of SPACE places

    def run(part: pa.RecordBatch) -> pa.Array:
        return pa.array(shared.value.scores(*text_terms(part.column("text")), part.num_rows))

    return append_column(docs, out, T.DoubleType(), "text", run, drop)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 1, folds: int = 3, rows: int = ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``."""
    machine = fit(labelled(docs, labels, label, rows, fold, folds))
    scored = apply(docs.select("doc_id", "text"), machine, drop=True)
    return scored.select("doc_id", (crc_bucket("doc_id", folds) == fold).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
