import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import toxicity
from gleaner.llm.common import hash_words, mix

FILL = "the quick brown fox jumps over a lazy dog while seven birds sing in green trees near cold rivers".split()


def make(i):
    """Toxic texts hold both halves of a pair; clean ones hold one half or none."""
    words = [FILL[(i * 7 + j * j) % len(FILL)] for j in range(30)]
    kind = i % 4
    words += {0: ["Rotten,", "group-x"], 1: ["rotten"], 2: ["group-x"], 3: []}[kind]
    return " ".join(words), int(kind == 0)


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, *make(i)) for i in range(1200)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (None, "rotten group-x", "x"), (5002, "fox " * 100_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 1), (None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    return {r.doc_id: r for r in toxicity.score(docs, labels).collect()}, rows


def test_pairs_are_learned(scored):
    got, rows = scored
    held = [(got[i], y) for i, _, y in rows if got[i].held_out]
    assert all(0 <= r.score <= 1 for r, _ in held)
    assert sum(r.predicted == y for r, y in held) / len(held) > 0.97


def test_scores_follow_the_formula():
    """The machine's scores against sums over all terms and all pairs of terms in plain loops."""
    texts = ["Rotten, group-x rotten rotten", "fox", "", None, "walking walked (walks)"]
    rng = np.random.default_rng(1)
    machine = toxicity.Machine(0.3, rng.random(toxicity.SPACE), rng.normal(size=toxicity.SPACE), rng.normal(size=(3, toxicity.SPACE)) / 10)

    def place(term, times):
        h = hash_words(pa.array([term]))
        return int(mix(h + np.uint64(times))[0] % np.uint64(toxicity.SPACE))

    want = []
    for text in texts:
        n = Counter()
        for w in (text or "").split():
            w = w.strip("(),.").lower()
            n.update([w, *(w[:k] + "*" for k in toxicity.PREFIXES if len(w) > k)])
        terms = {place(t, k) for t, c in n.items() for k in (1, 2, 3) if c >= k}
        z = machine.bias + sum(machine.linear[t] * machine.clear[t] for t in terms)
        z += sum(machine.factors[:, a] @ machine.factors[:, b] * machine.clear[a] * machine.clear[b] for a, b in itertools.combinations(sorted(terms), 2))
        want.append(1 / (1 + math.exp(-z)))
    row, term = toxicity.text_terms(pa.array(texts))
    assert machine.scores(row, term, len(texts)) == pytest.approx(want)


def test_a_pair_counts_beyond_its_halves():
    """Half of the texts hold each of two terms; those that hold both are the ones labelled."""
    rng = np.random.default_rng(2)
    x = rng.random((800, 2)) < 0.5
    y = (x[:, 0] & x[:, 1]).astype(float)
    row, term = np.nonzero(np.c_[x, ~x])
    machine = toxicity.learn(row.astype(np.int32), term, y, epochs=300)
    assert ((machine.scores(row, term, len(y)) > 0.5) == (y == 1)).all()
    assert machine.factors[:, 0] @ machine.factors[:, 1] > 0


def test_the_least_of_several_texts_is_learned(spark):
    docs = spark.createDataFrame([(3, "b b b"), (3, "a a a"), (6, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (6, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r.text for r in toxicity.labelled(docs, labels, "toxic", 10, 4, 5).collect()}
    assert got[3] == "a a a"


def test_every_row_has_a_score_and_the_fold_is_by_id(scored):
    got, rows = scored
    assert len(got) == len(rows) + 4
    assert got[5000].score == got[5001].score
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    got = toxicity.score(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(got) == 2 and all(r.predicted == 0 for r in got)
    assert toxicity.score(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).collect() == []
