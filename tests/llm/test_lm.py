import math
import re
import zlib
from collections import Counter

import pandas as pd
import pytest

from gleaner.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lowered), None]


def brute(rows):
    train = [(i, t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    one, two = Counter(), Counter()
    for _, t in train:
        ts = tokens(t)
        one.update(ts)
        two.update(zip([None, *ts], ts))
    return one, two, sum(one.values())


@pytest.fixture(scope="module")
def rows():
    words = ["The", "the", "a", "cat", "dog", "ran", "über", "x\x1cy"]
    texts = [" ".join(words[(i * j + i) % 8] for j in range(i % 23)) for i in range(300)]
    return [*enumerate(texts), (None, "the cat"), (5, None), (7, ""), (7, ""), (900, "the \t\n cat" * 5000)]


def test_counts_and_base_match_brute_force(spark, rows):
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    one, _, n = brute(rows)
    key = lambda i, held, k, known, base: (-1 if i is None else i, held, k, known, round(base, 6))
    want = sorted(
        key(i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, len(ts := tokens(t)), sum(w in one for w in ts), sum(math.log10((one[w] + 0.1) / (n + 0.1 * (len(one) + 1))) for w in ts))
        for i, t in rows
    )
    assert sorted(key(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    assert all(r.score < 0 for r in got)


def test_model_beats_unigrams_on_held_out_texts(spark, rows):
    got = [r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out and r.n_tokens > 3]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def bins(p):
    return min(round(-lm.STEPS * math.log10(p)), lm.LAST - 1) if p > 0 else lm.LAST


def frame(hist):
    return pd.DataFrame([(*k, c) for k, c in hist.items()], columns=["bucket", "one", "two", "n"])


def test_scores_match_brute_force(spark, rows):
    """Counts of words, pairs and triples, weights and scores by plain loops over the texts."""
    got = {(-1 if r.doc_id is None else r.doc_id, r.n_tokens): r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    one, two, n = brute(rows)
    train = [tokens(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    three = Counter(x for ts in train for x in zip([None, *ts], ts, ts[1:]))
    v = len(one)
    bucket = lambda c: math.frexp(c)[1]
    hist = Counter()
    for ts in train:
        for a, b in zip([None, *ts], ts):
            hist[(bucket(one[a] - 1), bins((one[b] - 1) / (n - 1)), bins((two[a, b] - 1) / (one[a] - 1) if one[a] > 1 else 0))] += 1
    weights = lm.learn_weights(frame(hist), v)

    def p2(a, b, less):
        w = weights[bucket(one[a] - less)]
        return w @ [1 / (v + 1), (one[b] - less) / (n - less), (two[a, b] - less) / max(1, one[a] - less)]

    hist = Counter()
    for ts in train:
        for u, a, b in zip([None, *ts], ts, ts[1:]):
            if two[u, a] > 1:
                hist[(bucket(two[u, a]), bins(p2(a, b, 1)), bins((three[u, a, b] - 1) / (two[u, a] - 1)))] += 1
    of_triples = lm.learn_triple_weights(frame(hist))
    assert of_triples[2:].max() > 0.1 and of_triples[:2].max() == 0
    for i, t in rows:
        ts = tokens(t)
        want = math.log10(p2(None, ts[0], 0))
        for u, a, b in zip([None, *ts], ts, ts[1:]):
            l3 = of_triples[bucket(two[u, a])]
            want += math.log10(l3 * three[u, a, b] / max(1, two[u, a]) + (1 - l3) * p2(a, b, 0))
        assert got[(-1 if i is None else i), len(ts)] == pytest.approx(want, rel=1e-5, abs=1e-4)


def test_many_chunks_and_ranges_count_alike(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows[:200], "doc_id long, text string").repartition(4)
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.score, 6))
    once = sorted(map(key, lm.score(docs).collect()))
    monkeypatch.setattr(lm, "CHUNK_BYTES", 300)
    monkeypatch.setattr(lm, "RANGE_KEYS", 50)
    assert sorted(map(key, lm.score(docs).collect())) == once


def test_no_table_stays_in_the_catalogue(spark, rows):
    lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lm_")]


def test_empty_table(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_packed_integers_come_back():
    import numpy as np

    for kind in (np.int32, np.uint64, np.int64):
        x = np.arange(1000).astype(kind) * kind(7)
        assert (lm.get(lm.put(x), kind, len(x)) == x).all()
    assert len(lm.get(lm.put(np.zeros(0, np.int64)), np.int64, 0)) == 0
