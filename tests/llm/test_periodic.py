import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import periodic


def brute_runs(words, exponent=3, least=24):
    n, found = len(words), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                part = words[i : j + q]
                if not any(all(part[x] == part[x + p] for x in range(len(part) - p)) for p in range(1, q)):
                    found.add((i, j - i + q, q))
            i = max(i + 1, j)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            out, word = out + [word] * bool(word), ""
        else:
            word += c
    return out + [word] * bool(word)


def planted(key, words):
    h, n = zlib.crc32(str(key).encode()), len(words)
    g = h // 10
    if key is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def made_text(rng):
    out = []
    for _ in range(rng.randint(0, 5)):
        out += [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))] * rng.randint(1, 14) + [rng.choice("abcdefghijklmn") for _ in range(rng.randint(0, 10))]
    return " ".join(out)


RNG = random.Random(7)
TEXTS = [None, "", " \n", "a " * 23, "a " * 24, "ab cd\n" * 40, "x " * 5_000, "a b " * 11 + "a", "c d " * 30, *(made_text(RNG) for _ in range(150))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i, "clash") for i, t in enumerate(TEXTS)] + [(None, "a b " * 40, 0, "clash"), (3, "x y z " * 20, 0, "clash"), (3, "x y z " * 20, 0, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, _runs string")


@pytest.mark.parametrize("long_chars", [periodic.LONG_CHARS, 60])
def test_runs_and_texts_against_brute_force(docs, long_chars):
    got = periodic.collapse_runs(docs, rewrite=periodic.planted_repeats, long_chars=long_chars, range_lags=7)
    assert got.columns == ["doc_id", "text", "a.b", "_runs", "_collapsed"]
    want = []
    for key, text, _, _ in docs.collect():
        words = planted(key, words_of(text))
        runs = brute_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        want.append((str(key), [tuple(r) for r in runs], collapsed(words, runs)))
    assert sorted((str(r[0]), [tuple(x) for x in r["_runs"]], r["_collapsed"]) for r in got.collect()) == sorted(want)


def test_strongest_and_lists(docs):
    got = periodic.collapse_runs(docs).select("_runs", periodic.strongest().alias("best"), F.sha2(periodic.listed().cast("binary"), 256).alias("sha")).collect()
    for runs, best, sha in got:
        runs = [tuple(r) for r in runs]
        assert (tuple(best) if best else None) == min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        assert sha == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()


def test_empty_table(docs):
    assert periodic.collapse_runs(docs.limit(0)).count() == 0


def test_ranges_of_lags_add_up():
    rng = random.Random(3)
    texts = [np.array([rng.randint(0, 2) for _ in range(200)] + [1, 2, 3, 4, 5, 6, 7] * 30, np.int32) for _ in range(5)]
    whole = periodic.runs_of(texts, 1, 1 << 40)
    parts = [periodic.runs_of(texts, a, a + 4) for a in range(1, 200, 5)]
    for i, runs in enumerate(whole):
        assert sorted(map(tuple, runs.tolist())) == sorted(tuple(r) for p in parts for r in p[i].tolist())


def test_one_word_a_hundred_thousand_times():
    assert periodic.runs_of([np.zeros(100_000, np.int32)], 1, 1 << 40)[0].tolist() == [[0, 100_000, 1]]
