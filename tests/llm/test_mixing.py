import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.llm import mixing

SCHEMA = "doc_id long, text string, source string, copy_no string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(1, 50), "big" if rng.random() < 0.6 else rng.choice(["a", "b", None]), "old") for i in range(3000)]
    return rows + [(7, "twin", "a", "old"), (7, "twin", "a", "old"), (None, None, "a", "old"), (9000, "", "b", "old")]


def counts(rows, weights=None):
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += max(1, len(t or ""))
    w = {s: (weights.get(s, 0.0) if weights is not None else n**0.5) for s, n in size.items()}
    out = Counter()
    for i, _, s, _ in rows:
        rate = sum(size.values()) * w[s] / sum(w.values()) / size[s]
        u = int(hashlib.md5(f"mix-1:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate)
        k = 0
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        out[i, s] += k if rate else 0
    return {k: n for k, n in out.items() if n}


def test_counts_are_poisson_quantiles(spark, rows):
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.source) for r in got) == counts(rows)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.source, r.text), []).append(r.copy_no)
    assert all(set(v) == set(range(max(v) + 1)) for v in by.values())


def test_given_weights_are_met(spark, rows):
    weights = {"big": 1.0, "a": 3.0}
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights).collect()
    assert Counter((r.doc_id, r.source) for r in got) == counts(rows, weights)
    chars = Counter()
    for r in got:
        chars[r.source] += len(r.text or "")
    assert set(chars) == {"big", "a"} and 2.4 < chars["a"] / chars["big"] < 3.6


def test_order_is_shuffled_and_repeats(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    once, twice = ([(r.doc_id, r.copy_no) for r in mixing.mix(docs).collect()] for _ in range(2))
    assert once == twice and once != sorted(once, key=str)


def test_rows_of_one_id_are_dealt_over_all_tasks(spark):
    rows = [(None, "x", "s", "c") for _ in range(400)] + [(5, "y", "s", "c") for _ in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = mixing.mix(docs, {"s": 1.0}).select("doc_id", F.spark_partition_id().alias("p")).distinct().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(n == 8 for n in Counter(r.doc_id for r in got).values())


def test_columns_of_the_input_may_have_any_name(spark):
    docs = spark.createDataFrame([(i, "x", "s", 1, 2, 3, 4) for i in range(50)], "doc_id long, text string, source string, _rate int, _source int, _n int, _place int")
    got = mixing.mix(docs)
    assert got.columns == [*docs.columns, "copy_no"]
    assert {(r["_rate"], r["_source"], r["_n"], r["_place"]) for r in got.collect()} == {(1, 2, 3, 4)}


def test_large_rates(spark):
    u = [0.0, 1e-12, 0.5, 0.999999]
    got = spark.createDataFrame([(x, 50.0) for x in u], "u double, r double").select(mixing.poisson_quantile(F.col("u"), F.col("r")).alias("k")).collect()
    assert [r.k for r in got][2] == 50 and all(0 <= r.k < 150 for r in got)


def test_rates_beyond_a_double(spark):
    def brute(u, rate):
        c, k = 0.0, -1
        while c <= u:
            k += 1
            c += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        return k

    cases = [(u, rate) for u in (0.001, 0.3, 0.5, 0.99) for rate in (399.0, 401.0, 2000.5, 20_000.0)]
    got = spark.createDataFrame(cases, "u double, r double").select(mixing.poisson_quantile(F.col("u"), F.col("r")).alias("k")).collect()
    assert [r.k for r in got] == [brute(*c) for c in cases]


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
