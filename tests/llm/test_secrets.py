import re
import time

import pytest
from pyspark.sql import functions as F

from gleaner.llm import secrets

PATTERNS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def base(text):
    found = [(m.start(), r, m.end(), name) for r, (name, p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


TEXTS = [
    None, "", "plain words only", "AKIA" + "B" * 16, "AKIAAKIA12 AKIA" + "C" * 14 + "x", "secret=token:abcdefghijklmnop", "Password : 'short' PASSWD=\"0123456789abcdef0\"",
    "é😀 api_key=zzzzzzzzzzzzzzz 😀 deadbeefdeadbeef00 end", "token==abc=def/ghi+jkl", "aws AKIA" + "D" * 16, "aws AKIA" + "D" * 16, "x" * 200_000 + " secret= 0a1b2c3d4e5f6a7b8c", "ghp_" + "a1B2" * 9,
    "api-key=abcdefghijklmn apikey=abcdefghijklmn", "0123456789abcde 0123456789abcdef", "secret=" * 2000,
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, f"src{i % 3}", "clash") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, spans string")
    return secrets.scan(docs, "doc_id", "source", ["doc_id"]).collect()


def test_base_spans_match_python(found):
    assert len(found) == len(TEXTS)
    for r in found:
        got = ",".join(f"{s['kind']}:{s['start']}:{s['stop']}" for s in r["_spans"] if s["rank"] < 3)
        assert got == base(TEXTS[r.doc_id]), r.doc_id


def test_ownership_separates_copies_from_single_owners(spark):
    rows = [(i, "key AKIA" + "E" * 14 + "F1", f"o{i % 5}") for i in range(40)] + [(100, "password=q9w8e7r6t5y4u3", "o1"), (101, "password=q9w8e7r6t5y4u3", "o1")]
    got = {r.doc_id: (r.n_live, r.n_shared) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "source", ["doc_id"]).collect()}
    assert got[3] == (0, 1) and got[100] == got[101] == (1, 0)


def test_repositories_of_one_owner_count(spark):
    few, many = "password=q9w8e7r6t5y4u3", "password=k1j2h3g4f5d6s7"
    rows = [(i, many, "one") for i in range(secrets.SHARED_REPOSITORIES)] + [(100 + i, few, "one") for i in range(secrets.SHARED_REPOSITORIES - 1)] + [(100, few, "one")] * 5 + [(300, f"{few} {many} x", "one"), (400, "none", "one")]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "source", ["doc_id"]).collect()
    got = {r.doc_id: (r.n_live, r.n_shared, r.most_owners, r.most_repositories) for r in found}
    assert got[0] == (0, 1, 1, 21) and got[100] == (0, 1, 1, 20) and got[300] == (0, 2, 1, 21) and got[400] == (0, 0, 0, 0)
    fewer = [r for r in rows if r[0] not in (100, 101, 300)]
    found = secrets.scan(spark.createDataFrame(fewer, "doc_id long, text string, source string"), "doc_id", "source", ["doc_id"]).collect()
    assert {(r.n_live, r.n_shared, r.most_repositories) for r in found if r.doc_id > 101 and r.doc_id < 200} == {(1, 0, 17)}


def test_mask_takes_out_the_values(spark):
    cases = {
        "a password=q9w8e7r6t5y4u3 b AKIA" + "Z" * 16: "a password=<SECRET> b <SECRET>",
        "The secret: never give up": "The secret: never give up",
        "api_key : 'abcdefghijklmnop' AKIAshort": "api_key : '<SECRET>' AKIAshort",
        "deadbeefdeadbeef00 xoxb-1234567890ab": "<SECRET> <SECRET>",
        "": "",
        None: None,
    }
    got = secrets.mask(spark.createDataFrame([*enumerate(cases)], "i int, text string")).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.i)] == list(cases.values())


def test_many_hits_in_a_text(spark):
    text = "deadbeefdeadbeef0 " * 100_000
    began = time.perf_counter()
    row = secrets.scan(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string"), "doc_id", "source", ["doc_id"]).select("n_shared", F.size("_spans").alias("n"), F.element_at("_spans", -1).alias("last")).first()
    assert row.n == 100_000 and (row["last"].start, row["last"].stop) == (18 * 99_999, 18 * 99_999 + 17)
    assert time.perf_counter() - began < 60


def test_columns_of_the_input_may_have_any_name(spark):
    docs = spark.createDataFrame([(1, "secret=abcdefghijklmnop", "s", 2, 3)], "doc_id long, text string, source string, _spans int, _owner int")
    row = secrets.scan(docs, "doc_id", "source", ["doc_id", "_owner", "_spans"]).first()
    assert row["_owner"] == 3 and len(row["_spans"]) == 1


def test_empty_table(spark):
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string, source string"), "doc_id", "source", ["doc_id"]).collect() == []
