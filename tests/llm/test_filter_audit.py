from collections import Counter
from itertools import permutations

import pytest

from gleaner.llm import filter_audit

LONG = " ".join(f"word{i}" for i in range(220))
DOCS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "de"), (3, LONG + " 5%", "en"), (4, "too short", "en"), (5, "too short", None), (None, "too short", "en"), (6, None, "en"), (7, "", "de"), (8, "SHOUTED WORDS", "fr"),
    (9, "again and " * 150, "en"), (10, "again and " * 150 + "#", "en"), (11, LONG.upper(), "fr"), (12, " ".join(["x"] * 300), "fr"), (12, " ".join(["x"] * 300), "fr"), (-1, LONG, "es"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (4, None, 1), (9, 1, 1), (11, 1, 0), (None, 1, 1), (99, 1, 1)]


def brute(docs, labels):
    def fails(key, text):
        words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
        smaller = [k for k, t, _ in docs if (t or "") == text and k is not None and key is not None and k < key]
        upper = sum("A" <= c <= "Z" for c in text)
        tests = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * upper > 3 * len(text), any(c in "#$%&*|" for c in text), bool(smaller)]
        return {f for f, bad in zip("ABCDE", tests, strict=True) if bad}

    rows = [((p or ""), fails(k, t or ""), k is not None and any(x == k and q == 1 for x, q, _ in labels), k is not None and any(x == k and z == 1 for x, _, z in labels)) for k, t, p in docs]
    out, shapley = {}, Counter()
    for part in {p for p, *_ in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in mine if f in r[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] += len(gone)
    return sorted((*key, *row, shapley[key[0], key[1][key[2] - 1]]) for key, row in out.items())


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, lang string, fails int"), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_all_orders_against_brute_force(tables):
    got = filter_audit.audit(*tables)
    assert sorted(map(tuple, got.collect())) == brute(DOCS, LABELS)


def test_sums_are_handed_on_when_parts_are_many(tables, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS", 1)
    assert sorted(map(tuple, filter_audit.audit(*tables).collect())) == brute(DOCS, LABELS)


def test_empty_tables(spark, tables):
    docs, labels = tables
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert sorted(map(tuple, filter_audit.audit(docs, labels.limit(0)).collect())) == brute(DOCS, [])


def test_table_of_first_failures():
    assert filter_audit.FIRST.shape == (32, 120) and (filter_audit.FIRST[0] == 5).all()
    assert filter_audit.FIRST[0b00101][filter_audit.ORDERS.index("BDCAE")] == 2
