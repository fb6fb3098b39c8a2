import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import jaccard, linkage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """Links, groups and what stays, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := [j for j in near[todo.pop()] if j not in seen])
            seen |= set(new)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids) if ids else None))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(3000)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(6, 300))]
        for c in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(int(len(text) * 0.01 * c)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(" ".join(text))
    rows += rows[:10] + ["one two", "one two", "two one", "one\ttwo", None, "", " \n", "a", "a"] + ["x " * 60_000, "x " * 59_999]
    rng.shuffle(rows)
    out = [*enumerate(rows)] + [(3, rows[3]), (None, rows[4]), (None, "only null id")]
    return out


key = lambda x: (str(x[0]), x[1], str(x[2]))


def test_matches_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "c", "d") for i, t in rows], "doc_id long, text string, class string, paths string")
    got = jaccard.near_duplicates(docs).collect()
    assert sorted(map(key, ((r.doc_id, r.n_links, r.class_id) for r in got))) == sorted(map(key, brute(rows)))
    groups = {}
    for r in got:
        if r.n_links:
            groups.setdefault(r.class_id, []).append(r.kept)
        else:
            assert r.kept
    assert all(sum(k) == 1 for k in groups.values())


def test_large_groups_are_dealt_over_chunks(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "LOOSE_ROWS", 3)
    monkeypatch.setattr(jaccard, "EXACT_ROWS", 2)
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_links, r.class_id) for r in jaccard.near_duplicates(docs).collect()]
    assert sorted(map(key, got)) == sorted(map(key, brute(rows)))


def test_carried_columns_come_back(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "s1", 7), (2, "a b c d e f g", None, 8), (None, None, "s3", 9)], "doc_id long, text string, source string, class int")
    got = jaccard.near_duplicates(docs, carry=docs.columns).where("kept").select(*docs.columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, [r for r in docs.collect() if r.doc_id != 2]))


def test_depths_follow_from_the_recall():
    assert jaccard.depth_for(0.8, 24, 4, 0.5) == 4
    d = jaccard.depth_for(0.8)
    assert jaccard.found(0.8, d) >= jaccard.RECALL > jaccard.found(0.8, d + 1)
    assert jaccard.depth_for(0.01, 1, 4, 0.9) == 1
    assert jaccard.enough(0.8, d) == 1 and 20 < jaccard.enough(0.8, d + 1) < 40
    k = jaccard.enough(0.8, 4) - 1
    assert (k + 1) / (k + 1 / jaccard.found(0.8, 4)) == pytest.approx(jaccard.RECALL, abs=1e-12)


def test_texts_stop_at_different_depths(spark):
    """Members of a large group stop at whole paths, those of small ones and texts that are alone at shorter prefixes."""
    rng = random.Random(3)
    words = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(999)) for _ in range(n)]
    large, small = words(200), words(200)
    texts = [" ".join([*large[:-1], f"end{i}"]) for i in range(60)] + [" ".join([*small[:-1], f"end{i}"]) for i in range(3)]
    texts += [" ".join(words(50)) for _ in range(40)]
    signed = jaccard.paths(pa.array(texts)).to_pylist()
    classes = spark.createDataFrame([(str(i).encode(), p) for i, p in enumerate(signed)], "class binary, paths array<long>")
    got = {int(r.node): r for r in jaccard.forest(classes).collect()}
    assert {got[i].stop for i in range(60)} == {4} and {got[i].n for i in range(60)} == {60}
    assert {got[i].stop for i in range(60, 63)} == {3} and {got[i].n for i in range(60, 63)} == {3}
    assert set(got) == set(range(63))


def test_links_that_only_shorter_prefixes_show(spark):
    """Pairs that share no whole path but a prefix are found once it is shortened, also where one of them has stopped."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 16, (jaccard.TREES, jaccard.DEPTH), dtype=np.uint16)
    other = base.copy()
    other[:, 0] += 1  # the last minimum of each path
    copies = [base.copy() for _ in range(50)]
    for i, c in enumerate(copies):
        c[i % 4, 1] = i
    path = lambda x: np.ascontiguousarray(x).view(np.int64).ravel().tolist()
    rows = [(f"c{i:02}".encode(), path(c)) for i, c in enumerate(copies)] + [(b"z", path(other))]
    got = {bytes(r.node): r for r in jaccard.forest(spark.createDataFrame(rows, "class binary, paths array<long>")).collect()}
    assert len(got) == 51 and {r.n for r in got.values()} == {51}
    assert {r.stop for k, r in got.items() if k != b"z"} == {4} and got[b"z"].stop == 3


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1200)]
    got = {r.node: r.root for r in linkage.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if all(label[a] == label[b] for a, b in edges):
            break
    assert got == {x: r for x, r in label.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_connect_and_spread_agree():
    rng = np.random.default_rng(3)
    for n in (0, 1, 40):
        linked = rng.random((n, n)) < 0.03
        linked |= linked.T
        assert (linkage.connect(n, lambda i, others: linked[i, others]) == linkage.spread(linked)).all()


def test_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_columns_of_the_input_may_have_any_name(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", 7, 8, 9), (2, "one two three four five six", 7, 8, 9)], "doc_id long, text string, kept int, `a.b` int, _text int")
    found = jaccard.near_duplicates(docs, carry=docs.columns)
    assert found.columns == ["doc_id", "text", "a.b", "_text", "n_links", "class_id", "kept"]
    assert sorted(tuple(r) for r in found.collect()) == [(1, "one two three four five six", 8, 9, 1, 1, True), (2, "one two three four five six", 8, 9, 1, 1, False)]
    assert [tuple(r) for r in jaccard.kept_documents(docs).collect()] == [(1, "one two three four five six", 7, 8, 9)]
