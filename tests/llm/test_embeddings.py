import math
import random

import numpy as np
import pytest

from gleaner.llm import embeddings, linkage


def brute(rows):
    ok = [v is not None and len(v) > 0 and None not in v and all(map(math.isfinite, v)) and any(v) for _, v in rows]
    n = len(rows)

    def near(i, j):
        if i == j or not ok[i] or not ok[j] or len(rows[i][1]) != len(rows[j][1]):
            return False
        a, b = (np.array(rows[k][1], np.float64) for k in (i, j))
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.95

    links = [[j for j in range(n) if near(i, j)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := [j for j in links[todo.pop()] if j not in seen])
            seen |= set(new)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((str(rows[i][0]), len(links[i]), str(min(ids) if ids else None)))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for _ in range(60):
        base = rng.normal(size=48)
        for c in range(rng.integers(1, 7)):
            out.append((base + 0.04 * c * rng.normal(size=48)).astype(np.float32).tolist())
    out += [out[0]] * 20 + [[2 * x for x in out[5]], [-x for x in out[5]], [0.0] * 48, None, [], [1.0, None] + [0.0] * 46, [float("nan")] * 48, [float("inf")] + [1.0] * 47, [1.0], [5.0], [-1.0], [3e38] * 48, [1e38] * 48]
    random.Random(1).shuffle(out)
    return [*enumerate(out)] + [(2, out[2]), (None, out[3]), (None, [0.5, 0.5])]


def run(spark, rows):
    docs = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, digest string, member int")
    return sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embeddings.near_duplicates(docs).collect())


def test_matches_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_large_groups_are_dealt_over_chunks(spark, rows, monkeypatch):
    monkeypatch.setattr(embeddings, "LOOSE_ROWS", 2)
    monkeypatch.setattr(embeddings, "EXACT_ROWS", 2)
    assert run(spark, rows) == brute(rows)


def test_pairs_at_the_threshold_are_found():
    rng = np.random.default_rng(9)
    for width, n in ((64, 50_000), (64, 10**7), (384, 10**6), (5, 1000)):
        a, noise = rng.normal(size=(4000, width)), rng.normal(size=(4000, width))
        a /= np.linalg.norm(a, axis=1)[:, None]
        noise -= (noise * a).sum(1)[:, None] * a
        noise /= np.linalg.norm(noise, axis=1)[:, None]
        b = 0.95 * a + math.sqrt(1 - 0.95**2) * noise
        chosen = embeddings.settings(embeddings.padded(width), n)
        x, y = embeddings.buckets(a, *chosen), embeddings.buckets(b, *chosen)
        met = np.array([bool(set(p) & set(q)) for p, q in zip(x.tolist(), y.tolist())])
        near = np.bitwise_count((embeddings.signs(a) ^ embeddings.signs(b)).view(np.uint64)).sum(1) <= embeddings.APART
        assert (met & near).mean() > 0.998, (width, n, chosen)


def test_more_vectors_join_more_vertices():
    chosen = [embeddings.settings(64, n) for n in (10, 10**5, 10**7, 10**9)]
    assert [c[0] for c in chosen] == [1, 2, 3, 4]


def test_hadamard_is_orthogonal():
    h = embeddings.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, 16 * np.eye(16))


def test_spread_of_sparse_links():
    rng = np.random.default_rng(6)
    for n, m in ((1, 0), (50, 20), (300, 280)):
        a, b = rng.integers(0, n, (2, m))
        linked = np.zeros((n, n), bool)
        linked[a, b] = linked[b, a] = True
        assert (linkage.spread_sparse(n, a, b) == linkage.spread(linked)).all()
    path = np.arange(5000)
    assert (linkage.spread_sparse(5001, path, path + 1) == 0).all()


def test_one_of_a_group_is_kept(spark):
    docs = spark.createDataFrame([(4, [1.0, 0.0]), (4, [1.0, 0.0]), (9, [1.0, 0.01]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.kept) for r in embeddings.near_duplicates(docs).collect())
    assert [g[:2] for g in got] == [(1, 0), (4, 2), (4, 2), (9, 2)] and sum(k for i, _, k in got if i != 1) == 1


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_columns_of_the_input_may_have_any_name(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 7, 8, 9), (2, [1.0, 0.0], 7, 8, 9)], "vec_id long, embedding array<double>, kept int, `a.b` int, _id int")
    found = embeddings.near_duplicates(vectors, carry=vectors.columns)
    assert found.columns == ["vec_id", "embedding", "a.b", "_id", "n_links", "component_id", "kept"]
    assert sorted((r.vec_id, r["a.b"], r["_id"], r.n_links, r.component_id, r.kept) for r in found.collect()) == [(1, 8, 9, 1, 1, True), (2, 8, 9, 1, 1, False)]
