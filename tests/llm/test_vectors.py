import numpy as np
import pytest

from docpipe.llm import vectors as V


def brute(rows, cosine=0.9):
    ids = [i for i, _ in rows]
    ok = [e is not None and len(e) > 0 and all(c is not None and np.isfinite(c) for c in e) and any(e) for _, e in rows]
    near = lambda a, b: ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]) and np.dot(rows[a][1], rows[b][1]) / np.linalg.norm(rows[a][1]) / np.linalg.norm(rows[b][1]) >= cosine
    n = len(rows)
    links = [[j for j in range(n) if j != i and near(i, j)] for i in range(n)]
    low = list(ids)
    for _ in range(n):
        low = [min([low[i], *[low[j] for j in links[i]]]) for i in range(n)]
    return sorted((ids[i], len(links[i]), low[i]) for i in range(n))


def points(n, dim, seed):
    r = np.random.default_rng(seed)
    base = r.normal(size=(12, dim))
    x = base[r.integers(0, 12, n)] + r.normal(size=(n, dim)) * r.choice([0.01, 0.25, 0.33, 0.4, 2.0], n)[:, None]
    return [[float(np.float32(c)) for c in v] for v in x]


@pytest.mark.parametrize(("dim", "part"), [(64, 8192), (16, 8192), (16, 20), (3, 8192), (1, 8192)])
def test_equals_brute_force(spark, monkeypatch, dim, part):
    monkeypatch.setattr(V, "PART", part)
    vecs = points(220, dim, dim)
    vecs[7] = vecs[3]
    rows = list(enumerate(vecs, start=1))
    got = V.Join(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).rows().collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)


def test_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    x = np.array([e for _, e in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: int(n) - 1 for (i, _), n in zip(rows, (x @ x.T >= 0.9).sum(axis=1), strict=True)}
    assert {r.vec_id: r.n_links for r in V.query(spark, "/root/testdata/sf0.001").collect()} == want


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [3.0, 3.0]), (9, [1.0, 1.0, 1.0]), (10, [float("inf"), 1.0]), (11, [-0.0, 1.0]), (12, [0.0, 1.0]), (13, [1e-30, 1e-30])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, key string")
    got = V.Join(df).rows().collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert V.Join(df.where("vec_id = 0")).rows().count() == 0
    assert V.Join(df.union(df.selectExpr("null", "embedding", "label", "key"))).rows().count() == 2 * len(rows)


def test_an_id_with_different_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [1.0, 0.1, 0.0]), (2, [0.0, 0.0, 1.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 0.1, 1.0]), (1, [0.0, 1.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in V.Join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).rows().collect())
    assert got == [(1, 0, 1), (1, 2, 1), (1, 2, 1), (2, 1, 2), (2, 2, 1), (3, 1, 2)]


def test_pairs_left_open_are_verified(spark, monkeypatch):
    monkeypatch.setattr(V, "OPEN", 0.05)  # most links near 0.9 go the way of those that single precision leaves open
    rows = list(enumerate(points(150, 16, 5)))
    got = V.Join(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).rows().collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)


@pytest.mark.parametrize("axes", [0, 512])
def test_spread_axes_and_random_ones(spark, monkeypatch, axes):
    monkeypatch.setattr(V, "AXES_DIM", axes)
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 20)) * np.linspace(4, 0.1, 20)
    x = np.concatenate([x, x[:60] + r.normal(size=(60, 20)) * 0.3])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = V.Join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).rows().collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)


def test_long_vectors(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(4, 30_00))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(np.concatenate([x, x + 0.1 * r.normal(size=x.shape)]))]
    got = V.Join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).rows().collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)


def test_rows_without_an_id_link(spark):
    two = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (None, [1.0, 0.01, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r.n_links, r.component_id) for r in V.Join(two).rows().collect()) == [(1, 1)] * 2
    vecs = points(120, 8, 2)
    rows = [(None if k % 3 == 1 else k, v) for k, v in enumerate(vecs)] + [(None, [9.0] * 5), (None, [9.0] * 5), (None, None)]
    got = V.Join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).linked().collect()
    named = {10**9 + k: None for k in range(len(rows))}
    want = [(named.get(i, i), n, named.get(c, c)) for i, n, c in brute([(10**9 + k if i is None else i, v) for k, (i, v) in enumerate(rows)])]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert all(r.kept is None for r in got if r.vec_id is None)
