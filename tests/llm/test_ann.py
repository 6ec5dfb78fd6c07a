import numpy as np
import pytest

from corpusloom.llm.ann import CONFIDENCE, DIMS, Chunk, Splits, chi_square_quantile, kd_leaves, nearest, projection

DDL = "vec_id long, embedding array<float>, score int"


def brute(ids, x, k, every):
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            s = np.zeros(len(x))
            for j in range(x.shape[1]):
                s += x[:, j] * x[i, j]
            rows = [r for r in np.lexsort((ids, -s)) if ids[r] != q][:k]
            out[q] = [(int(ids[r]), float(s[r])) for r in rows]
    return out


def found(df, **kw):
    out = {}
    for r in nearest(df, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("unit", [True, False])
def test_recall(spark, unit):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(1500, 16)) + 3 * rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)]).astype(np.float32)
    if unit:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[200:500] = x[199]  # many copies of one vector
    ids = rng.permutation(3000)[:1500]
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], DDL)
    got, want = found(df), brute(ids, x.astype(float), 20, 20)
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.97
    exact = {q: dict(brute_q) for q, brute_q in brute(ids, x.astype(float), len(ids), 20).items()}
    assert all(exact[q][i] == s for q in got for i, s in got[q])
    assert all(got[q] == sorted(got[q], key=lambda p: (-p[1], p[0])) for q in got)


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (8, []), (40, [float("nan"), 0.0])]
    got = found(spark.createDataFrame([(*r, 0) for r in rows], DDL))
    assert got == {0: [(1, 0.5), (20, 0.0)], 20: [(1, 1.0), (0, 0.0)]}
    assert found(spark.createDataFrame([], DDL)) == {}
    assert found(spark.createDataFrame([(20, [1.0], 0)], DDL)) == {}


def test_parts():
    assert chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3) and chi_square_quantile(0.99, 8) == pytest.approx(20.09, abs=1e-2)
    points = np.random.default_rng(0).normal(size=(1000, 8))
    leaves = kd_leaves(points, 100)
    assert sorted(np.concatenate(leaves)) == list(range(1000)) and max(map(len, leaves)) <= 100
    cells = Splits(points, 16).cell(points)
    assert np.bincount(cells, minlength=16).min() > 40


def test_the_stop_spares_rows(tmp_path):
    """Vectors with little contrast, as hard as they come: a fifth of all pairs isn't verified, and nine of ten neighbours are found."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    points = x @ projection(64)[:-1]
    Chunk.build(str(tmp_path / "c.npz"), np.arange(8000), x, points)
    chunk, queries = Chunk(str(tmp_path / "c.npz")), np.arange(0, 8000, 100)
    quantile = chi_square_quantile(CONFIDENCE, DIMS)
    found = chunk.search(queries, x[queries], points[queries], np.full(80, 2.0), np.full(80, -np.inf), 20, quantile)
    scores = x[queries] @ x.T
    scores[np.arange(80), queries] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(set(ids.tolist()) & set(w.tolist())) / 20 for (ids, _), w in zip(found, want)]) >= 0.9
    assert chunk.verified < 0.8 * 80 * 8000


def test_lengths_are_searched_apart(spark):
    rows = [(20, [1.0, 0.0]), (1, [1.0, 1.0]), (40, [1.0]), (2, [3.0]), (3, [4.0]), (60, [1.0, 1.0, 1.0])]
    assert found(spark.createDataFrame([(*r, 0) for r in rows], DDL)) == {20: [(1, 1.0)], 40: [(3, 4.0), (2, 3.0)]}
