import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.llm import whitening
from tabulith.llm.whitening import rank_one_update, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component string, n string"


@pytest.fixture(scope="session")
def vectors(spark):
    return lambda rows: spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x", "c", "n")
                                               for i, v in rows], SCHEMA)


def whole(v):
    return np.floor(64 * np.asarray(v, np.float32).astype(float)).astype(np.int64) + 1_000_000


def check(df, rows, components=16):
    """Against numpy over the distinct whole vectors."""
    x = np.array([whole(v) for _, v in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    v = np.cov((fit - 1_000_000).T.astype(float), bias=True).reshape(fit.shape[1], -1)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    keep = min(components, int((e > len(e) * np.finfo(float).eps * e.sum()).sum()))
    found = {}
    for r in df.collect():
        found.setdefault((r.vec_id, r.component), []).append(r)
    assert len(found) == len({i for i, _ in rows}) * keep
    mean = sums / n
    one = next(iter(found.values()))[0]
    assert one.n == n and one.identity_error < 1e-9
    for c in range(keep):
        want = (x - mean) @ q[:, c] / np.sqrt(e[c])
        got = np.array([found[i, c + 1][0].whitened for i, _ in rows])
        gap = min(abs(e[c] - e[k]) for k in range(len(e)) if k != c) if len(e) > 1 else e[c]
        if gap > 1e-6 * e[0]:  # else any basis of the equal eigenvalues is right
            assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-7
        assert abs(found[rows[0][0], c + 1][0].explained - e[c] / e.sum()) < 1e-9
    for (i, _), row in zip(rows, x):
        assert found[i, 1][0].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums))


@pytest.mark.parametrize("n, dims, spread", [(300, 8, 1.0), (40, 24, 1.0), (2000, 20, 3.0)])
def test_as_numpy(vectors, n, dims, spread, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 64)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(n)
    points = rng.standard_normal((n, dims)) * np.exp(-np.arange(dims) / spread)
    rows = [(i, p) for i, p in enumerate(points)]
    rows += [(n + i, points[0]) for i in range(n // 2)]  # copies count once in the fit
    check(whiten(vectors(rows).repartition(7)), rows)


def test_equal_eigenvalues_and_zero_directions(vectors):
    rows = [(2 * d + k, [0.0] * d + [s] + [0.0] * (5 - d)) for d in range(4) for k, s in enumerate((1.0, -1.0))]
    got = whiten(vectors(rows)).collect()
    assert {r.component for r in got} == {1, 2, 3, 4} and got[0].identity_error < 1e-12
    # two of six dimensions don't vary: four components, all equal
    assert all(abs(r.explained - 0.25) < 1e-12 for r in got)


def test_rank_one_updates():
    rng = np.random.default_rng(1)
    for case in range(60):
        d = int(rng.integers(1, 30))
        values, vectors, total = np.zeros(d), np.eye(d), np.zeros((d, d))
        for k in range(40):
            v = rng.standard_normal(d) * 10.0 ** rng.integers(-6, 6)
            if case % 3 == 0:
                v[rng.random(d) < 0.7] = 0.0
            if case % 3 == 1:
                v = np.round(v / max(np.abs(v).max(), 1e-300))
            values, vectors = rank_one_update(values, vectors, v)
            total += np.outer(v, v)
        size = np.linalg.norm(total) or 1.0
        assert np.abs(vectors @ np.diag(values) @ vectors.T - total).max() < 1e-12 * size
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-11 and (np.diff(values) >= 0).all()


def test_odd_rows(vectors):
    good = [(1, [1, 2]), (2, [3, -1]), (3, [0, 0]), (3, [0, 0]), (None, [5, 5])]
    bad = [(4, None), (5, []), (6, [1, None]), (7, [float("nan"), 1]), (8, [float("inf"), 1]), (9, [1, 2, 3])]
    got = whiten(vectors(good + bad)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i or 0, c) for i, _ in good for c in (1, 2))
    assert whiten(vectors([])).collect() == [] and whiten(vectors(bad[:3])).collect() == []
    assert whiten(vectors([(1, [1, 2])] * 3)).collect() == []  # one distinct vector has no spread
    huge = whiten(vectors([(1, [1e30, 0]), (2, [-1e30, 1]), (3, [0, 2])])).collect()
    assert {r.deviation for r in huge if r.vec_id != 3} == {None} and all(np.isfinite(r.whitened) for r in huge)


def test_layout_does_not_matter(vectors):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(6)) for i in range(200)]
    one, many = (sorted((r.vec_id, r.component, abs(r.whitened)) for r in whiten(vectors(rows).repartition(k)).collect()) for k in (1, 9))
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 for a, b in zip(one, many))
    assert whiten(vectors(rows), components=2).agg(F.max("component")).first()[0] == 2
