import numpy as np
import pytest
from check_oracle import compare, duck

from tabulith.llm import topk as T
from tabulith.llm.registry import ORACLES

SCHEMA = "vec_id long, embedding array<float>, label int, distance double, ring string"


def brute_force(rows, every, k, scale):
    use = [(i, np.floor(scale * np.array(v, np.float64)).astype(np.int64)) for i, v in rows
           if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in use), default=0)
    use = {(i, tuple(np.pad(v, (0, width - len(v))).tolist())) for i, v in use}
    out = []
    for i, v in use:
        if i % every == 0:
            scored = sorted((-int(np.dot(v, w)), j) for j, w in use if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clusters", "norms", "ties"])
def test_equals_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    if kind == "clusters":
        x = rng.normal(size=(12, 8))[rng.integers(0, 12, 900)] + 0.05 * rng.normal(size=(900, 8))
    elif kind == "norms":
        x = rng.normal(size=(700, 5)) * np.exp(2 * rng.normal(size=(700, 1)))
    else:
        x = rng.integers(-1, 2, (800, 3)) / 2
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 0, 1.0, "r") for i, v in rows], SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in T.top_k(df, lambda v: v % 10 == 0).collect())
    assert got == brute_force(rows, 10, 5, 256.0)


def test_small_blocks_and_many_rings(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_ROWS", 10)
    monkeypatch.setattr(T, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 4)).astype(np.float32))]
    df = spark.createDataFrame([(i, v, 0, 1.0, "r") for i, v in rows], SCHEMA)
    assert sorted(tuple(r) for r in T.top_k(df, lambda v: v % 7 == 0).collect()) == brute_force(rows, 7, 5, 256.0)


def test_nothing_that_grows_is_sent_to_the_driver(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 16)).astype(np.float32))]
    found = T.top_k(spark.createDataFrame([(i, v, 0, 1.0, "r") for i, v in rows], SCHEMA), lambda v: v % 10 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute_force(rows, 10, 5, 256.0)
    # queries times the rings that they visit
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("scale", [1.0, 256.0, 1e6, 1e9])
def test_all_widths_of_integers(spark, scale):
    x = np.random.default_rng(6).normal(size=(60, 3))
    rows = [(i, v.tolist()) for i, v in enumerate((2.5 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))]
    rows += [(60, rows[0][1]), (61, rows[1][1][:2]), (62, [])]
    df = spark.createDataFrame([(i, v, 0, 1.0, "r") for i, v in rows], SCHEMA)
    assert sorted(tuple(r) for r in T.top_k(df, lambda v: v % 20 == 0, 3, scale).collect()) == brute_force(rows, 20, 3, scale)


def test_edge_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.5]), (2, None), (3, [None, 1.0]),
            (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [2.0, 9.0]), (7, []), (150, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, 1.0, "r") for i, v in rows], SCHEMA)
    got = sorted(tuple(r) for r in T.top_k(df, lambda v: v % 50 == 0).collect())
    assert got == brute_force(rows, 50, 5, 256.0) and len(got) == 4 * 5
    two = df.where("vec_id in (0, 6)")
    assert [tuple(r) for r in T.top_k(two, lambda v: v % 50 == 0).collect()] == [(0, 1, 6, 2 * 256 * 256)]
    assert T.top_k(df.where("false"), lambda v: v % 50 == 0).count() == 0
    assert T.top_k(df.where("vec_id = 2"), lambda v: v % 50 == 0).count() == 0


def test_equals_sql(spark, sf):
    assert compare(T.op6(spark, sf), duck(sf), ORACLES["op6_pivot_distance_top_k"]) is None


def test_products_beyond_floating_point():
    big = np.array([[1 << 30, 3]], np.int64)
    assert T._product(big, big).tolist() == [[(1 << 60) + 9]]
