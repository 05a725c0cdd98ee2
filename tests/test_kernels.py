"""Row order, quantiles and ranks, with hot values, hot groups and many partitions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulith.operators import moments as M
from tabulith.operators import ordering as O
from tabulith.operators import windows as X


@pytest.fixture(scope="module")
def skewed():
    """20,000 rows; a third of them share one key and one value."""
    rng = np.random.default_rng(3)
    n = 20_000
    hot = rng.random(n) < 1 / 3
    return pd.DataFrame({
        "id": np.arange(n), "k": np.where(hot, "hot", rng.choice(list("abcdefgh"), n)),
        "v": np.where(rng.random(n) < 1 / 3, 7.25, rng.normal(100, 30, n).round(3)),
        "t": rng.integers(0, 400, n)})


def spread(spark, pdf, parts=7):
    return spark.createDataFrame(pdf).repartition(parts)


@pytest.fixture(scope="module")
def many_partitions(spark):
    """Keep the adaptive planner from merging the small partitions of these tests."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ordinal_is_the_sort_position(spark, skewed, many_partitions):
    out = O.with_ordinal(spread(spark, skewed), ["t", "id"]).toPandas().sort_values("ordinal")
    want = skewed.sort_values(["t", "id"])
    assert list(out["ordinal"]) == list(range(len(skewed)))
    assert list(out["id"]) == list(want["id"])


def test_layout_uses_many_partitions_for_one_hot_value(spark, skewed, many_partitions):
    laid = O.lay_out(spread(spark, skewed.assign(t=1)), ["t", "id"])
    sizes = [r["count"] for r in laid.groupBy("_part").count().collect()]
    assert len(sizes) > 4 and max(sizes) < len(skewed) / 2


def test_running_total_and_previous(spark, skewed, many_partitions):
    laid = O.lay_out(spread(spark, skewed), ["t", "id"])
    want = skewed.sort_values(["t", "id"])
    got = O.running_total(laid, "v", "s").toPandas().sort_values(["t", "id"])
    assert np.allclose(got["s"], want["v"].cumsum())
    got = O.previous_value(laid, "v", "p").toPandas().sort_values(["t", "id"])
    assert np.array_equal(got["p"].to_numpy(), want["v"].shift().to_numpy(), equal_nan=True)


def test_fill_both_ways(spark, skewed, many_partitions):
    holes = skewed.copy()
    holes.loc[holes.id < 3000, "v"] = np.nan  # nothing to carry forward at the start
    holes.loc[holes.id % 5 != 0, "v"] = np.nan
    df = spread(spark, holes).withColumn("v", F.nanvl("v", F.lit(None)))
    got = O.fill_both_ways(O.lay_out(df, ["id"]), ["v"]).toPandas().sort_values("id")
    assert np.array_equal(got["v"].to_numpy(), holes["v"].ffill().bfill().to_numpy())


def test_steps_along_a_layout_shuffle_nothing_again(spark, skewed):
    """Of the written rows only one row per partition is exchanged."""
    laid = O.lay_out(spread(spark, skewed), ["t", "id"])
    for out in (O.running_total(laid, "v", "s"), O.previous_value(laid, "v", "p"), O.fill_both_ways(laid, ["v"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        # the windows stand above the aggregate that has one row per partition
        assert windows and "MapInArrow" in plan and all("_pos" not in w for w in windows)
        physical = out._jdf.queryExecution().executedPlan().toString()
        main = physical[:physical.index("BroadcastExchange")]
        assert "Exchange hashpartitioning" not in main and "Sort [" not in main


def test_steps_in_tiny_batches(spark, skewed):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        part = skewed.head(2000).copy()
        part.loc[part.id % 3 > 0, "v"] = np.nan
        df = spread(spark, part).withColumn("v", F.nanvl("v", F.lit(None)))
        want = part.sort_values(["t", "id"])["v"]
        laid = O.lay_out(df, ["t", "id"])
        for out, expected in ((O.running_total(laid, "v", "x"), want.fillna(0).cumsum()), (O.previous_value(laid, "v", "x"), want.shift()),
                              (O.fill_both_ways(laid.withColumn("x", F.col("v")), ["x"]), want.ffill().bfill())):
            got = out.toPandas().sort_values(["t", "id"])["x"].to_numpy(dtype=float)
            assert np.allclose(got, expected.to_numpy(), equal_nan=True)
        none = O.lay_out(df.limit(0), ["t", "id"])
        assert O.running_total(none, "v", "x").count() == O.fill_both_ways(none, ["v"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("divisor", [5, 10, 1])
def test_head_and_tail_means(spark, skewed, many_partitions, divisor):
    data = skewed.copy()
    data.loc[data.id % 3 == 0, "t"] = -1
    df = spread(spark, data).withColumn("t", F.when(F.col("t") >= 0, F.col("t")))
    got = {r["column"]: r for r in O.head_tail_means(df, ["v", "t"], ["id"], divisor).collect()}
    for c, x in (("v", data["v"]), ("t", data.loc[data.t >= 0, "t"])):
        n = max(1, len(x) // divisor)
        assert got[c]["n"] == len(x)
        assert got[c]["head_mean"] == pytest.approx(x.head(n).mean())
        assert got[c]["tail_mean"] == pytest.approx(x.tail(n).mean())


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(params=[None, 5])
def rounds(request, monkeypatch):
    """With few steps and small cells every bucket is cut again, several times over."""
    if request.param:
        monkeypatch.setattr(M, "CELL_ROWS", 20)
        monkeypatch.setattr(M, "STEPS", request.param)


def test_quantiles_of_columns(spark, skewed, rounds):
    got = {r["column"]: r["q"] for r in M.quantiles(spread(spark, skewed), ["v", "t"], PROBS).collect()}
    for c in ("v", "t"):
        assert np.allclose(got[c], np.quantile(skewed[c], PROBS), rtol=1e-12)


def test_quantiles_of_groups(spark, skewed, rounds):
    got = M.quantiles(spread(spark, skewed), ["v"], PROBS, ["k"]).collect()
    assert {r["k"] for r in got} == set(skewed["k"])
    for r in got:
        assert np.allclose(r["q"], np.quantile(skewed.loc[skewed.k == r["k"], "v"], PROBS), rtol=1e-12)


def test_quantiles_take_rounds_not_cut_points(spark, skewed, monkeypatch):
    """A second and third look at the rows of full buckets, and none at others."""
    looks = []
    monkeypatch.setattr(M, "CELL_ROWS", 50)
    monkeypatch.setattr(M, "STEPS", 8)
    cut = M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: looks.append(1) or cut(df))
    df = spread(spark, skewed.assign(v=100 + skewed["id"] / 1e4))
    got = M.quantiles(df, ["v"], [0.3]).first()["q"][0]
    assert got == pytest.approx(100 + 0.3 * 19_999 / 1e4, rel=1e-14) and len(looks) >= 3


def test_quantiles_of_far_values(spark, rounds):
    x = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, 1.0, math.nextafter(1.0, 2.0), -3.0, 2.0 ** 52, 2.0 ** 52 + 1] * 9
    df = spark.createDataFrame([(v,) for v in [*x, float("inf"), float("-inf"), float("nan"), None]], "x double").repartition(5)
    want = sorted([*x, float("inf"), float("-inf")])
    probs = [i / (len(want) - 1) for i in range(len(want))]
    assert M.quantiles(df, ["x"], probs).first()["q"] == want


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 1), (10.0, 4)], "x double, w long")
    got = M.quantiles(df, ["x"], [0.25, 0.5, 0.9], weight="w").first()["q"]
    assert np.allclose(got, np.quantile([1.0] * 5 + [2.0] + [10.0] * 4, [0.25, 0.5, 0.9]))


def test_quantiles_of_edge_tables(spark):
    one = spark.createDataFrame([(1.5,), (None,)], "x double")
    assert M.quantiles(one, ["x"], [0.0, 0.5]).first()["q"] == [1.5, 1.5]
    nothing = spark.createDataFrame([(None,)], "x double")
    assert M.quantiles(nothing, ["x"], [0.5]).count() == 0


def test_value_positions(spark, skewed):
    got = M.value_positions(spread(spark, skewed), "v", ["k"]).toPandas()
    for k, part in skewed.groupby("k"):
        mine = got[got.k == k].sort_values("value")
        counts = part["v"].value_counts().sort_index()
        assert list(mine["value"]) == list(counts.index)
        assert list(mine["cnt"]) == list(counts)
        assert list(mine["before"]) == list(counts.cumsum() - counts)
        assert set(mine["n"]) == {len(part)}


def test_moments_match_pandas(spark):
    x = pd.Series([1.0, 2.0, 4.0, 8.0, 16.0])
    got = M.moments(spark.createDataFrame(pd.DataFrame({"x": x})), ["x"]).first()
    assert got["skew"] == pytest.approx(x.skew()) and got["kurt"] == pytest.approx(x.kurt())
    assert got["std"] == pytest.approx(x.std())
    flat = M.moments(spark.createDataFrame([(2.0,)] * 5, "x double"), ["x"]).first()
    assert (flat["skew"], flat["kurt"], flat["std"]) == (0.0, 0.0, 0.0)
    nan = M.moments(spark.createDataFrame([(float("nan"),), (3.0,), (None,)], "x double"), ["x"]).first()
    assert (nan["n"], nan["nulls"], nan["mean"], nan["std"], nan["skew"]) == (1, 2, 3.0, None, None)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ema_and_moving_average(spark, skewed, many_partitions, keys, monkeypatch):
    monkeypatch.setattr(X, "_CHUNK", 500)
    df = spread(spark, skewed)
    ordered = skewed.sort_values([*keys, "t", "id"])
    series = ordered.groupby("k")["v"] if keys else ordered["v"]
    ema = X.ema(df, ["t", "id"], "v", 7, keys).toPandas().sort_values([*keys, "t", "id"])
    want = series.ewm(span=7, adjust=False).mean()
    want = want.reset_index(drop=True).to_numpy()
    assert np.abs(ema["EMA_7"].to_numpy() - want).max() <= 0.005 + 1e-9
    sma = X.moving_average(df, ["t", "id"], "v", 7, keys).toPandas().sort_values([*keys, "t", "id"])
    want = series.rolling(7).mean().reset_index(drop=True).to_numpy()
    assert len(sma) == len(skewed)
    assert np.array_equal(np.isnan(sma["SMA_7"]), np.isnan(want))
    assert np.nanmax(np.abs(sma["SMA_7"].to_numpy() - want)) <= 0.005 + 1e-9


def test_ema_of_one_series_over_tiny_batches(spark, skewed, many_partitions):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        part = skewed.head(3000)
        got = X.ema(spread(spark, part), ["id"], "v", 3, ["k"]).toPandas().sort_values(["k", "id"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = part.sort_values(["k", "id"]).groupby("k")["v"].ewm(span=3, adjust=False).mean().to_numpy()
    assert np.abs(got["EMA_3"].to_numpy() - want).max() <= 0.005 + 1e-9


def test_short_series_have_no_moving_average(spark):
    df = spark.createDataFrame([("a", i, 1.0) for i in range(10)] + [("b", 1, 1.0)], "k string, t int, v double")
    assert {r["k"] for r in X.moving_average(df, ["t"], "v", 3, ["k"]).collect()} == {"a"}
    assert X.moving_average(df.where("k = 'b'"), ["t"], "v", 3).count() == 0


def test_percentile_rank_with_nulls(spark, skewed):
    part = skewed.head(2000).copy()
    part.loc[part.id % 7 == 0, "v"] = np.nan
    part.loc[part.id % 11 == 0, "k"] = None
    df = spark.createDataFrame(part).withColumn("v", F.nanvl("v", F.lit(None)))
    got = X.percentile_rank(df, "v", "k").toPandas().sort_values("id")["v_percentile"].to_numpy()
    want = part.groupby("k")["v"].rank(pct=True).to_numpy() * 100
    assert np.array_equal(np.isnan(got), np.isnan(want))
    assert np.nanmax(np.abs(got - want)) <= 0.05 + 1e-9
