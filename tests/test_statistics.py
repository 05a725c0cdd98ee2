"""Distribution tails against the JVM's, and tests against textbook formulas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulith.functions import tails
from tabulith.operators import hypothesis as H


def test_tails_against_the_jvm(spark):
    d = spark._jvm.org.apache.commons.math3.distribution
    for t, dof in ((0.0, 5.0), (1.3, 3.0), (2.7, 41.5), (-4.0, 900.0), (0.7, 1.0)):
        want = 2 * (1 - d.TDistribution(dof).cumulativeProbability(abs(t)))
        assert tails.t_two_sided(t, dof) == pytest.approx(want, abs=1e-12)
    for f, a, b in ((0.5, 2.0, 9.0), (3.2, 4.0, 700.0), (1.0, 1.0, 1.0), (1.2, 60.0, 40.0)):
        assert tails.f_upper(f, a, b) == pytest.approx(1 - d.FDistribution(a, b).cumulativeProbability(f), abs=1e-10)
    for x, k in ((0.1, 1.0), (3.84, 1.0), (30.0, 17.0), (1100.0, 1000.0), (0.0, 3.0)):
        want = 1 - d.ChiSquaredDistribution(k).cumulativeProbability(x) if x else 1.0
        assert tails.chi2_upper(x, k) == pytest.approx(want, abs=1e-10)


def test_log_normal_cdf_is_smooth_in_the_tail():
    assert tails.log_normal_cdf(0.0) == pytest.approx(math.log(0.5))
    assert tails.log_normal_cdf(-30.0) == pytest.approx(tails.log_normal_cdf(-29.999999), rel=1e-6)
    assert tails.log_normal_cdf(9.0) == pytest.approx(0.0, abs=1e-15)
    assert tails.log_normal_cdf(-1000.0) < -499_000


def test_log_normal_cdf_of_arrays():
    z = np.array([-20.0, -6.0, -2.6, -2.4, -1.0, 0.0, 0.3, 2.4, 2.6, 4.0])
    want = [math.log(0.5 * math.erfc(-v / math.sqrt(2.0))) for v in z]
    assert tails.log_normal_cdf(z) == pytest.approx(want, rel=1e-12)


def test_normal_quantile(spark):
    from statistics import NormalDist
    p = [1e-300, 1e-20, 1e-9, 0.01, 0.07, 0.3, 0.5, 0.6, 0.93, 0.999, 1 - 1e-12]
    got = spark.createDataFrame([(v,) for v in p], "p double").select(tails.normal_quantile(F.col("p"))).collect()
    assert [r[0] for r in got] == pytest.approx([NormalDist().inv_cdf(v) for v in p], rel=1e-12)


def test_shapiro_known_samples(spark):
    rng = np.random.default_rng(0)
    samples = {"a": [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0], "b": rng.normal(size=2000),
               "c": rng.exponential(size=200), "d": [1.0] * 9, "e": [1.0] * 7}
    df = spark.createDataFrame([(k, float(v)) for k, x in samples.items() for v in x], "k string, x double")
    got = {r["k"]: r for r in H.shapiro_wilk(df, "x", ["k"]).collect()}
    assert got["a"]["statistic"] == pytest.approx(0.79, abs=0.005) and got["a"]["p_value"] == pytest.approx(0.0067, abs=0.0008)
    assert got["b"]["p_value"] > 0.05 and got["c"]["p_value"] < 1e-6
    assert got["d"]["statistic"] == 1.0 and "e" not in got


def test_shapiro_without_a_cap(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "x": np.concatenate([rng.normal(size=5000), 8 + rng.normal(size=5000)])}))
    row = H.shapiro_wilk(df, "x", ["k"]).first()
    assert row["n"] == 10_000 and row["statistic"] < 0.9 and row["p_value"] is None and not row["p_valid"]


def test_anderson_textbook(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(10, 3, 500), 1)  # with ties
    z = np.sort((x - x.mean()) / x.std(ddof=1))
    n = len(z)
    lo = np.array([tails.log_normal_cdf(v) for v in z])
    hi = np.array([tails.log_normal_cdf(-v) for v in z])
    i = np.arange(1, n + 1)
    want = -n - np.sum((2 * i - 1) * (lo + hi[::-1])) / n
    got = H.anderson_darling(spark.createDataFrame(pd.DataFrame({"x": x})), "x").first()
    assert got["statistic"] == pytest.approx(want, abs=1e-4) and got["is_normal"]
    assert H.anderson_darling(spark.createDataFrame([(1.0,)] * 3, "x double"), "x").count() == 0


def test_welch_and_limits(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 9.0], [2.0, 4.0, 6.0, 8.0, 10.0, 12.0]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b] + [("c", 1.0), (None, 5.0)], "g string, v double")
    row = H.welch_t(df, "v", "g", "a", "b").first()
    va, vb = np.var(a, ddof=1) / 5, np.var(b, ddof=1) / 6
    assert row["statistic"] == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt(va + vb), abs=1e-4)
    assert 0.05 < row["p_value"] < 0.2 and not row["significant"]
    assert H.welch_t(df, "v", "g", "a", "c").count() == 0


def test_anova_skips_single_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 7.0), ("c", 100.0)], "g string, v double")
    row = H.anova(df, "v", "g").first()
    assert row["n_groups"] == 2 and row["f_statistic"] == pytest.approx(16.2, abs=1e-4)
    assert H.anova(df.where("g = 'a'"), "v", "g").count() == 0


def test_chi_square_yates_and_empty_cells(spark):
    cells = {("x", "p"): 10, ("x", "q"): 20, ("y", "p"): 30, ("y", "q"): 5}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "a string, b string")
    o = np.array([[10, 20], [30, 5.0]])
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    row = H.chi_square(df, "a", "b").first()
    assert row["dof"] == 1 and row["chi2_statistic"] == pytest.approx(((abs(o - e) - 0.5) ** 2 / e).sum(), abs=1e-4)
    three = spark.createDataFrame([("x", "p")] * 4 + [("y", "q")] * 5 + [("z", "r")] * 6, "a string, b string")
    assert H.chi_square(three, "a", "b").first()["chi2_statistic"] == pytest.approx(30.0)
    assert H.chi_square(three.where("a = 'x'"), "a", "b").first()["dof"] == 0


def test_linear_regression(spark):
    exact = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(6)], "x double, y double")
    row = H.linear_regression(exact, "x", "y").first()
    assert (row["slope"], row["intercept"], row["r_squared"], row["p_value"]) == (2.0, 1.0, 1.0, 0.0)
    assert H.linear_regression(exact.limit(4), "x", "y").count() == 0
    flat = H.linear_regression(exact.selectExpr("1.0D AS x", "y"), "x", "y").first()
    assert flat["slope"] is None


def test_normality_per_column(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"i": range(400), "n": rng.normal(size=400), "e": rng.exponential(size=400)})
    got = {r["column"]: r["is_normal"] for r in H.normality_all(spark.createDataFrame(pdf), ["n", "e"]).collect()}
    assert got == {"n": True, "e": False}
