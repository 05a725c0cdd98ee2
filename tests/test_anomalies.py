import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulith.operators import anomalies as A
from tabulith.operators import neighbours as N
from tabulith.operators.forest import isolation_forest
from tabulith.plans.overview import anomaly_flow, contamination_for


def brute_force_lof(x, k):
    x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, axis=1)
    reach = np.maximum(dist, dist[:, -1][near])
    lrd = 1 / (reach.mean(axis=1) + 1e-10)
    return -(lrd[near].mean(axis=1) / lrd)


@pytest.mark.parametrize("leaf_rows", [2_000, 40])
def test_lof_is_exact(spark, leaf_rows):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (300, 3)), rng.normal(8, 0.2, (100, 3)), [[30, 30, 30]]])
    pdf = pd.DataFrame(x, columns=list("abc")).assign(id=range(len(x)))
    out = N.lof(spark.createDataFrame(pdf), list("abc"), 0.05, 15, leaf_rows=leaf_rows).toPandas().sort_values("id")
    assert np.allclose(out["lof_score"], brute_force_lof(x, 15), rtol=1e-9)
    assert out["is_anomaly"].iloc[-1] and out["is_anomaly"].sum() == pytest.approx(0.05 * len(x), abs=2)


@pytest.mark.parametrize("leaf_rows", [2_000, 30])
def test_lof_counts_copies(spark, leaf_rows):
    """A third of the rows are one point, and one point has fewer copies than neighbours."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (120, 2)), np.tile([[0.5, 0.5]], (80, 1)), np.tile([[3.0, 3.0]], (5, 1))])
    pdf = pd.DataFrame(x, columns=list("ab")).assign(id=range(len(x)))
    out = N.lof(spark.createDataFrame(pdf), list("ab"), 0.1, 10, leaf_rows=leaf_rows).toPandas().sort_values("id")
    assert np.allclose(out["lof_score"], brute_force_lof(x, 10), rtol=1e-6)


@pytest.mark.parametrize("queries_per_task", [50_000, 60])
def test_lof_in_two_levels(spark, monkeypatch, queries_per_task):
    """Two leaves at the top, both overfull: each gets a sub-tree, and its points are placed and searched in several tasks."""
    monkeypatch.setattr(N, "UPPER_LEAVES", 2)
    monkeypatch.setattr(N, "_QUERIES_PER_TASK", queries_per_task)
    built, sub_trees = [], N._sub_trees
    monkeypatch.setattr(N, "_sub_trees", lambda *a: built.append(sub_trees(*a)) or built[-1])
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(0, 1, (500, 2)), rng.normal(6, 0.2, (300, 2)), [[30.0, 30.0]]])
    out = N.lof(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])), n_neighbors=10, leaf_rows=40).toPandas()
    keyed = out.set_index(["a", "b"])["lof_score"]
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = brute_force_lof(z, 10)
    assert np.allclose([keyed[tuple(v)] for v in x], want, rtol=1e-6)
    assert built[0].count() == 2


def test_lof_gaps_and_small_tables(spark):
    df = spark.createDataFrame([(float(i), None if i == 3 else float(i * i % 17)) for i in range(40)], "a double, b double")
    out = N.lof(df, n_neighbors=5)
    assert out.count() == 40 and out.where("lof_score IS NULL").count() == 1
    assert N.lof(df.limit(8)).count() == 0


def test_isolation_forest_finds_planted_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (3000, 3))
    x[:20] = rng.normal(12, 1, (20, 3))
    pdf = pd.DataFrame(x, columns=list("abc")).assign(id=range(len(x)))
    df = spark.createDataFrame(pdf).withColumn("c", F.when(F.col("id") != 100, F.col("c")))
    out = isolation_forest(df, list("abc"), 0.02).toPandas().set_index("id").sort_index()
    assert out["is_anomaly"].loc[:19].all()
    assert out["is_anomaly"].sum() == pytest.approx(0.02 * 2999, abs=2)
    assert np.isnan(out.loc[100, "anomaly_score"]) and not out.loc[100, "is_anomaly"]
    again = isolation_forest(df, list("abc"), 0.02).toPandas().set_index("id").sort_index()
    assert np.allclose(out["anomaly_score"].drop(100), again["anomaly_score"].drop(100).loc[out.index.drop(100)])
    assert isolation_forest(df.limit(5), list("abc")).count() == 0


def test_isolation_forest_does_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(np.round(rng.normal(0, 1, (1500, 3)), 1), columns=list("abc")).assign(id=range(1500))
    df = spark.createDataFrame(pd.concat([pdf, pdf.assign(a=1.0, b=1.0, c=1.0)]))  # half of all rows are equal
    two, seven = (isolation_forest(df.repartition(n), list("abc")).toPandas().sort_values(["id", "a", "b", "c"]) for n in (2, 7))
    assert np.allclose(two["anomaly_score"], seven["anomaly_score"])
    assert (two["is_anomaly"].to_numpy() == seven["is_anomaly"].to_numpy()).all()


def test_rules_on_flat_and_short_columns(spark):
    flat = spark.createDataFrame([(1.0,)] * 6, "x double")
    assert A.zscore_outliers(flat, "x").count() == 0
    assert A.outliers_all_columns(flat).count() == 0
    short = spark.createDataFrame([(1.0,), (100.0,)], "x double")
    assert A.iqr_outliers(short, "x").count() == 0 and A.zscore_outliers(short, "x").count() == 0
    with pytest.raises(ValueError):
        A.zscore_outliers(spark.createDataFrame([("a",)], "x string"), "x")


def test_iqr_uses_the_sensitivity_as_multiplier(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(20), 38]], "x double")
    assert A.iqr_outliers(df, "x", 1.5).count() == 0 or A.iqr_outliers(df, "x", 1.5).count() == 1
    q1, q3 = np.quantile([*range(20), 38], [0.25, 0.75])
    for m in (0.5, 1.0, 2.0):
        want = sum(v < q1 - m * (q3 - q1) or v > q3 + m * (q3 - q1) for v in [*range(20), 38])
        assert anomaly_flow(df, "iqr", m).columns.agg(F.sum("count")).first()[0] in (want, None if want == 0 else want)


def test_anomalies_are_tagged_per_column(spark):
    df = spark.createDataFrame([(i, float(i), float(i)) for i in range(20)] + [(99, 1000.0, 1000.0)], "id int, a double, b double")
    tagged = A.anomalies_combined(df, "zscore", 3.0).where("id = 99").select("_anomaly_column", "_method").collect()
    assert {(r[0], r[1]) for r in tagged} >= {("a", "Z-Score"), ("b", "Z-Score")}


def test_contamination_clamp():
    assert [contamination_for(s) for s in (2.0, 10.0, 1000.0)] == [0.3, 0.1, 0.01]


def test_small_leaves_share_a_task(spark):
    points = spark.range(1000).selectExpr("id", "array(double(id % 37), double(id div 37)) AS vec", "1L AS m")
    near = N._neighbour_candidates(points, 2, 5, 40)
    assert near.rdd.getNumPartitions() <= 4  # 25 leaves, searched twice
    assert near.select("id").distinct().count() == 1000
