"""Statistical tests: one distributed aggregate each, then a p-value from the one result row."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.functions.columns import half_even, number
from tabulith.functions.kinds import numeric_columns, present, require_columns, require_numeric
from tabulith.functions.tails import chi2_upper, f_upper, log_normal_cdf, normal_quantile, t_two_sided
from tabulith.operators.moments import value_positions

ALPHA = 0.05
SHAPIRO_P_ROWS = 5_000  # the approximation of p is published up to this size
_RANKS = 1 << 16
_MIN_NORMALITY = 8

# Anderson-Darling critical values for 15, 10, 5, 2.5 and 1 % with estimated mean
# and deviation (Stephens 1974).
STEPHENS = ((15.0, 0.576), (10.0, 0.656), (5.0, 0.787), (2.5, 0.918), (1.0, 1.092))

# Polynomial coefficients, highest power first, of Royston's extension of the W test (AS R94, 1995).
_A_LAST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0)
_A_SECOND = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)
_SMALL_MEAN = (-6.714e-4, 0.025054, -0.39978, 0.5440)
_SMALL_LOG_SD = (-0.0020322, 0.062767, -0.77857, 1.3822)
_LARGE_MEAN = (0.0038915, -0.083751, -0.31082, -1.5861)
_LARGE_LOG_SD = (0.0030302, -0.082676, -0.4803)
_SMALL_SHIFT = (0.459, -2.273)


def _significant(p: float | None) -> bool | None:
    return None if p is None else p < ALPHA


def _row(df: DataFrame, schema: str, values: Sequence | None) -> DataFrame:
    return df.sparkSession.createDataFrame([] if values is None else [tuple(values)], schema)


def anderson_darling(df: DataFrame, column: str) -> DataFrame:
    """A² against a normal law with estimated mean and deviation, its 5 % critical value and verdict.

    Equal values share one row with their rank range, so the sum over ranks is a sum over distinct
    values: for ranks a+1..a+c the weights 2i-1 add up to (a+c)² - a².
    """
    require_numeric(df, column)
    schema = "column string, n long, statistic double, critical_5 double, is_normal boolean"
    n, mean, std = df.agg(F.count(number(column)), F.avg(number(column)), F.stddev_samp(number(column))).first()
    if n < _MIN_NORMALITY or not std:
        return _row(df, schema, None)

    @F.pandas_udf("lo double, hi double")
    def log_cdf(z: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"lo": log_normal_cdf(z.to_numpy()), "hi": log_normal_cdf(-z.to_numpy())})

    ranked = value_positions(df, column)
    z = (F.col("value") - mean) / std
    a, c, total = F.col("before").cast("double"), F.col("cnt").cast("double"), F.lit(float(n))
    low = (a + c) * (a + c) - a * a
    high = (total - a) * (total - a) - (total - a - c) * (total - a - c)
    s = ranked.withColumn("log", log_cdf(z)).agg(
        F.sum(low * F.col("log.lo") + high * F.col("log.hi"))).first()[0]
    stat = -n - s / n
    critical = round(dict(STEPHENS)[5.0] / (1.0 + 4.0 / n - 25.0 / n / n), 3)
    return _row(df, schema, (column, n, round(stat, 4), critical, stat < critical))


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


@F.pandas_udf(T.DoubleType())
def _shapiro_p(w: pd.Series, n: pd.Series) -> pd.Series:
    """p of W for samples of 8 values or more (Royston 1995)."""
    y, size = np.log(np.maximum(1.0 - w.to_numpy(), 1e-300)), n.to_numpy(dtype="float64")
    small, log_n = size <= 11, np.log(size)
    gap = np.polyval(_SMALL_SHIFT, size)
    beyond = small & (y >= gap)
    turned = -np.log(np.where(small & ~beyond, gap - y, 1.0))
    mean = np.where(small, np.polyval(_SMALL_MEAN, size), np.polyval(_LARGE_MEAN, log_n))
    spread = np.exp(np.where(small, np.polyval(_SMALL_LOG_SD, size), np.polyval(_LARGE_LOG_SD, log_n)))
    p = np.exp(log_normal_cdf(-(np.where(small, turned, y) - mean) / spread))
    return pd.Series(np.where(beyond, 1e-99, p))


def shapiro_wilk(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, statistic, p_value, p_valid: one W test per group over all its values, for groups of 8 or more.

    W is a ratio of sums over ranks, so it is one aggregate over the ranked values; equal values share a rank range that
    is unrolled piece by piece. ``p_value`` is null and ``p_valid`` false beyond the size that its approximation is for.
    """
    require_numeric(df, column)
    ranked = value_positions(df, column, keys).where(F.col("n") >= _MIN_NORMALITY)
    pieces = ranked.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(cnt - 1) div {_RANKS}"))))
    low = F.col("before") + F.col("piece") * _RANKS + 1
    rows = pieces.withColumn("i", F.explode(F.sequence(low, F.least(F.col("before") + F.col("cnt"), low + (_RANKS - 1)))))
    m = normal_quantile((F.col("i") - 0.375) / (F.col("n") + 0.25))
    x, i, n = F.col("value"), F.col("i"), F.col("n")
    at = lambda place, what: F.max(F.when(i == place, what))
    sums = rows.withColumn("m", m).groupBy(*keys, "n").agg(
        F.sum(F.col("m") * F.col("m")).alias("ss"), F.sum(F.col("m") * x).alias("mx"), F.var_samp(x).alias("var"),
        at(1, x).alias("x1"), at(2, x).alias("x2"), at(n - 1, x).alias("x3"), at(n, x).alias("x4"),
        at(n - 1, F.col("m")).alias("m3"), at(n, F.col("m")).alias("m4"))
    u = 1.0 / F.sqrt(n.cast("double"))
    last = _polynomial(_A_LAST, u) + F.col("m4") / F.sqrt("ss")
    second = _polynomial(_A_SECOND, u) + F.col("m3") / F.sqrt("ss")
    wide, narrow = F.col("x4") - F.col("x1"), F.col("x3") - F.col("x2")
    m3, m4 = F.col("m3"), F.col("m4")
    phi = (F.col("ss") - 2 * m4 * m4 - 2 * m3 * m3) / (1.0 - 2 * last * last - 2 * second * second)
    inner = (F.col("mx") - m4 * wide - m3 * narrow) / F.sqrt(phi) + last * wide + second * narrow
    w = F.when(F.col("var") > 0, F.least(inner * inner / (F.col("var") * (n - 1)), F.lit(1.0))).otherwise(1.0)
    valid = n <= SHAPIRO_P_ROWS
    out = sums.select(*keys, "n", w.alias("statistic"), F.col("var"), valid.alias("p_valid"))
    p = F.when(F.col("p_valid"), F.when(F.col("var") > 0, _shapiro_p("statistic", "n")).otherwise(1.0))
    return out.withColumn("p_value", p).select(*keys, "n", "statistic", "p_value", "p_valid")


def shapiro_wilk_by_group(df: DataFrame, column: str, group: str) -> DataFrame:
    """One W test per group over all its values; groups below 8 values and null groups have none."""
    out = shapiro_wilk(df.transform(present, group), column, [group])
    return out.select(group, "n", half_even(F.col("statistic"), 4).alias("statistic"),
                      half_even(F.col("p_value"), 4).alias("p_value"), "p_valid", (F.col("p_value") > ALPHA).alias("is_normal"))


def normality_all(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The W test for every numeric column: the columns are the groups of a melted table."""
    names = list(columns or numeric_columns(df))
    cells = [F.struct(F.lit(c).alias("column"), number(c).alias("value")) for c in names]
    return shapiro_wilk_by_group(df.select(F.explode(F.array(*cells)).alias("c")).select("c.*"), "value", "column")


def normality_test(df: DataFrame, column: str, test: str = "shapiro") -> DataFrame:
    if test == "anderson":
        return anderson_darling(df, column)
    if test != "shapiro":
        raise ValueError(f"unknown test {test!r}; use shapiro or anderson")
    return normality_all(df, [column])


def welch_t(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """Two-sample t test without equal variances; empty below 3 values in either group."""
    require_numeric(df, value)
    require_columns(df, group)
    schema = ("group1 string, group1_mean double, group1_n long, group2 string, group2_mean double, group2_n long, "
              "statistic double, p_value double, significant boolean")
    x = number(value)
    side = F.when(F.col(group) == F.lit(first), 1).when(F.col(group) == F.lit(second), 2)
    rows = (df.select(side.alias("side"), x.alias("x")).where("side IS NOT NULL AND x IS NOT NULL")
            .groupBy("side").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v")).collect())
    by = {r["side"]: r for r in rows}
    if len(by) < 2 or min(r["n"] for r in rows) < 3:
        return _row(df, schema, None)
    a, b = by[1], by[2]
    va, vb = a["v"] / a["n"], b["v"] / b["n"]
    t = p = None
    if va + vb > 0:
        t = (a["m"] - b["m"]) / math.sqrt(va + vb)
        dof = (va + vb) ** 2 / (va ** 2 / (a["n"] - 1) + vb ** 2 / (b["n"] - 1))
        p = t_two_sided(t, dof)
    return _row(df, schema, (str(first), round(a["m"], 2), a["n"], str(second), round(b["m"], 2), b["n"],
                             t if t is None else round(t, 4), p if p is None else round(p, 4), _significant(p)))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way F test over the groups with at least 2 values; empty below 2 groups."""
    require_numeric(df, value)
    require_columns(df, group)
    schema = "n_groups long, f_statistic double, p_value double, significant boolean"
    x = number(value)
    groups = (df.where(F.col(group).isNotNull()).groupBy(group)
              .agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v")).where("n >= 2"))
    # between-group squares as a weighted variance of the group means, which is stable
    n, m = F.col("n").cast("double"), F.col("m")
    k, total, mean, within = groups.agg(
        F.count(F.lit(1)), F.sum(n), F.sum(n * m) / F.nullif(F.sum(n), F.lit(0.0)),
        F.sum(F.col("v") * (n - 1))).first()
    if not k or k < 2:
        return _row(df, schema, None)
    between = groups.agg(F.sum(n * (m - F.lit(mean)) * (m - F.lit(mean)))).first()[0]
    f = p = None
    if within > 0:
        f = (between / (k - 1)) / (within / (total - k))
        p = f_upper(f, k - 1, total - k)
    return _row(df, schema, (k, f if f is None else round(f, 4), p if p is None else round(p, 4), _significant(p)))


def chi_square(df: DataFrame, first: str, second: str) -> DataFrame:
    """Independence of two columns; with one degree of freedom Yates' correction applies.

    Cells never seen count too: they have no row, but their expectation enters through the
    margins, so no table of all combinations is built. Without the correction the statistic is
    n * (sum O² / (R C) - 1).
    """
    require_columns(df, first, second)
    schema = "chi2_statistic double, p_value double, dof long, significant boolean"
    cells = df.transform(present, first, second).groupBy(first, second).agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy(first).agg(F.sum("o").alias("r"))
    cols = cells.groupBy(second).agg(F.sum("o").alias("c"))
    k1, n = rows.agg(F.count(F.lit(1)), F.sum("r")).first()
    k2 = cols.count()
    dof = (k1 - 1) * (k2 - 1)
    if not n or dof == 0:
        return _row(df, schema, (0.0, 1.0, 0, False) if n else None)
    joined = cells.join(rows, first).join(cols, second)
    o, r, c = (F.col(x).cast("double") for x in ("o", "r", "c"))
    if dof == 1:
        found = joined.select("o", "r", "c", first, second).collect()  # at most 4 cells
        r1 = {x[first]: x["r"] for x in found}
        c1 = {x[second]: x["c"] for x in found}
        seen = {(x[first], x[second]): x["o"] for x in found}
        stat = 0.0
        for i, ri in r1.items():
            for j, cj in c1.items():
                expected = ri * cj / n
                off = abs(seen.get((i, j), 0) - expected)
                stat += (off - min(0.5, off)) ** 2 / expected
    else:
        stat = n * (joined.agg(F.sum(o * o / (r * c))).first()[0] - 1.0)
    p = chi2_upper(stat, dof)
    return _row(df, schema, (round(stat, 4), round(p, 4), dof, _significant(p)))


def linear_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares line with r, r², two-sided p, standard error and a label; empty below 5 rows."""
    require_numeric(df, x, y)
    schema = ("x_column string, y_column string, n_points long, slope double, intercept double, r_value double, "
              "r_squared double, p_value double, std_error double, significant boolean, equation string, "
              "interpretation string")
    a, b = number(x), number(y)
    both = a.isNotNull() & b.isNotNull()
    n, mx, my, sxx, syy, sxy = df.where(both).agg(
        F.count(a), F.avg(a), F.avg(b), F.regr_sxx(b, a), F.regr_syy(b, a), F.regr_sxy(b, a)).first()
    if n < 5:
        return _row(df, schema, None)
    if not sxx:
        return _row(df, schema, (x, y, n, *[None] * 7, None, "x is constant"))
    slope = sxy / sxx
    intercept = my - slope * mx
    r = max(-1.0, min(1.0, sxy / math.sqrt(sxx * syy))) if syy else 0.0
    rest = max(1.0 - r * r, 0.0)
    error = math.sqrt(rest * syy / sxx / (n - 2))
    p = t_two_sided(r * math.sqrt((n - 2) / rest), n - 2) if rest else 0.0
    # fixed output texts
    label = ("Strong linear relationship" if r * r > 0.5 else "Weak linear relationship" if r * r > 0.1
             else "No meaningful linear relationship")
    return _row(df, schema, (
        x, y, n, round(slope, 4), round(intercept, 4), round(r, 4), round(r * r, 4), round(p, 4), round(error, 4),
        _significant(p), f"y = {slope:.4f}x + {intercept:.4f}", label))
