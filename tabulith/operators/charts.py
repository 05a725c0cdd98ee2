"""The data behind each chart: aggregated in Spark to what a picture can show."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.functions.columns import number, ratio
from tabulith.functions.kinds import numeric_columns, present, require_columns, require_numeric
from tabulith.operators.aggregation import simple_agg
from tabulith.operators.anomalies import column_bounds
from tabulith.operators.hypothesis import linear_regression
from tabulith.operators.moments import with_quantiles
from tabulith.operators.ordering import lay_out, running_total, sorted_rows
from tabulith.operators.profiling import missing_matrix
from tabulith.operators.selection import bin_number, bin_range
from tabulith.operators.sorting import systematic_sample
from tabulith.operators.windows import pareto_curve
from tabulith.session import lookup

SCATTER_COLUMNS = 5
RADAR_COLUMNS = 8


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin, its edges and count; empty bins are kept."""
    require_numeric(df, column)
    span = bin_range(df, column)
    spark = df.sparkSession
    if span is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, count long")
    lo, hi = span
    width = (hi - lo) / bins
    counts = (df.select(bin_number(number(column), lo, hi, bins).alias("bin")).where("bin IS NOT NULL")
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    frame = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))  # one row per bin
    return (frame.join(F.broadcast(counts), "bin", "left")
            .select("bin", (lo + (F.col("bin") - 1) * width).alias("lo"), (lo + F.col("bin") * width).alias("hi"),
                    F.coalesce("count", F.lit(0)).alias("count")))


def _fences(df: DataFrame, column: str, group: str) -> DataFrame:
    quart = with_quantiles(df.transform(present, group), [column], (0.25, 0.5, 0.75), ("q1", "median", "q3"), [group])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return lookup(quart.select(group, "q1", "median", "q3", (F.col("q1") - reach).alias("_lo"),
                               (F.col("q3") + reach).alias("_hi")))


def box_stats(df: DataFrame, column: str, group: str) -> DataFrame:
    """Quartiles, whiskers (outermost values inside 1.5 interquartile ranges) and outlier count."""
    require_numeric(df, column)
    x = number(column)
    inside = x.between(F.col("_lo"), F.col("_hi"))
    return (df.select(group, column).join(_fences(df, column, group), group)
            .groupBy(group, "q1", "median", "q3").agg(
                F.count(x).alias("n"), F.min(F.when(inside, x)).alias("whisker_low"),
                F.max(F.when(inside, x)).alias("whisker_high"), F.count_if(~inside).alias("outliers")))


def box_outliers(df: DataFrame, column: str, group: str) -> DataFrame:
    """The rows drawn as single points."""
    x = number(column)
    return (df.join(_fences(df, column, group), group)
            .where((x < F.col("_lo")) | (x > F.col("_hi"))).select(*df.columns))


def category_share(df: DataFrame, category: str, value: str) -> DataFrame:
    """Sum per category and its share of the total in percent."""
    sums = df.transform(present, category).groupBy(category).agg(simple_agg("sum", value).alias("total"))
    whole = sums.agg(F.sum("total")).first()[0] or 0.0
    return sums.withColumn("share_pct", ratio(F.col("total"), F.lit(whole)) * 100.0)


def radar_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Means of the named columns, or else of the first 8 numeric ones, scaled so that the largest has size 100."""
    names = list(columns or numeric_columns(df)[:RADAR_COLUMNS])
    means = df.agg(*[F.avg(number(c)).alias(f"_m{i}") for i, c in enumerate(names)])
    size = F.array_max(F.transform(F.array(*[f"_m{i}" for i in range(len(names))]), F.abs))
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("mean"),
                      (ratio(F.col(f"_m{i}"), size) * 100.0).alias("scaled")) for i, c in enumerate(names)]
    return means.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def waterfall(df: DataFrame, step: str, value: str) -> DataFrame:
    """Signed steps in order with where each starts and ends, then the total."""
    sums = df.transform(present, step).groupBy(F.col(step).alias("step")).agg(simple_agg("sum", value).alias("value"))
    laid = running_total(lay_out(sums, ["step"]), "value", "end")
    steps = laid.select(F.col("step").cast("string").alias("step"), F.lit("relative").alias("measure"), "value",
                        (F.col("end") - F.col("value")).alias("start"), "end")
    whole = laid.agg(F.sum("value").alias("value")).select(
        F.lit("total").alias("step"), F.lit("total").alias("measure"), "value", F.lit(0.0).alias("start"),
        F.col("value").alias("end"))
    return steps.unionByName(whole)


def funnel(df: DataFrame, stage: str, value: str, stages: Sequence[str] | None = None) -> DataFrame:
    """Value per stage and its share of the first stage: the first of ``stages``, or the largest."""
    sums = df.transform(present, stage).groupBy(stage).agg(simple_agg("sum", value).alias("value"))
    if stages:
        sums = sums.where(F.col(stage).isin(*stages))
        first = sums.where(F.col(stage) == stages[0]).agg(F.max("value")).first()[0] or 0.0
    else:
        first = sums.agg(F.max("value")).first()[0] or 0.0
    return sums.withColumn("share_of_first_pct", ratio(F.col("value"), F.lit(first)) * 100.0)


def hierarchy_rollup(df: DataFrame, path: Sequence[str], value: str) -> DataFrame:
    """Sums at every level of the path; ``level`` counts the path columns in use."""
    require_columns(df, *path)
    rows = df.transform(present, *path)
    depth = sum((1 - F.grouping(c).cast("int") for c in path), F.lit(0))
    return rows.rollup(*path).agg(depth.alias("level"), simple_agg("sum", value).alias("total")).where("level > 0")


def scatter_sample(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None,
                   points: int = 5_000) -> DataFrame:
    """The named columns, or else the first 5 numeric ones, of about ``points`` rows, picked by the first digits of the
    key text's md5, so the same rows come back on every run and in other engines."""
    names = list(columns or numeric_columns(df)[:SCATTER_COLUMNS])
    n = df.count()
    slots = 16 ** 7
    share = min(1.0, points / n) if n else 1.0
    digits = F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key])), 1, 7)
    return df.where(F.conv(digits, 16, 10).cast("long") < int(share * slots)).select(*names)


def composition_over_time(df: DataFrame, date: str, category: str, value: str, unit: str = "month") -> DataFrame:
    """Sum per period and category, with the share of the period."""
    cells = df.transform(present, date, category).groupBy(
        F.date_trunc(unit, date).cast("timestamp_ntz").alias("period"), category).agg(
        simple_agg("sum", value).alias("total"))
    whole = cells.groupBy("period").agg(F.sum("total").alias("_whole"))
    return (cells.join(whole, "period")
            .select("period", category, "total", (ratio(F.col("total"), F.col("_whole")) * 100.0).alias("share_pct")))


def missing_heatmap(df: DataFrame, order_by: Sequence[str], size: int = 100) -> DataFrame:
    """Every n-th row's missing cells in long form: ordinal, column, missing (0/1)."""
    marks = systematic_sample(missing_matrix(df, list(order_by)).select(
        *order_by, *[c for c in df.columns if c not in order_by]), order_by, size)
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("int").alias("missing"))
             for c in df.columns if c not in order_by]
    return marks.select("ordinal", F.explode(F.array(*cells)).alias("c")).select("ordinal", "c.*")


def regression_line(df: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """``points`` evenly spaced x over the range of the data with the fitted y. The line uses the
    reported (4-place) slope and intercept."""
    fit = linear_regression(df, x, y)
    span = df.agg(F.min(number(x)).alias("lo"), F.max(number(x)).alias("hi")).first()
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    lo, hi = span["lo"], span["hi"]
    if lo is None:
        return fit.select(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).where(F.lit(False))
    step = (hi - lo) / max(points - 1, 1)
    return (fit.where("slope IS NOT NULL").select("slope", "intercept", i.alias("i"))
            .withColumn("x", F.lit(lo) + F.col("i") * F.lit(step))
            .select("x", (F.col("slope") * F.col("x") + F.col("intercept")).alias("y")))


def anomaly_overlay(df: DataFrame, x: str, y: str, method: str = "zscore", threshold: float = 2.0) -> DataFrame:
    """x, y and whether y is an anomaly."""
    bounds = column_bounds(df, method, threshold, [y])
    flag = bounds[0].test() if bounds else F.lit(False)
    return df.select(x, y, flag.alias("is_anomaly"))


def time_series_line(df: DataFrame, date: str, value: str, unit: str | None = None) -> DataFrame:
    """The rows with both values by date; with a ``unit`` the mean, extremes and count per period."""
    require_numeric(df, value)
    rows = df.select(date, value).where(F.col(date).isNotNull() & number(value).isNotNull())
    if unit is None:
        return sorted_rows(rows, date)
    x = number(value)
    return (rows.groupBy(F.date_trunc(unit, date).cast("timestamp_ntz").alias("period"))
            .agg(F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("n"))
            .orderBy("period"))


__all__ = ["anomaly_overlay", "box_outliers", "box_stats", "category_share", "composition_over_time", "funnel",
           "hierarchy_rollup", "histogram", "missing_heatmap", "pareto_curve", "radar_profile", "regression_line",
           "scatter_sample", "time_series_line", "waterfall"]
