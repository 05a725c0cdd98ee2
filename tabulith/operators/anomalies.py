"""Outliers by z-score and interquartile range; each is one statistics pass and one filter."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions.columns import half_even, number
from tabulith.functions.kinds import numeric_columns, present, require_numeric
from tabulith.operators.moments import moments, quantiles
from tabulith.session import lookup

_MIN_VALUES = 5


@dataclass(frozen=True)
class Bounds:
    """Values below ``lower`` or above ``upper`` are anomalies; ``flat`` columns have none."""

    column: str
    lower: float
    upper: float
    method: str
    flat: bool = False

    def test(self) -> Column:
        if self.flat:
            return F.lit(False)
        x = number(self.column)
        return F.coalesce((x < self.lower) | (x > self.upper), F.lit(False))


def zscore_bounds(df: DataFrame, columns: Sequence[str], threshold: float = 2.0) -> list[Bounds]:
    """mean ± threshold * std per column with at least 5 values; one row per column is collected."""
    rows = moments(df, columns).where(F.col("n") >= _MIN_VALUES).select("column", "mean", "std").collect()
    by_name = {r["column"]: (r["mean"], r["std"]) for r in rows}
    out = []
    for c in columns:
        if c in by_name:
            mean, std = by_name[c]
            out.append(Bounds(c, mean - threshold * std, mean + threshold * std, "Z-Score", std == 0))
    return out


def iqr_bounds(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5) -> list[Bounds]:
    enough = {r["column"]: r["n"] for r in
              df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count(number(c)).alias("n")) for c in columns])
                     .alias("a")).select(F.explode("a").alias("c")).select("c.*").collect()}
    out = []
    rows = {r["column"]: r["q"] for r in quantiles(df, columns, (0.25, 0.75)).collect()}
    for c in columns:
        if enough.get(c, 0) >= _MIN_VALUES:
            q1, q3 = rows[c]
            reach = multiplier * (q3 - q1)
            out.append(Bounds(c, q1 - reach, q3 + reach, "IQR"))
    return out


def column_bounds(df: DataFrame, method: str = "zscore", threshold: float = 2.0,
                  columns: Sequence[str] | None = None) -> list[Bounds]:
    """Bounds of all numeric columns; for ``iqr`` the threshold is the multiplier."""
    names = list(columns or numeric_columns(df))
    return (zscore_bounds if method == "zscore" else iqr_bounds)(df, names, threshold)


def zscore_outliers(df: DataFrame, column: str, threshold: float = 2.0) -> DataFrame:
    """Rows more than ``threshold`` standard deviations from the mean, with their ``zscore``."""
    require_numeric(df, column)
    found = moments(df, [column]).where(F.col("n") >= _MIN_VALUES).select("mean", "std").first()
    if found is None or found["std"] == 0:
        return df.withColumn("zscore", F.lit(None).cast("double")).where(F.lit(False))
    mean, std = found["mean"], found["std"]
    z = F.abs((number(column) - mean) / std)
    # the plain bounds reach the file scan; the score itself decides
    slack = threshold * (1 - 1e-9) * std
    near = (F.col(column) < mean - slack) | (F.col(column) > mean + slack)
    return df.where(near).withColumn("zscore", z).where(F.col("zscore") > threshold)


def zscore_outliers_by_group(df: DataFrame, column: str, group: str, threshold: float = 2.0) -> DataFrame:
    """The z-score rule inside each group of at least 5 values."""
    require_numeric(df, column)
    stats = moments(df.transform(present, group), [column], [group]).where(
        (F.col("n") >= _MIN_VALUES) & (F.col("std") > 0)).select(group, "mean", "std")
    z = F.abs((number(column) - F.col("mean")) / F.col("std"))
    return (df.join(lookup(stats), group).withColumn("zscore", z).where(F.col("zscore") > threshold)
            .select(*df.columns, "zscore"))


def iqr_outliers(df: DataFrame, column: str, multiplier: float = 1.5) -> DataFrame:
    """Rows outside [q1 - m * iqr, q3 + m * iqr]."""
    require_numeric(df, column)
    found = iqr_bounds(df, [column], multiplier)
    return df.where(found[0].test() if found else F.lit(False))


def flag_anomalies(df: DataFrame, bounds: Sequence[Bounds]) -> DataFrame:
    """Adds ``{column}_anomaly`` per column; fixed bounds make this a per-row step."""
    return df.withColumns({f"{b.column}_anomaly": b.test() for b in bounds})


def outliers_all_columns(df: DataFrame, method: str = "zscore", threshold: float = 2.0) -> DataFrame:
    """Columns with hits: column, method, count, threshold_lower, threshold_upper."""
    bounds = column_bounds(df, method, threshold)
    return count_hits(df, bounds).where("count > 0")


def count_hits(df: DataFrame, bounds: Sequence[Bounds]) -> DataFrame:
    if not bounds:
        return df.sparkSession.createDataFrame(
            [], "column string, method string, count long, threshold_lower double, threshold_upper double")
    cells = [F.struct(F.lit(b.column).alias("column"), F.lit(b.method).alias("method"),
                      F.count_if(b.test()).alias("count"),
                      half_even(F.lit(b.lower)).alias("threshold_lower"),
                      half_even(F.lit(b.upper)).alias("threshold_upper")) for b in bounds]
    return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("c")).select("c.*")


def anomalies_combined(df: DataFrame, method: str = "zscore", threshold: float = 2.0) -> DataFrame:
    """Every anomalous row once per flagged column, tagged with column and method, in one scan."""
    bounds = column_bounds(df, method, threshold)
    if not bounds:
        return df.withColumns({"_anomaly_column": F.lit(None).cast("string"),
                               "_method": F.lit(None).cast("string")}).where(F.lit(False))
    tags = F.array_compact(F.array(*[
        F.when(b.test(), F.struct(F.lit(b.column).alias("column"), F.lit(b.method).alias("method"))) for b in bounds]))
    return (df.withColumn("_tag", F.explode(tags))
            .withColumns({"_anomaly_column": F.col("_tag.column"), "_method": F.col("_tag.method")}).drop("_tag"))


def anomaly_summary(df: DataFrame, method: str = "zscore", threshold: float = 2.0) -> DataFrame:
    """One row per column with hits plus a total row, with a sentence for each."""
    hits = outliers_all_columns(df, method, threshold)
    name = F.when(F.grouping("column") == 1, F.lit("TOTAL")).otherwise(F.col("column"))
    text = F.when(F.grouping("column") == 1,
                  F.format_string("%d anomalies in %d column(s)", F.sum("count"), F.count("method"))).otherwise(
        F.format_string("%s: %d value(s) outside [%,.2f, %,.2f]", "column", F.sum("count"),
                        F.max("threshold_lower"), F.max("threshold_upper")))
    return hits.rollup("column").agg(
        name.alias("scope"), F.coalesce(F.sum("count"), F.lit(0)).alias("count"), F.count("method").alias("columns"),
        text.alias("summary")).drop("column")
