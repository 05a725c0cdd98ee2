"""Grouping, pivots, descriptions, correlation and calendar averages."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.functions.columns import half_even, number, relative_change
from tabulith.functions.kinds import (
    columns_by_kind, numeric_columns, present, require_columns, require_numeric, text_columns)
from tabulith.operators.moments import moments, quantiles, with_quantiles
from tabulith.operators.ordering import head_tail_means
from tabulith.operators.selection import sorted_values

_QUARTILES = (0.25, 0.5, 0.75)
_QUARTILE_NAMES = ("q25", "median", "q75")
PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def simple_agg(func: str, value: str) -> Column:
    """One of sum, mean, count, min, max, std over a column; anything else is a sum."""
    x = number(value)
    return {
        "mean": F.avg(x),
        "count": F.count(x),
        "min": F.min(x),
        "max": F.max(x),
        "std": F.stddev_samp(x),
    }.get(func, F.coalesce(F.sum(x), F.lit(0.0)))


def _keyed(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose group keys are all present; grouping ignores the others."""
    return present(df, *keys)


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None,
                     keys: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles, max of every numeric column, rounded to 2 places."""
    columns = list(columns or numeric_columns(df))
    stats = moments(df, columns, keys)
    quart = with_quantiles(df, columns, _QUARTILES, _QUARTILE_NAMES, keys)
    both = stats.join(quart, [*keys, "column"], "left")
    shown = [half_even(F.col(c)).alias(c) for c in ("mean", "std", "min", *_QUARTILE_NAMES, "max")]
    return both.select(*keys, "column", F.col("n").alias("count"), *shown)


def value_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per column and non-null value, as text: column, value, cnt."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return (texts.unpivot([], list(columns), "column", "value").where("value IS NOT NULL")
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt")))


def mode_summary(frequencies: DataFrame) -> DataFrame:
    """Per column: non-null rows, distinct values, most and least common value. Equal counts go to
    the smaller value for the most common, the larger for the least common."""
    by_count = F.struct(-F.col("cnt"), F.col("value"))
    return frequencies.groupBy("column").agg(
        F.sum("cnt").alias("rows"), F.count(F.lit(1)).alias("unique_values"), F.max("cnt").alias("most_common_count"),
        F.min("cnt").alias("least_common_count"), F.min(by_count).alias("_top"), F.max(by_count).alias("_low"),
    ).select("column", "rows", "unique_values", F.col("_top.value").alias("most_common"), "most_common_count",
             F.col("_low.value").alias("least_common"), "least_common_count")


def describe_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or text_columns(df))
    return mode_summary(value_frequencies(df, columns)).select(
        "column", F.col("rows").alias("count"), "unique_values", "most_common", "most_common_count",
        "least_common")


def shape_info(df: DataFrame) -> DataFrame:
    kinds = columns_by_kind(df)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"),
        *[F.lit(len(kinds[k])).alias(f"{k}_columns") for k in ("numeric", "categorical", "datetime")])


def group_agg(df: DataFrame, group: str, value: str, func: str = "sum") -> DataFrame:
    """One aggregate per group, largest first; the column is called ``{value}_{func}``."""
    require_columns(df, group, value)
    func = func if func in ("sum", "mean", "count", "min", "max", "median", "std") else "sum"
    name = f"{value}_{func}"
    rows = _keyed(df, group)
    if func == "median":
        groups = rows.select(group).distinct()
        mid = quantiles(rows, [value], [0.5], [group]).select(group, F.col("q")[0].alias(name))
        out = groups.join(mid, group, "left")
    else:
        out = rows.groupBy(group).agg(simple_agg(func, value).alias(name))
    return out.orderBy(F.col(name).desc_nulls_last(), group)


def auto_group(df: DataFrame, max_groups: int = 20, groups: Sequence[str] | None = None,
               values: Sequence[str] | None = None) -> DataFrame:
    """Sums of the numeric columns by each of the text columns that has 2 to ``max_groups`` values (or of the named
    ones), in one scan: group_col, group_value, value_col, total."""
    groups, values = list(groups or text_columns(df)), list(values or numeric_columns(df))
    cells = [F.struct(F.lit(g).alias("group_col"), F.col(g).alias("group_value")) for g in groups]
    sums = (df.select(F.explode(F.array(*cells)).alias("g"), *values).select("g.*", *values)
            .where("group_value IS NOT NULL").groupBy("group_col", "group_value")
            .agg(*[simple_agg("sum", v).alias(v) for v in values]))
    sizes = sums.groupBy("group_col").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, max_groups))
    totals = [F.struct(F.lit(v).alias("value_col"), F.col(v).alias("total")) for v in values]
    return (sums.join(F.broadcast(sizes), "group_col")
            .select("group_col", "group_value", F.explode(F.array(*totals)).alias("t"))
            .select("group_col", "group_value", "t.*"))


def compare_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """count, mean, median, std, min, max, total per group, rounded, largest total first."""
    require_numeric(df, value)
    rows = _keyed(df, group)
    stats = rows.groupBy(group).agg(
        simple_agg("count", value).alias("count"),
        *[half_even(simple_agg(f, value)).alias(f) for f in ("mean", "std", "min", "max")],
        half_even(simple_agg("sum", value)).alias("total"))
    mid = quantiles(rows, [value], [0.5], [group]).select(group, half_even(F.col("q")[0]).alias("median"))
    return stats.join(mid, group, "left").orderBy(F.col("total").desc(), group)


def compare_two_values(df: DataFrame, value: str, first: str, second: str) -> DataFrame:
    """Description of ``value`` for two values of the first text column that has them both."""
    require_numeric(df, value)
    wanted = [first.lower(), second.lower()]
    texts = text_columns(df)
    found = df.agg(*[
        F.bool_or(F.lower(c) == w).alias(f"_{i}_{j}") for i, c in enumerate(texts) for j, w in enumerate(wanted)
    ]).first()
    host = next((c for i, c in enumerate(texts) if found[f"_{i}_0"] and found[f"_{i}_1"]), None)
    if host is None:
        raise ValueError(f"no text column holds both {first!r} and {second!r}")
    rows = df.select(F.lower(host).alias("group_value"), value).where(F.col("group_value").isin(wanted))
    return describe_numeric(rows, [value], ["group_value"]).withColumn("group_col", F.lit(host))


def multi_agg(df: DataFrame, group: str, values: Sequence[str], funcs: Sequence[str]) -> DataFrame:
    """Every function of every value column per group, named ``{column}_{func}``."""
    require_columns(df, group, *values)
    aggs = [(simple_agg(f, v) if f == "count" else half_even(simple_agg(f, v))).alias(f"{v}_{f}")
            for v in values for f in funcs if f != "median"]
    rows = _keyed(df, group)
    out = rows.groupBy(group).agg(*aggs) if aggs else rows.select(group).distinct()
    if "median" in funcs:
        mids = quantiles(rows, values, [0.5], [group]).groupBy(group).agg(*[
            half_even(F.max(F.when(F.col("column") == v, F.col("q")[0]))).alias(f"{v}_median") for v in values])
        out = out.join(mids, group, "left")
    return out


def pivot_table(df: DataFrame, index: str, value: str, func: str = "mean", columns: str | None = None,
                pivot_values: Sequence | None = None, long: bool = False) -> DataFrame:
    """One row per index value, one column per value of ``columns``; empty cells are 0.

    ``long`` gives index, ``columns`` and the value as rows instead, which holds for any number of values; a missing row
    is an empty cell.
    """
    require_columns(df, index, value)
    agg = simple_agg(func, value)
    if func != "count":
        agg = half_even(agg)
    if columns is None:
        rows = _keyed(df, index).where(F.col(value).isNotNull())
        return rows.groupBy(index).agg(agg.alias(value))
    rows = _keyed(df, index, columns).where(F.col(value).isNotNull())
    if long:
        return rows.groupBy(index, columns).agg(agg.alias(value))
    if pivot_values is None:
        pivot_values = sorted_values(df, columns, "long=True")
    return rows.groupBy(index).pivot(columns, list(pivot_values)).agg(agg).na.fill(0)


def scalar_agg(df: DataFrame, column: str, func: str) -> DataFrame:
    """average | avg | mean | sum | total | min | max | median | count of one column, as ``value``."""
    require_numeric(df, column)
    func = {"average": "mean", "avg": "mean", "total": "sum"}.get(func, func)
    if func == "median":
        return quantiles(df, [column], [0.5]).select(F.col("q")[0].alias("value"))
    if func not in ("mean", "sum", "min", "max", "count"):
        func = "mean"
    return df.agg(simple_agg(func, column).cast("double").alias("value"))


def kpis(df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: total, average, median, min, max, std, count and growth from the first
    to the last tenth of its values in row order."""
    columns = list(columns or numeric_columns(df))
    stats = moments(df, columns).where("n > 0")
    mid = with_quantiles(df, columns, [0.5], ["median"])
    ends = head_tail_means(df, columns, order_by, 10).withColumn(
        "growth_pct", relative_change(F.col("head_mean"), F.col("tail_mean")))
    shown = [half_even(F.col(src)).alias(name) for src, name in (
        ("total", "total"), ("mean", "average"), ("median", "median"), ("min", "min"), ("max", "max"),
        ("std", "std"), ("growth_pct", "growth_pct"))]
    return (stats.join(F.broadcast(mid), "column").join(F.broadcast(ends.drop("n")), "column")
            .select("column", F.col("n").alias("count"), *shown))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, column)
    return (_keyed(df, column).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), column))


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]], means: Mapping[str, float | None] | None = None) -> DataFrame:
    """Pearson r over the rows where both columns are present: col1, col2, r; null for a constant. ``means`` of the columns,
    where they are known already, save a scan; they need not be exact.

    All pairs together would make an aggregate too large to compile, so each partition reduces its
    Arrow batches to the cross products of the centred columns (a few matrix products), and Spark
    adds up one row per partition and pair.
    """
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    at = {c: i for i, c in enumerate(names)}
    first, second = [at[a] for a, _ in pairs], [at[b] for _, b in pairs]
    wide = df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(names)])
    known = [means[c] for c in names] if means is not None else wide.agg(*[F.avg(c) for c in wide.columns]).first()
    centre = [m or 0.0 for m in known]
    fields = ("n", "sx", "sy", "sxx", "syy", "sxy")

    def cross_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, len(first)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - centre
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            mark = there.astype("float64")
            own, squares = x.T @ mark, (x * x).T @ mark
            sums += np.stack([(mark.T @ mark)[first, second], own[first, second], own[second, first],
                              squares[first, second], squares[second, first], (x.T @ x)[first, second]])
        columns = [pa.array(range(len(first)), pa.int32()), *[pa.array(s) for s in sums]]
        yield pa.RecordBatch.from_arrays(columns, ["pair", *fields])

    parts = wide.mapInArrow(cross_products, "pair int, " + ", ".join(f"{f} double" for f in fields))
    t = parts.groupBy("pair").agg(*[F.sum(f).alias(f) for f in fields])
    n = F.nullif("n", F.lit(0.0))
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    # what rounding leaves of a constant column's variance is not variance
    flat = (vx <= F.col("sxx") * 1e-14) | (vy <= F.col("syy") * 1e-14)
    r = F.when(~flat, (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.nullif(F.sqrt(vx * vy), F.lit(0.0)))
    labels = [F.array(*[F.lit(p[side]) for p in pairs]) for side in (0, 1)]
    return t.select(F.get(labels[0], "pair").alias("col1"), F.get(labels[1], "pair").alias("col2"), r.alias("r"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Full matrix in long form: col1, col2, correlation (3 places)."""
    columns = list(columns or numeric_columns(df))
    half = pair_correlations(df, list(combinations(columns, 2))) if len(columns) > 1 else None
    if half is None:
        raise ValueError("correlation needs two numeric columns")
    own = df.agg(*[F.var_samp(number(c)).alias(f"_v{i}") for i, c in enumerate(columns)]).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("col1"), F.lit(c).alias("col2"),
                                     F.when(F.col(f"_v{i}") > 0, 1.0).alias("r"))
                            for i, c in enumerate(columns)])).alias("p")).select("p.*")
    mirrored = half.select(F.explode(F.array(
        F.struct("col1", "col2", "r"),
        F.struct(F.col("col2").alias("col1"), F.col("col1").alias("col2"), "r"))).alias("p")).select("p.*")
    return mirrored.unionByName(own).select("col1", "col2", half_even(F.col("r"), 3).alias("correlation"))


def correlation_pairs(df: DataFrame, min_corr: float = 0.5) -> DataFrame:
    """Pairs with |r| >= ``min_corr``, strongest first."""
    r = F.col("r")
    return (pair_correlations(df, list(combinations(numeric_columns(df), 2)))
            .where(F.abs(r) >= min_corr)
            .select("col1", "col2", half_even(r, 3).alias("correlation"),
                    F.when(F.abs(r) > 0.8, "Strong").otherwise("Moderate").alias("strength"),
                    F.when(r > 0, "Positive").otherwise("Negative").alias("direction"))
            .orderBy(F.abs("correlation").desc(), "col1", "col2"))


def correlates_with(df: DataFrame, column: str) -> DataFrame:
    require_numeric(df, column)
    others = [c for c in numeric_columns(df) if c != column]
    return (pair_correlations(df, [(column, c) for c in others])
            .select(F.col("col2").alias("column"), F.col("r").alias("correlation"))
            .orderBy(F.abs("correlation").desc_nulls_last(), "column"))


def calendar_means(df: DataFrame, date: str, value: str) -> DataFrame:
    """Mean by month, weekday and quarter: period, number, label, mean. Empty below 12 rows.

    The scan is reduced to at most 84 (month, weekday) sums; the three views are built from them.
    """
    require_numeric(df, value)
    d = F.col(date)
    rows = df.where(d.isNotNull() & number(value).isNotNull())
    cells = rows.groupBy(F.month(d).alias("month"), F.weekday(d).alias("weekday"),
                         F.date_format(d, "MMMM").alias("month_name"), F.date_format(d, "EEEE").alias("day_name")
                         ).agg(F.sum(number(value)).alias("s"), F.count(F.lit(1)).alias("n"))
    quarter = F.floor((F.col("month") + 2) / 3).cast("int")
    views = F.array(
        F.struct(F.lit("month").alias("period"), F.col("month").alias("number"), F.col("month_name").alias("label")),
        F.struct(F.lit("weekday").alias("period"), (F.col("weekday") + 1).alias("number"),
                 F.col("day_name").alias("label")),
        F.struct(F.lit("quarter").alias("period"), quarter.alias("number"),
                 F.concat(F.lit("Q"), quarter).alias("label")))
    means = (cells.select(F.explode(views).alias("v"), "s", "n").select("v.*", "s", "n")
             .groupBy("period", "number", "label").agg(half_even(F.sum("s") / F.sum("n")).alias("mean"),
                                                       F.sum("n").alias("n")))
    enough = F.sum("n").over(W.partitionBy("period")) >= 12
    return means.withColumn("_ok", enough).where("_ok").drop("_ok", "n")


def seasonality(df: DataFrame, date: str, value: str) -> DataFrame:
    return calendar_means(df, date, value)


def seasonality_peaks(df: DataFrame, date: str, value: str) -> DataFrame:
    """Peak and low month (the earlier one on a tie) and their distance, in one row."""
    months = calendar_means(df, date, value).where("period = 'month'")
    return months.groupBy("period").agg(
        F.min(F.struct(-F.col("mean"), F.col("number"), F.col("label"))).alias("_peak"),
        F.min(F.struct(F.col("mean"), F.col("number"), F.col("label"))).alias("_low"),
        F.max("mean").alias("peak_value"), F.min("mean").alias("low_value"),
    ).select(F.col("_peak.label").alias("peak_month"), F.col("_low.label").alias("low_month"), "peak_value",
             "low_value", half_even(F.col("peak_value") - F.col("low_value")).alias("seasonal_range"))


def percentile_table(df: DataFrame, column: str, percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """One row per percentile (``P5``) plus ``IQR``."""
    require_numeric(df, column)
    q = quantiles(df, [column], [p / 100.0 for p in percentiles])
    rows = [F.struct(F.lit(f"P{p}").alias("percentile"), half_even(F.col("q")[i]).alias("value"))
            for i, p in enumerate(percentiles)]
    at = {p: i for i, p in enumerate(percentiles)}
    ends = [half_even(F.col("q")[at[p]]) if p in at else F.lit(0.0) for p in (75, 25)]
    rows.append(F.struct(F.lit("IQR").alias("percentile"), half_even(ends[0] - ends[1]).alias("value")))
    return q.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def distinct_rates(df: DataFrame, group: str, value: str) -> DataFrame:
    """Every distinct value of each group with its row count, in long form."""
    return _keyed(df, group, value).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
