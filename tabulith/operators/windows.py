"""Order-dependent series operators: moving averages, trend, ranks, cumulative shares, gaps.

None of them puts a whole series, or one key's rows, into a single window: they work on the
sorted layout of ``ordering`` with carried values or short overlaps between its pieces.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.functions.columns import half_even, number, relative_change
from tabulith.functions.kinds import present, require_columns, require_numeric
from tabulith.operators.aggregation import simple_agg
from tabulith.operators.moments import quantiles, value_positions
from tabulith.operators.ordering import (
    head_tail_means, lay_out, number_rows, previous_value, running_total, with_ordinal)
from tabulith.session import lookup

_CHUNK = 50_000  # rows per window in the moving average, plus the overlap


def moving_average(df: DataFrame, order_by: Sequence[str], value: str, window: int = 7,
                   keys: Sequence[str] = ()) -> DataFrame:
    """``SMA_{window}``: mean of exactly ``window`` rows, null before that; no rows for a series
    shorter than the window.

    The ordered rows are cut into chunks of equal length; each chunk also gets the last
    ``window - 1`` rows before it, so a hot key spreads over many chunks.
    """
    require_numeric(df, value)
    cols = list(dict.fromkeys([*keys, *order_by, value]))
    rows = df.select(*cols).transform(present, *cols)
    numbered = with_ordinal(rows, [*keys, *order_by], "_ord")
    size = max(_CHUNK, 10 * window)
    chunk = F.expr(f"_ord div {size}")
    spill = F.col("_ord") % size >= size - (window - 1)
    copies = F.when(spill, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    spread = (numbered.withColumn("_chunk", F.explode(copies))
              .withColumn("_own", F.col("_chunk") == chunk))
    near = W.partitionBy("_chunk", *keys).orderBy("_ord").rowsBetween(-(window - 1), 0)
    x = number(value)
    mean = F.when(F.count(x).over(near) == window, F.avg(x).over(near))
    out = spread.withColumn(f"SMA_{window}", half_even(mean)).where("_own")
    short = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < window)
    if keys:
        out = out.join(lookup(short.select(*keys)), list(keys), "left_anti")
    elif not short.isEmpty():
        out = out.where(F.lit(False))
    return out.select(*cols, f"SMA_{window}")


def _segments(pdf: pd.DataFrame, keys: Sequence[str]) -> pd.Series:
    """A number that goes up whenever the key changes between neighbouring rows."""
    if not keys:
        return pd.Series(0, index=pdf.index)
    changed = (pdf[list(keys)] != pdf[list(keys)].shift()).any(axis=1)
    changed.iloc[0] = False
    return changed.cumsum()


def ema(df: DataFrame, order_by: Sequence[str], value: str, span: int = 7,
        keys: Sequence[str] = ()) -> DataFrame:
    """``EMA_{span}``: y0 = x0, y = a x + (1 - a) y with a = 2 / (span + 1), rounded to 2 places.

    The recursion is affine in the value carried in, so a first pass reduces every partition of
    the sorted layout to (factor, rest) of its last key and a second pass starts from the carry.
    """
    require_numeric(df, value)
    cols = list(dict.fromkeys([*keys, *order_by, value]))
    rows = df.select(*cols).transform(present, *cols).withColumn(value, number(value))
    laid = lay_out(rows, [*keys, *order_by])
    alpha = 2.0 / (span + 1.0)
    names = list(keys)

    def run(pdf: pd.DataFrame, carry: float | None) -> pd.Series:
        """EMA of a batch; ``carry`` is the last value before it, if its first key goes on."""
        x = pdf[value].reset_index(drop=True)
        part = _segments(pdf, names).reset_index(drop=True)
        if carry is not None:
            x = pd.concat([pd.Series([carry]), x], ignore_index=True)
            part = pd.concat([pd.Series([part.iloc[0]]), part], ignore_index=True)
        y = x.groupby(part).ewm(span=span, adjust=False).mean().reset_index(drop=True)
        return y.iloc[1:] if carry is not None else y

    def last_key(pdf: pd.DataFrame, row: int) -> tuple:
        return tuple(pdf[names].iloc[row]) if names else ()

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the state of the last key: y_end if nothing is carried in, and how a carry would enter
        first = key = None
        fresh, part, tail, one_key = 0.0, None, 0, True
        for pdf in batches:
            if pdf.empty:
                continue
            start, end = last_key(pdf, 0), last_key(pdf, -1)
            if first is None:
                first, part = start, int(pdf["_part"].iloc[0])
            go_on = key is not None and start == key
            y = run(pdf, fresh if go_on else None)
            segment = _segments(pdf, names)
            if segment.iloc[-1] == 0 and (go_on or key is None):
                tail += len(pdf)
            else:
                one_key = False
                tail = int((segment == segment.iloc[-1]).sum())
            key, fresh = end, float(y.iloc[-1])
        if part is not None:
            yield pd.DataFrame({"_part": [part], "single": [one_key], "fresh": [fresh],
                                "first": [repr(first)], "last": [repr(key)], "rows": [tail]})

    state = "_part long, single boolean, fresh double, first string, last string, rows long"
    # one row per partition of the layout
    heads = {r["_part"]: r[value] for r in laid.where("_pos = 0").select("_part", value).collect()}
    parts = sorted(laid.mapInPandas(summarize, state).collect(), key=lambda r: r["_part"])
    carries: dict[int, float] = {}
    last, y = None, 0.0
    for p in parts:
        going_on = last is not None and p["first"] == last
        if going_on:
            carries[p["_part"]] = y
        if going_on and p["single"]:
            # fresh starts from x0, the carried run from a x0 + (1 - a) y; they differ by decay only
            start = alpha * heads[p["_part"]] + (1.0 - alpha) * y
            y = p["fresh"] + (start - heads[p["_part"]]) * (1.0 - alpha) ** (p["rows"] - 1)
        else:
            y = p["fresh"]
        last = p["last"]

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = y_last = None
        for pdf in batches:
            if pdf.empty:
                continue
            start = last_key(pdf, 0)
            if key is None:
                carry = carries.get(int(pdf["_part"].iloc[0]))
            else:
                carry = y_last if start == key else None
            y = run(pdf, carry)
            key, y_last = last_key(pdf, -1), float(y.iloc[-1])
            yield pdf[cols].assign(_ema=y.to_numpy())

    schema = T.StructType([*laid.select(*cols).schema.fields, T.StructField("_ema", T.DoubleType())])
    out = laid.select(*cols, "_part").mapInPandas(smooth, schema)
    return out.select(*cols, half_even(F.col("_ema")).alias(f"EMA_{span}"))


def trend(df: DataFrame, order_by: Sequence[str], value: str) -> DataFrame:
    """One row: direction, slope over the row number, half means, change, range. Empty below 3 rows.

    ``order_by`` starts with the date and ends with a column that settles equal dates.
    """
    require_numeric(df, value)
    date = order_by[0]
    rows = df.where(F.col(date).isNotNull() & number(value).isNotNull())
    rows = rows.select(*order_by, number(value).alias("_v"))
    laid = lay_out(rows, order_by)
    n = laid.count()
    half, at = n // 2, F.col("_i")
    first = F.avg(F.when(at < half, F.col("_v")))
    second = F.avg(F.when(at >= half, F.col("_v")))
    out = number_rows(laid, "_i").agg(
        F.regr_slope("_v", "_i").alias("slope"), first.alias("first"), second.alias("second"),
        F.count("_v").alias("data_points"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    s = F.col("slope")
    return out.where("data_points >= 3").select(
        F.when(s > 0, "Upward").when(s < 0, "Downward").otherwise("Flat").alias("direction"),
        half_even(s, 4).alias("slope"), half_even(F.col("first")).alias("first_half_avg"),
        half_even(F.col("second")).alias("second_half_avg"),
        half_even(relative_change(F.col("first"), F.col("second"))).alias("change_pct"), "data_points",
        half_even(F.col("lo")).alias("min_value"), half_even(F.col("hi")).alias("max_value"))


def percentile_rank(df: DataFrame, column: str, category: str | None = None) -> DataFrame:
    """Adds ``{column}_percentile``: average rank / count within the category, times 100."""
    require_numeric(df, column)
    keys = [category] if category else []
    rows = present(df, *keys, column)
    ranks = value_positions(rows, column, keys).select(
        *keys, F.col("value").alias("_v"),
        (half_even((F.col("before") + (F.col("cnt") + 1) / 2.0) / F.col("n"), 3) * 100.0).alias(f"{column}_percentile"))
    return (df.withColumn("_v", number(column)).join(lookup(ranks), [*keys, "_v"], "left")
            .select(*df.columns, f"{column}_percentile"))


def _ranked_groups(df: DataFrame, category: str, value: str, agg: Column) -> tuple[DataFrame, float]:
    """Grouped values laid out largest first with their running sum, and the grand total."""
    require_columns(df, category)
    require_numeric(df, value)
    grouped = present(df, category).groupBy(category).agg(agg.alias("value")).where("value IS NOT NULL")
    laid = lay_out(grouped, [F.col("value").desc(), F.col(category)])
    total = laid.agg(F.sum("value")).first()[0]
    return number_rows(running_total(laid, "value", "running"), "position"), total


def pareto_curve(df: DataFrame, category: str, value: str, func: str = "sum") -> DataFrame:
    """Groups largest first with the unrounded cumulative percentage."""
    ranked, total = _ranked_groups(df, category, value, simple_agg(func, value).cast("double"))
    if not total:
        ranked, total = ranked.where(F.lit(False)), 1.0
    return ranked.select(category, (F.col("position") + 1).alias("position"), "value",
                         (F.col("running") / F.lit(total) * 100.0).alias("cumulative_pct"))


def pareto(df: DataFrame, category: str, value: str, func: str = "sum") -> DataFrame:
    """Groups largest first with the cumulative percentage to one place."""
    return pareto_curve(df, category, value, func).withColumn(
        "cumulative_pct", half_even(F.col("cumulative_pct"), 1))


def pareto_summary(df: DataFrame, category: str, value: str, func: str = "sum") -> DataFrame:
    """How many groups make up 80 %, and their share of all groups; empty when the total is 0."""
    curve = pareto(df, category, value, func)
    reached = F.min(F.when(F.col("cumulative_pct") >= 80, F.col("position")))
    groups = F.count(F.lit(1))
    return curve.agg(
        half_even(F.sum("value")).alias("total"), F.coalesce(reached, groups).alias("categories_for_80_pct"),
        groups.alias("total_categories")).where("total_categories > 0").withColumn(
            "concentration_ratio",
            half_even(F.col("categories_for_80_pct") / F.col("total_categories") * 100.0, 1))


def sequence_gaps(df: DataFrame, column: str, factor: float = 3.0) -> DataFrame:
    """Neighbouring numbers further apart than ``factor`` times the median distance:
    previous, value, gap. Text is read as a number where it is one."""
    require_columns(df, column)
    x = F.expr(f"try_cast(`{column}` AS double)")
    copies = (df.select(F.nanvl(x, F.lit(None).cast("double")).alias("value")).where("value IS NOT NULL")
              .groupBy("value").agg(F.count(F.lit(1)).alias("cnt")))
    gaps = previous_value(lay_out(copies, ["value"]), "value", "previous")
    gaps = gaps.withColumn("gap", F.col("value") - F.col("previous"))
    # copies of one number are 0 apart, so they enter the median as zeros
    distances = gaps.select(F.explode(F.array(
        F.struct(F.col("gap"), F.lit(1).cast("long").alias("w")),
        F.struct(F.lit(0.0).alias("gap"), (F.col("cnt") - 1).alias("w")))).alias("d")).select("d.*")
    distances = distances.where("gap IS NOT NULL AND w > 0").groupBy("gap").agg(F.sum("w").alias("w"))
    row = quantiles(distances, ["gap"], [0.5], weight="w").first()
    enough = distances.agg(F.sum("w")).first()[0] or 0
    if row is None or enough < 2:
        return gaps.select("previous", "value", "gap").where(F.lit(False))
    return gaps.where(F.col("gap") > factor * row["q"][0]).select("previous", "value", "gap")


def head_tail_change(df: DataFrame, order_by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Change from the mean of the first fifth to that of the last fifth, for 10 values or more."""
    ends = head_tail_means(df, columns, order_by, 5).where("n >= 10")
    start, end = F.col("head_mean"), F.col("tail_mean")
    change = F.when(F.abs(start) > 1e-10, (end - start) / F.abs(start) * 100.0)
    return ends.select("column", "n", "head_mean", "tail_mean", change.alias("change_pct"))


def cumulative_share(df: DataFrame, group: str, share: str, descending_by: str) -> DataFrame:
    """Running sum of an already rounded share over a grouped table, largest first."""
    laid = lay_out(df, [F.col(descending_by).desc_nulls_last(), F.col(group)])
    out = number_rows(running_total(laid, share, "cumulative_share"), "position")
    return out.withColumn("cumulative_share", half_even(F.col("cumulative_share"), 1)).drop("_part", "_pos")
