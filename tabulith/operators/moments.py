"""One-pass moments of many columns, and exact quantiles that stay distributed."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.functions.columns import number
from tabulith.operators.ordering import lay_out, running_total
from tabulith.session import BROADCAST_BYTES, cut_lineage, lookup, row_bytes

PER_OCTAVE = 64      # buckets between a number and its double in a first histogram
STEPS = 4096         # parts that a bucket of too many values is cut into
CELL_ROWS = 500_000  # values of a bucket that are looked at one by one


def melt(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, column, value (double): one row per cell, built by a generated Expand."""
    wide = df.select(*keys, *[number(c).alias(c) for c in columns])
    return wide.unpivot(list(keys), list(columns), "column", "value")


_STATE = ("n", "nulls", "total", "mean", "m2", "m3", "m4", "min", "max", "zeros", "negatives")


def _column_states(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per task and column: ``c`` and what the task's values add up to, with central moments around their own mean."""
    wide = df.select(*[number(c) for c in columns])

    def moments_of(x: np.ndarray) -> np.ndarray:
        mean = x.mean()
        d = x - mean
        d2 = d * d
        return np.array([len(x), 0, x.sum(), mean, d2.sum(), (d2 * d).sum(), (d2 * d2).sum(), x.min(), x.max(), (x == 0).sum(), (x < 0).sum()])

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a[0] + b[0]
        mean = (a[0] * a[3] + b[0] * b[3]) / n
        out = a + b
        out[3], out[7], out[8] = mean, min(a[7], b[7]), max(a[8], b[8])
        out[4:7] = 0.0
        for part in (a, b):
            d = part[3] - mean
            out[4] += part[4] + part[0] * d * d
            out[5] += part[5] + 3 * d * part[4] + part[0] * d ** 3
            out[6] += part[6] + 4 * d * part[5] + 6 * d * d * part[4] + part[0] * d ** 4
        return out

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: list[np.ndarray | None] = [None] * len(columns)
        rows, nulls = 0, np.zeros(len(columns))
        for batch in batches:
            rows += batch.num_rows
            for i, cells in enumerate(batch.columns):
                nulls[i] += cells.null_count
                x = cells.drop_null().to_numpy()
                if len(x):
                    with np.errstate(all="ignore"):  # infinite values have no moments
                        one = moments_of(x)
                        states[i] = one if states[i] is None else merge(states[i], one)
        if rows:
            found = np.array([np.zeros(len(_STATE)) if s is None else s for s in states]).T
            found[1] = nulls
            none = np.array([s is None for s in states])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(columns)), pa.int32()), *[
                pa.array(values, mask=none if name in ("mean", "min", "max") else None) for name, values in zip(_STATE, found)]], names=["c", *_STATE])

    return wide.mapInArrow(add_up, ", ".join(["c int", *[f"{name} double" for name in _STATE]]))


def _column_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Moments of whole columns in one pass over Arrow batches; Spark merges the tasks' states. Columns: column, n, nulls, total,
    mean, var, min, max, g1, g2, zeros, negatives."""
    states = _column_states(df, columns)
    all_tasks = W.partitionBy("c")  # a row per task
    mean = F.sum(F.col("n") * F.col("mean")).over(all_tasks) / F.nullif(F.sum("n").over(all_tasks), F.lit(0.0))
    n, d = F.col("n"), F.col("d")
    states = states.withColumn("centre", mean).withColumn("d", F.col("mean") - F.col("centre"))
    sums = states.groupBy("c").agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("total").alias("total"), F.max("centre").alias("mean"),
        F.sum(F.col("m2") + n * d * d).alias("m2"), F.sum(F.col("m3") + 3 * d * F.col("m2") + n * d * d * d).alias("m3"),
        F.sum(F.col("m4") + 4 * d * F.col("m3") + 6 * d * d * F.col("m2") + n * d * d * d * d).alias("m4"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.sum("zeros").alias("zeros"), F.sum("negatives").alias("negatives"))
    count, flat = F.nullif("n", F.lit(0.0)), F.col("min") == F.col("max")
    # what rounding leaves of a constant column's variance is not variance
    spread = F.nullif(F.when(~flat, F.col("m2") / count), F.lit(0.0))
    var = F.when(F.col("n") > 1, F.when(flat, 0.0).otherwise(F.col("m2") / F.nullif(F.col("n") - 1, F.lit(0.0))))
    return sums.select(
        F.get(F.array(*[F.lit(c) for c in columns]), "c").alias("column"), F.col("n").cast("long").alias("n"), F.col("nulls").cast("long").alias("nulls"),
        "total", F.when(flat, F.col("min")).otherwise(F.col("mean")).alias("mean"), var.alias("var"), "min", "max",
        (F.col("m3") / count / (spread * F.sqrt(spread))).alias("g1"), (F.col("m4") / count / (spread * spread) - 3).alias("g2"),
        *[F.col(c).cast("long").alias(c) for c in ("zeros", "negatives")])


def _keyed_moments(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The same per group. Cells are melted first: one short aggregate per (keys, column) stays compiled however many
    columns there are, and is combined before the shuffle."""
    x = F.col("value")
    return melt(df, columns, keys).groupBy(*keys, "column").agg(
        F.count(x).alias("n"), (F.count(F.lit(1)) - F.count(x)).alias("nulls"),
        F.coalesce(F.sum(x), F.lit(0.0)).alias("total"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"),
        F.count_if(x == 0).alias("zeros"), F.count_if(x < 0).alias("negatives"))


def moments(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Long table: keys, column, n, nulls, total, mean, std, min, max, skew, kurt, zeros, negatives."""
    raw = _keyed_moments(df, columns, keys) if keys else _column_moments(df, columns)
    # these are the population shape; reports use the bias-corrected sample shape
    n, var = F.col("n").cast("double"), F.col("var")
    skew = F.when(n < 3, None).when(var == 0, 0.0).otherwise(
        F.col("g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    spread = F.nullif((n - 2) * (n - 3), F.lit(0.0))
    kurt = F.when(n < 4, None).when(var == 0, 0.0).otherwise((n - 1) / spread * ((n + 1) * F.col("g2") + 6))
    return raw.select(*keys, "column", "n", "nulls", "total", "mean", F.sqrt(var).alias("std"), "min", "max",
                      skew.alias("skew"), kurt.alias("kurt"), "zeros", "negatives")


def _magnitude(x: Column) -> Column:
    """A bucket number that rises with x: sign, power of two, and ``PER_OCTAVE`` steps between powers."""
    far = 1080 * PER_OCTAVE
    step = F.floor(F.greatest(F.lit(-far), F.least(F.log2(F.abs(x)) * PER_OCTAVE, F.lit(far)))) + (far + 1)
    return F.when(x == 0, 0).otherwise(F.signum(x) * step).cast("int")


def _part_of_cell(x: Column) -> Column:
    """Which of ``STEPS`` equal parts of a cell's range x lies in."""
    return F.least(F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * STEPS), F.lit(STEPS - 1)).cast("int")


def _ranks(prob: float, n: Column) -> tuple[Column, Column, Column]:
    """The two ranks whose values a quantile lies between, and how far it is from the first."""
    h = F.lit(float(prob)) * (n - 1)
    return F.floor(h), F.ceil(h), h - F.floor(h)


def _cells_with_ranks(counts: DataFrame, cell: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Of a cell's parts (``bucket, part_lo, part_hi, part_cnt``) those that hold a wanted rank of their group, as cells."""
    upto = F.sum("part_cnt").over(W.partitionBy(*cell).orderBy("bucket"))
    placed = counts.withColumn("end", F.col("start") + upto).withColumn("start", F.col("end") - F.col("part_cnt"))
    holds = [(r >= F.col("start")) & (r < F.col("end")) for p in probs for r in _ranks(p, F.col("n"))[:2]]
    return placed.where(functools.reduce(Column.__or__, holds)).select(
        *[c for c in cell if c not in ("n", "start", "lo", "hi")], "n", "start", F.col("part_lo").alias("lo"), F.col("part_hi").alias("hi"),
        F.col("part_cnt").alias("cnt"))


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = (),
              weight: str | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles: keys, column, ``q`` (array in the order of ``probs``).

    Selection in rounds: a group's values are counted in a histogram of fixed size, and of its buckets only those that
    hold a wanted rank are looked at again. A bucket of more than ``CELL_ROWS`` values is cut into ``STEPS`` parts between its
    least and largest value in the next round, as often as needed; then its distinct values are counted. Nothing is
    sampled, no cut points pass through the driver, and no task holds a group's values. ``weight`` counts a row that many times.
    """
    shown = [F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)]
    wide = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"),
                     *[number(c).alias(str(i)) for i, c in enumerate(columns)])
    group = [*[f"_k{i}" for i in range(len(keys))], "c"]
    if len(columns) == 1:
        long = wide.withColumnRenamed("0", "value").withColumn("c", F.lit("0"))
    else:
        long = wide.unpivot([*group[:-1], "w"], [str(i) for i in range(len(columns))], "c", "value")
    long = long.where("value IS NOT NULL")
    part = [F.sum("w").alias("part_cnt"), F.min("value").alias("part_lo"), F.max("value").alias("part_hi")]

    counts = long.groupBy(*group, _magnitude(F.col("value")).alias("bucket")).agg(*part)
    counts = counts.withColumns({"n": F.sum("part_cnt").over(W.partitionBy(*group)), "start": F.lit(0).cast("long")})
    cells = _cells_with_ranks(counts, group, probs)
    while True:
        open_, full = F.col("lo") < F.col("hi"), (F.col("lo") < F.col("hi")) & (F.col("cnt") > CELL_ROWS)
        seen = Observation()
        cells = cut_lineage(cells.observe(seen, F.sum(row_bytes(cells)).alias("size"), F.count_if(open_).alias("open"),
                                          F.count_if(full).alias("full")))
        size, n_open, n_full = (seen.get[c] or 0 for c in ("size", "open", "full"))
        hint = F.broadcast if size <= BROADCAST_BYTES else (lambda rows: rows)

        def inside(which: Column) -> DataFrame:
            """Values with the cell they lie in; a group has at most two cells per quantile."""
            some = hint(cells.where(which)).alias("cell")
            same = functools.reduce(Column.__and__, [F.col(f"l.{g}") == F.col(f"cell.{g}") for g in group])
            return long.alias("l").join(some, same & F.col("value").between(F.col("lo"), F.col("hi"))).select(
                *[F.col(f"cell.{g}") for g in group], "n", "start", "lo", "hi", "value", "w")

        if not n_full:
            break
        cell = [*group, "n", "start", "lo", "hi"]
        counts = inside(full).groupBy(*cell, _part_of_cell(F.col("value")).alias("bucket")).agg(*part)
        cells = cells.where(~full).unionByName(_cells_with_ranks(counts, cell, probs))

    # cells of one value are known without another look
    values = cells.where(~open_).select(*group, "n", "start", F.col("lo").alias("value"), "cnt")
    if n_open:
        values = values.unionByName(inside(open_).groupBy(*group, "n", "start", "value").agg(F.sum("w").alias("cnt")))
    upto = F.sum("cnt").over(W.partitionBy(*group, "start").orderBy("value"))
    values = values.withColumn("end", F.col("start") + upto).withColumn("begin", F.col("end") - F.col("cnt"))
    at = lambda r: F.max(F.when((r >= F.col("begin")) & (r < F.col("end")), F.col("value")))
    picks = []
    for p in probs:
        low, high, share = _ranks(p, F.col("n"))
        picks.append(F.struct(at(low).alias("lo"), at(high).alias("hi"), F.max(share).alias("f")))
    found = values.groupBy(*group).agg(F.array(*picks).alias("q"))
    names = F.array(*[F.lit(c) for c in columns])
    q = F.transform("q", lambda x: F.when(x.lo == x.hi, x.lo).otherwise(x.lo + x.f * (x.hi - x.lo)))
    return found.select(*shown, F.get(names, F.col("c").cast("int")).alias("column"), q.alias("q"))


def with_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], names: Sequence[str],
                   keys: Sequence[str] = (), **options) -> DataFrame:
    """``quantiles`` with one named column per probability."""
    return quantiles(df, columns, probs, keys, **options).select(
        *keys, "column", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def value_positions(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their count and rank: keys, value, cnt, before, n.

    ``before`` counts the smaller values of the group and ``n`` all of them. Copies of a value are counted before the
    shuffle; the distinct values are laid out in order and counted along the partitions.
    """
    plain = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], number(column).alias("value"))
    group = [f"_k{i}" for i in range(len(keys))]
    values = plain.where("value IS NOT NULL").groupBy(*group, "value").agg(F.count(F.lit(1)).alias("cnt"))
    laid = running_total(lay_out(values, [*group, "value"]), "cnt", "upto")
    if keys:
        totals = laid.groupBy(*group).agg(F.min(F.col("upto") - F.col("cnt")).alias("base"), F.sum("cnt").alias("n"))
        laid = laid.join(lookup(totals), group)
    else:
        n = laid.agg(F.sum("cnt")).first()[0] or 0
        laid = laid.withColumns({"base": F.lit(0).cast("long"), "n": F.lit(n).cast("long")})
    return laid.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "value", "cnt",
                       (F.col("upto") - F.col("cnt") - F.col("base")).alias("before"), "n")
