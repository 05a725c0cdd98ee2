"""Row order without a single-partition window.

``lay_out`` range-partitions and sorts the rows once and writes them to the shared folder, so
that each row has a fixed partition ``_part`` and a fixed position ``_pos`` inside it. Everything
that needs global order (ordinals, running totals, carried values, neighbouring rows) is then a
walk along each written partition in its own order, begun with what a tiny table of one row per
partition carries into it; the rows are not shuffled or sorted again. The order columns must form a
total order; range partitioning on the whole tuple also splits a hot leading value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.session import cut_lineage

Order = Sequence[str | Column]

_POS_BITS = 33  # monotonically_increasing_id keeps the row position in its lower 33 bits
_POS_MASK = (1 << _POS_BITS) - 1


def _before_part() -> WindowSpec:
    """Earlier partitions, in the table that has one row per partition."""
    return W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)


def sorted_rows(df: DataFrame, *order: str | Column) -> DataFrame:
    """The whole table sorted; rows that tie are told apart by a hash, so that a hot value does not
    end up in one partition."""
    return df.orderBy(*order, F.xxhash64(*df.columns))


def lay_out(df: DataFrame, order_by: Order) -> DataFrame:
    """The rows with ``_part`` and ``_pos``, fixed on disk in the given order."""
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    fixed = cut_lineage(ordered.withColumn("_id", F.monotonically_increasing_id()))
    return fixed.select(
        *df.columns,
        F.shiftrightunsigned("_id", _POS_BITS).alias("_part"),
        F.col("_id").bitwiseAND(F.lit(_POS_MASK)).alias("_pos"),
    )


def with_parts(laid: DataFrame, parts: DataFrame) -> DataFrame:
    """Attach per-partition values; ``parts`` has one row per partition, so it is broadcast."""
    return laid.join(F.broadcast(parts), "_part")


def number_rows(laid: DataFrame, name: str = "ordinal") -> DataFrame:
    """The 0-based global position of every laid-out row."""
    parts = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = parts.select(
        "_part", F.coalesce(F.sum("_n").over(_before_part()), F.lit(0)).alias("_offset"))
    return with_parts(laid, offsets).withColumn(name, F.col("_offset") + F.col("_pos")).drop("_offset")


def with_ordinal(df: DataFrame, order_by: Order, name: str = "ordinal") -> DataFrame:
    return number_rows(lay_out(df, order_by), name).drop("_part", "_pos")


#: what a step keeps of a written partition between its batches: fills new columns from old ones and the state
_Step = Callable[[list[pa.Array], list], tuple[list[pa.Array], list]]


def _walk(laid: DataFrame, carried: DataFrame, carry: Sequence[str], reads: Sequence[str], adds: dict[str, T.DataType],
          step: _Step) -> DataFrame:
    """``laid`` with the columns ``adds``, which ``step`` makes of the columns ``reads`` of a run of rows and of the state
    before them. At the start of each partition the state is its row of ``carried``."""
    names = laid.columns
    joined = with_parts(laid, carried)
    kept = [c for c in names if c not in adds]
    schema = T.StructType([*[laid.schema[c] for c in kept], *[T.StructField(c, t) for c, t in adds.items()]])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = None, []
        for batch in batches:
            at = {c: i for i, c in enumerate(batch.schema.names)}
            parts = batch.column(at["_part"]).to_numpy()
            ends = [*(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)] if len(parts) else []
            pieces, start = [], 0
            for end in ends:
                rows = batch.slice(start, end - start)
                if parts[start] != part:
                    part, state = parts[start], [rows.column(at[c])[0] for c in carry]
                made, state = step([rows.column(at[c]) for c in reads], state)
                pieces.append(made)
                start = end
            if pieces:
                made = [pa.concat_arrays(column) for column in zip(*pieces)]
                yield pa.RecordBatch.from_arrays([*[batch.column(at[c]) for c in kept], *made], names=[*kept, *adds])

    return joined.mapInArrow(walk, schema).select(*names, *[c for c in adds if c not in names])


def running_total(laid: DataFrame, value: str, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` in global order; nulls add nothing."""
    sums = laid.groupBy("_part").agg(F.sum(value).alias("_sum"))
    carried = sums.select(
        "_part", F.coalesce(F.sum("_sum").over(_before_part()), F.lit(0)).alias("_carry"))
    kind = carried.schema["_carry"].dataType

    def step(columns: list[pa.Array], state: list) -> tuple[list[pa.Array], list]:
        x = pc.fill_null(columns[0], 0).cast(state[0].type)
        upto = pc.cumulative_sum_checked(x, start=state[0])
        return [upto], [upto[-1]]

    return _walk(laid, carried, ["_carry"], [value], {name: kind}, step)


def previous_value(laid: DataFrame, value: str, name: str) -> DataFrame:
    """``value`` of the row before, across partition borders."""
    ends = laid.groupBy("_part").agg(F.max_by(F.struct(value), "_pos").alias("_end"))
    carried = ends.select("_part", F.lag("_end").over(W.orderBy("_part")).getField(value).alias("_carry"))

    def step(columns: list[pa.Array], state: list) -> tuple[list[pa.Array], list]:
        x = columns[0]
        first = pa.array([state[0].as_py()], x.type) if state[0].is_valid else pa.nulls(1, x.type)
        return [pa.concat_arrays([first, x.slice(0, len(x) - 1)])], [x[-1]]

    return _walk(laid, carried, ["_carry"], [value], {name: laid.schema[value].dataType}, step)


def fill_both_ways(laid: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Forward fill, then back fill what is left at the start."""
    ends = laid.groupBy("_part").agg(*[
        F.expr(f"{pick}(`{c}`, _pos) FILTER (WHERE `{c}` IS NOT NULL)").alias(f"_{side}{i}")
        for i, c in enumerate(columns) for side, pick in (("last", "max_by"), ("first", "min_by"))
    ])
    everything = W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # before the first value of all, rows take that one
    carried = ends.select("_part", *[
        F.coalesce(F.last(f"_last{i}", ignorenulls=True).over(_before_part()),
                   F.first(f"_first{i}", ignorenulls=True).over(everything)).alias(f"_carry{i}") for i in range(len(columns))])

    def step(cells: list[pa.Array], state: list) -> tuple[list[pa.Array], list]:
        made = []
        for x, last in zip(cells, state):
            if x.null_count:
                first = pa.array([last.as_py()], x.type) if last.is_valid else pa.nulls(1, x.type)
                x = pc.fill_null_forward(pa.concat_arrays([first, x])).slice(1)
            made.append(x)
        return made, [x[-1] for x in made]

    return _walk(laid, carried, [f"_carry{i}" for i in range(len(columns))], list(columns),
                 {c: laid.schema[c].dataType for c in columns}, step)


def head_tail_means(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], divisor: int) -> DataFrame:
    """Mean of the first and of the last max(1, n // divisor) non-null values of each column.

    Whole partitions inside the head or tail enter through their sums; only the one or two
    partitions that a border cuts through are read row by row.
    """
    names = list(columns)
    keep = dict.fromkeys([*names, *order_by])
    laid = lay_out(df.select(*keep), order_by)
    values = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in names]
    long = (laid.select("_part", "_pos", F.explode(F.array(*values)).alias("v"))
            .select("_part", "_pos", "v.*").where("value IS NOT NULL"))

    parts = long.groupBy("column", "_part").agg(F.count("value").alias("n"), F.sum("value").alias("s"))
    ahead = W.partitionBy("column").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = (parts
             .withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
             .withColumn("all_n", F.sum("n").over(W.partitionBy("column")))
             .withColumn("take", F.greatest(F.lit(1), F.expr(f"all_n div {divisor}"))))
    # one row per column and partition: bounded by the layout, so it may be broadcast
    parts = cut_lineage(parts.withColumn("upto", F.col("before") + F.col("n")))
    head_end, tail_start = F.col("take"), F.col("all_n") - F.col("take")
    in_head, in_tail = F.col("upto") <= head_end, F.col("before") >= tail_start
    cut = (((F.col("before") < head_end) & ~in_head) | ((F.col("upto") > tail_start) & ~in_tail))

    whole = parts.where(~cut).select(
        "column", F.when(in_head, F.col("s")).alias("hs"), F.when(in_tail, F.col("s")).alias("ts"))
    row = F.col("before") + F.row_number().over(W.partitionBy("column", "_part").orderBy("_pos"))
    edges = (long.join(F.broadcast(parts.where(cut)), ["column", "_part"])
             .withColumn("row", row)
             .select("column", F.when(F.col("row") <= head_end, F.col("value")).alias("hs"),
                     F.when(F.col("row") > tail_start, F.col("value")).alias("ts")))
    # a partition that is whole on one side may be cut on the other; count both sides apart
    sums = whole.unionByName(edges).groupBy("column").agg(F.sum("hs").alias("hs"), F.sum("ts").alias("ts"))
    takes = parts.groupBy("column").agg(F.max("take").alias("take"), F.max("all_n").alias("n"))
    return (takes.join(F.broadcast(sums), "column")
            .select("column", "n", (F.col("hs") / F.col("take")).alias("head_mean"),
                    (F.col("ts") / F.col("take")).alias("tail_mean")))
