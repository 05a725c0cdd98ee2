"""Sorting, top-k and samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.functions.kinds import require_columns, require_numeric
from tabulith.operators.ordering import Order, lay_out, sorted_rows, with_ordinal
from tabulith.session import lookup


def top_n_by(df: DataFrame, column: str, n: int = 5, lowest: bool = False,
             ties: Sequence[str] = ()) -> DataFrame:
    """The n rows with the highest (or lowest) value; ``ties`` settles equal values."""
    require_numeric(df, column)
    first = F.col(column).asc_nulls_last() if lowest else F.col(column).desc_nulls_last()
    return df.orderBy(first, *ties).limit(n)


def top_bottom_n(df: DataFrame, column: str, n: int = 5, ties: Sequence[str] = ()) -> DataFrame:
    """Top n and bottom n rows, told apart by ``end``. Rows without a value sort last, so they
    are the first to count as bottom."""
    require_numeric(df, column)
    top = top_n_by(df, column, n, ties=ties)
    bottom = df.orderBy(F.col(column).asc_nulls_first(), *[F.col(t).desc() for t in ties]).limit(n)
    return top.withColumn("end", F.lit("top")).unionByName(bottom.withColumn("end", F.lit("bottom")))


def sort_by(df: DataFrame, column: str, ascending: bool = False) -> DataFrame:
    require_columns(df, column)
    c = F.col(column)
    return sorted_rows(df, c.asc_nulls_last() if ascending else c.desc_nulls_last())


def systematic_sample(df: DataFrame, order_by: Sequence[str], size: int = 100) -> DataFrame:
    """Every ⌊n / size⌋-th row in the given order, with its ``ordinal``.

    Only the order columns are put in order; being unique, the picked ones (fewer than twice
    ``size``, or all of a small table) fetch their rows.
    """
    numbered = with_ordinal(df.select(*order_by), order_by)
    n = numbered.count()
    picked = numbered.where(F.col("ordinal") % max(1, n // size) == 0)
    picked = lookup(picked.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(order_by)], "ordinal"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(order_by)])
    return df.join(picked, same).select(*df.columns, "ordinal")


def first_rows(df: DataFrame, order_by: Order, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """The first n rows of every group; ``order_by`` settles all ties.

    Up to Spark's limit for it, each task cuts its groups to n rows before the shuffle. For a larger n the rows are laid
    out in order, so that a group spreads over as many tasks as its size needs, and are numbered inside their group.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if n <= limit:
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order_by))
        return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
    laid = lay_out(df, [*keys, *order_by])
    parts = laid.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).where(F.col("_before") < n)
    parts = parts.select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)], F.col("_part").alias("_pp"), "_before")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_p{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_pp"))
    inside = F.row_number().over(W.partitionBy(*keys, "_part").orderBy("_pos"))
    return (laid.join(lookup(parts), same).withColumn("_rank", inside).where(F.col("_rank") + F.col("_before") <= n)
            .select(*df.columns))
