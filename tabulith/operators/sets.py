"""Set operations on keys and tagged tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()


def key_intersect(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    return distinct_values(left, left_on).intersect(distinct_values(right, right_on))


def key_except(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Keys found on one side only, tagged with that side."""
    a, b = distinct_values(left, left_on), distinct_values(right, right_on)
    return (a.exceptAll(b).withColumn("side", F.lit("left"))
            .unionByName(b.exceptAll(a).withColumn("side", F.lit("right"))))


def union_rows(tables: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Concatenation with the source name in ``tag``; columns a table lacks are null."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
