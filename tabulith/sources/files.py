"""CSV and Parquet tables, and a preview of what was read."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.functions.columns import strip
from tabulith.functions.kinds import columns_by_kind, is_numeric, text_columns
from tabulith.operators.profiling import null_counts

# The texts a CSV reader takes for "no value".
CSV_NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
             "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


@dataclass
class Source:
    """A table with what is known about it without reading it again."""

    table: DataFrame
    name: str
    columns: list[str]
    dtypes: dict[str, str]
    size_kb: float

    def shape(self) -> tuple[int, int]:
        return self.table.count(), len(self.columns)


def _size_kb(spark: SparkSession, path: str) -> float:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    sizes = [s.getPath() for s in (fs.globStatus(target) or [])]
    return round(sum(fs.getContentSummary(p).getLength() for p in sizes) / 1024, 2)


def _source(spark: SparkSession, df: DataFrame, path: str) -> Source:
    return Source(df, os.path.basename(path.rstrip("/")), df.columns, dict(df.dtypes), _size_kb(spark, path))


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns as text, the reader's null texts as null. Multi-line fields make a file
    unsplittable, so they have to be asked for."""
    raw = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    return raw.withColumns({c: F.when(~F.col(c).isin(*CSV_NULLS), F.col(c)) for c in raw.columns})


def _bare(col: Column) -> Column:
    """``strip`` for values to be cast, without a regular expression."""
    return F.trim(col, F.lit(" \t\n\x0b\f\r"))


def typed_text(df: DataFrame) -> DataFrame:
    """Text columns whose every value is a whole number, a number or a boolean get that type; one
    aggregate over the table decides for all of them."""
    names = text_columns(df)
    if not names:
        return df
    aggs = []
    for i, c in enumerate(names):
        v = _bare(F.col(c))
        whole = v.rlike(r"^[+-]?\d+$") & v.try_cast("bigint").isNotNull()
        # a failed cast to double is an exception, some hundred times the work of a cast that works: texts and dates that
        # cannot be numbers are not tried
        likely = v.rlike(r"^[\x00-\x20]*[+-]?([0-9.]|[iI][nN][fF]|[nN][aA][nN])") & ~v.rlike("[0-9]-")
        real = likely & v.try_cast("double").isNotNull() & ~v.rlike("[0-9.][dDfF]$")
        aggs += [F.count(F.col(c)).alias(f"n{i}"), F.count_if(whole).alias(f"l{i}"),
                 F.count_if(F.when(whole, True).otherwise(real)).alias(f"d{i}"),
                 F.count_if(F.lower(F.col(c)).isin("true", "false")).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    casts = {}
    for i, c in enumerate(names):
        n = row[f"n{i}"]
        kind = next((t for t, k in (("bigint", "l"), ("double", "d"), ("boolean", "b")) if n and row[f"{k}{i}"] == n), None)
        if kind:
            casts[c] = _bare(F.col(c)).try_cast(kind)
    return df.withColumns(casts) if casts else df


def scan_csv(spark: SparkSession, path: str, multi_line: bool = False) -> Source:
    return _source(spark, typed_text(read_csv_text(spark, path, multi_line)), path)


def scan_parquet(spark: SparkSession, path: str) -> Source:
    return _source(spark, spark.read.parquet(path), path)


def scan(spark: SparkSession, path: str) -> Source:
    """A CSV or Parquet table by its file extension; a folder without one is Parquet."""
    ext = os.path.splitext(path.rstrip("/*"))[1].lower()
    if ext == ".csv":
        return scan_csv(spark, path)
    if ext in (".parquet", ""):
        return scan_parquet(spark, path)
    raise ValueError(f"unsupported file format: {ext}")


def preview_rows(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def table_preview(df: DataFrame) -> DataFrame:
    """Per column: kind, rows and missing cells."""
    kinds = [(c, k) for k, names in columns_by_kind(df).items() for c in names]
    kind = F.coalesce(*[F.when(F.col("column") == c, F.lit(k)) for c, k in kinds], F.lit("other"))
    return null_counts(df).select("column", kind.alias("kind"), "rows", F.col("missing").alias("null_count"))


def column_totals(df: DataFrame) -> DataFrame:
    """Per numeric column sum, average, count, min, max, std; per other column the filled and blank
    cells. One aggregate for the whole table."""
    nothing = F.lit(None).cast("double")
    cells = []
    for c in df.columns:
        if is_numeric(df, c):
            x = F.nanvl(F.col(c).cast("double"), nothing)
            stats = (F.coalesce(F.sum(x), F.lit(0.0)), F.avg(x), F.count(x).cast("double"), F.min(x), F.max(x),
                     F.stddev_samp(x), nothing, nothing)
        else:
            text = strip(F.col(c).cast("string"))
            blank = F.count_if(text.isNull() | (text == ""))
            stats = (*[nothing] * 6, F.count(F.col(c)).cast("double"), blank.cast("double"))
        names = ("sum", "average", "count", "min", "max", "stdev", "counta", "countblank")
        cells.append(F.struct(F.lit(c).alias("column"), *[s.alias(n) for s, n in zip(stats, names)]))
    return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("c")).select("c.*")
