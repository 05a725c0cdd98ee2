"""Dataset and column profiles, quality checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce, wraps
from itertools import combinations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.functions.columns import half_even, number, percent
from tabulith.functions.kinds import (
    columns_by_kind, datetime_columns, is_numeric, numeric_columns, text_columns)
from tabulith.operators.aggregation import mode_summary, pair_correlations, value_frequencies
from tabulith.operators.moments import moments, with_quantiles
from tabulith.session import lookup


class ExpectationError(ValueError):
    """A table failed a check; ``context`` says which columns or counts are to blame."""

    def __init__(self, message: str, context: dict | None = None):
        super().__init__(message)
        self.context = context or {}


def _gap(df: DataFrame, name: str) -> Column:
    """True where a cell is missing; NaN counts as missing."""
    return number(name).isNull() if is_numeric(df, name) else F.col(name).isNull()


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Non-null distinct values per column: column, unique. Values are melted and counted per
    (column, value) first, so no task holds one column's values; ``approx`` uses sketches."""
    if approx:
        cells = [F.struct(F.lit(c).alias("column"), F.approx_count_distinct(c).alias("unique")) for c in columns]
        return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("c")).select("c.*")
    listed = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    found = reduce(DataFrame.unionByName, [
        df.select(*[(number(c) if kind == "double" else F.col(c).cast(kind)).alias(c) for c in names]).unpivot([], names, "column", "value")
        .where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column").agg(F.count(F.lit(1)).alias("unique"))
        for kind, names in _by_plain_type(df, columns).items()])
    # a column without any value must still be listed
    return listed.join(F.broadcast(found), "column", "left").select(
        "column", F.coalesce("unique", F.lit(0)).alias("unique"))


def _by_plain_type(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Columns by the type their values are compared in; only other types are turned into text."""
    out: dict[str, list[str]] = {}
    for c in columns:
        t = df.schema[c].dataType
        kind = ("bigint" if isinstance(t, T.IntegralType) else "double" if isinstance(t, T.FractionalType)
                and not isinstance(t, T.DecimalType) else "string")
        out.setdefault(kind, []).append(c)
    return out


def null_counts(df: DataFrame) -> DataFrame:
    """Missing cells per column, in one scan: column, rows, missing."""
    cells = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"),
                      F.count_if(_gap(df, c)).alias("missing")) for c in df.columns]
    return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("c")).select("c.*")


def fingerprint(columns: Sequence[str]) -> list[Column]:
    """A row's 128 bits as two hashes. Which cells are null is hashed too, since hashes pass over nulls."""
    nulls = F.array(*[F.col(c).isNull() for c in columns])
    return [F.xxhash64(F.lit(seed), nulls, *columns) for seed in (1, 2)]


def profile_dataset(df: DataFrame) -> DataFrame:
    """Rows, cells, missing cells, duplicate rows and columns per kind, in one row.

    Duplicates are found by a fingerprint of each row. Whole rows are compared only where a fingerprint repeats, so a
    clash of fingerprints makes no duplicate.
    """
    kinds = columns_by_kind(df)
    width = len(df.columns)
    first, second = fingerprint(df.columns)
    gaps = sum((_gap(df, c).cast("int") for c in df.columns), F.lit(0))
    seen = Observation()
    # equal rows are counted together before the shuffle, so copies do not pile up in one task
    prints = (df.select(first.alias("_f1"), second.alias("_f2"), gaps.alias("_gaps")).groupBy("_f1", "_f2")
              .agg(F.count(F.lit(1)).alias("_n"), F.sum("_gaps").alias("_gaps"))
              .observe(seen, F.sum("_n").alias("rows"), F.sum("_gaps").alias("missing"), F.count_if(F.col("_n") > 1).alias("repeated")))
    repeated = lookup(prints.where("_n > 1").select("_f1", "_f2"))
    rows, missing = seen.get["rows"] or 0, seen.get["missing"] or 0
    if seen.get["repeated"]:
        same = df.withColumns({"_f1": first, "_f2": second}).join(repeated, ["_f1", "_f2"], "left_semi")
        one = same.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("total_duplicates"))
    else:
        one = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("total_duplicates"))
    count = lambda n: F.lit(n).cast("long")
    return one.select(
        count(rows).alias("rows"), F.lit(width).alias("columns"), count(rows * width).alias("total_cells"),
        count(missing).alias("total_missing"), percent(count(missing), count(rows * width)).alias("missing_pct"), "total_duplicates",
        percent(F.col("total_duplicates"), count(rows)).alias("duplicate_pct"),
        *[F.lit(len(kinds[k])).alias(f"{k}_columns") for k in ("numeric", "categorical", "datetime", "boolean")])


def _presence(df: DataFrame, columns: Sequence[str], approx: bool) -> DataFrame:
    counts = null_counts(df.select(*columns)).select(
        "column", "rows", (F.col("rows") - F.col("missing")).alias("count"), "missing",
        half_even(F.col("missing") / F.nullif("rows", F.lit(0)) * 100.0, 1).alias("missing_pct"))
    both = counts.join(distinct_counts(df, columns, approx), "column")
    return both.withColumn("unique_pct", percent(F.col("unique"), F.col("rows"))).drop("rows")


def profile_numeric(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    columns = numeric_columns(df)
    stats = moments(df, columns)
    quart = with_quantiles(df, columns, (0.25, 0.5, 0.75), ("q25", "median", "q75"))
    n = F.col("n")
    shown = [half_even(F.col(src)).alias(name) for src, name in (
        ("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "q25"), ("median", "median"), ("q75", "q75"),
        ("max", "max"), ("skew", "skewness"), ("kurt", "kurtosis"))]
    shape = stats.join(F.broadcast(quart), "column", "left").select(
        "column", *shown, "zeros", half_even(F.col("zeros") / F.nullif(n, F.lit(0)) * 100.0, 1).alias("zeros_pct"),
        F.col("negatives").alias("negative"))
    return _presence(df, columns, approx_distinct).join(F.broadcast(shape), "column")


def profile_datetime(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """First and last moment and the whole days between them."""
    columns = datetime_columns(df)
    cells = []
    for c in columns:
        t = F.col(c).cast("timestamp_ntz")
        lo, hi = F.min(t), F.max(t)
        days = F.floor(F.timestamp_diff("SECOND", lo, hi) / 86400)
        cells.append(F.struct(F.lit(c).alias("column"), lo.alias("min_date"), hi.alias("max_date"),
                              days.alias("date_range_days")))
    span = df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("c")).select("c.*")
    return _presence(df, columns, approx_distinct).join(F.broadcast(span), "column")


def profile_categorical(df: DataFrame) -> DataFrame:
    """Most and least common value and the mean text length, from the value counts alone."""
    columns = text_columns(df)
    freq = value_frequencies(df, columns)
    lengths = freq.groupBy("column").agg(
        half_even(F.sum(F.length("value") * F.col("cnt")) / F.sum("cnt"), 1).alias("avg_length"))
    modes = mode_summary(freq)
    shape = modes.join(F.broadcast(lengths), "column").select(
        "column", F.col("unique_values").alias("unique"), "most_common", "most_common_count",
        half_even(F.col("most_common_count") / F.col("rows") * 100.0, 1).alias("most_common_pct"),
        "least_common", "avg_length")
    gaps = null_counts(df.select(*columns))
    rows = F.col("rows")
    return (gaps.join(F.broadcast(shape), "column", "left")
            .withColumn("unique", F.coalesce("unique", F.lit(0)))
            .select("column", (rows - F.col("missing")).alias("count"), "missing",
                    half_even(F.col("missing") / F.nullif("rows", F.lit(0)) * 100.0, 1).alias("missing_pct"),
                    "unique", percent(F.col("unique"), rows).alias("unique_pct"), "most_common",
                    "most_common_count", "most_common_pct", "least_common", "avg_length"))


def missing_matrix(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The table with every cell replaced by whether it is missing; ``keep`` columns stay."""
    return df.select(*keep, *[_gap(df, c).alias(c) for c in df.columns if c not in keep])


def _two_values(df: DataFrame) -> DataFrame:
    """Per column the smallest and largest value as text, and whether they are the same."""
    cells = [F.struct(F.lit(c).alias("column"), F.min(c).cast("string").alias("lo"),
                      F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias("same")) for c in df.columns]
    return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("c")).select("c.*")


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct value. Smallest = largest says so without counting."""
    return _two_values(df).where("same").select("column", F.coalesce("lo", F.lit("N/A")).alias("value"))


def high_cardinality(df: DataFrame, threshold: float = 0.9, approx: bool = False) -> DataFrame:
    """Text columns where distinct values / rows exceeds ``threshold``."""
    columns = text_columns(df)
    rows = F.col("rows")
    share = F.col("unique") / F.greatest(rows, F.lit(1))
    return (null_counts(df.select(*columns)).join(distinct_counts(df, columns, approx), "column")
            .where(share > threshold)
            .select("column", F.col("unique").alias("unique_count"), half_even(share * 100.0, 1).alias("unique_pct")))


def zero_variance(df: DataFrame) -> DataFrame:
    return _two_values(df.select(*numeric_columns(df))).where("same").select("column")


def missing_correlation(df: DataFrame, threshold: float = 0.5, shares: Mapping[str, float] | None = None) -> DataFrame:
    """Pairs of columns whose gaps fall on the same rows (|r| > ``threshold``); ``shares`` of missing cells, where known, save a scan."""
    marks = missing_matrix(df)
    marks = marks.select(*[F.col(c).cast("double").alias(c) for c in marks.columns])
    return pair_correlations(marks, list(combinations(marks.columns, 2)), shares).where(F.abs("r") > threshold)


def expect_table(df: DataFrame | None, name: str = "table") -> DataFrame:
    """Not None, a DataFrame, with columns and at least one row."""
    if df is None:
        raise ExpectationError(f"{name}: no data given")
    if not isinstance(df, DataFrame):
        raise ExpectationError(f"{name}: expected a DataFrame, got {type(df).__name__}")
    if not df.columns:
        raise ExpectationError(f"{name}: the table has no columns")
    if df.isEmpty():
        raise ExpectationError(f"{name}: the table has no rows")
    return df


def expect_columns(df: DataFrame, columns: str | Sequence[str], name: str = "table") -> DataFrame:
    wanted = [columns] if isinstance(columns, str) else list(columns)
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ExpectationError(f"{name}: missing column(s) {missing}",
                               {"missing": missing, "available": df.columns})
    return df


def expect_numeric(df: DataFrame, columns: str | Sequence[str], name: str = "table") -> DataFrame:
    expect_columns(df, columns, name)
    wanted = [columns] if isinstance(columns, str) else list(columns)
    other = [c for c in wanted if not is_numeric(df, c)]
    if other:
        raise ExpectationError(f"{name}: not numeric: {other}", {"non_numeric": other})
    return df


def expect_min_rows(df: DataFrame, min_rows: int = 5, name: str = "table") -> DataFrame:
    """Reads no more than ``min_rows`` rows."""
    rows = df.select(F.lit(1)).limit(min_rows).count()
    if rows < min_rows:
        raise ExpectationError(f"{name}: {rows} row(s), at least {min_rows} needed",
                               {"rows": rows, "required": min_rows})
    return df


def error_result(fn: Callable) -> Callable:
    """Turns a failed expectation of ``fn`` into an ``{"error": message}`` result."""
    @wraps(fn)
    def guarded(*args, **kwargs):
        try:
            return fn(*args, **kwargs)
        except ExpectationError as e:
            return {"error": str(e)}
    return guarded


def expectation_report(df: DataFrame, columns: Sequence[str] = (), numeric: Sequence[str] = (), min_rows: int = 5,
                       name: str = "table") -> DataFrame:
    """One row per check: check, subject, passed, message (null if it passed)."""
    checks = [("rows", name, expect_table, ())]
    checks += [("column", c, expect_columns, (c,)) for c in columns]
    checks += [("numeric", c, expect_numeric, (c,)) for c in numeric]
    checks += [("min_rows", str(min_rows), expect_min_rows, (min_rows,))]
    rows = []
    for check, subject, expect, arguments in checks:
        found = error_result(expect)(df, *arguments, name)
        message = found["error"] if isinstance(found, dict) else None
        rows.append((check, subject, message is None, message))
    return df.sparkSession.createDataFrame(rows, "check string, subject string, passed boolean, message string")


class Gate:
    """Expectations that are counted while a table passes through to its destination, at no scan of its own.

    ``rules`` are named conditions that every row must meet; a condition that is null counts as not met.
    """

    def __init__(self, columns: Sequence[str] = (), numeric: Sequence[str] = (), min_rows: int = 5,
                 rules: Mapping[str, Column] | None = None, name: str = "table"):
        self.columns, self.numeric, self.min_rows, self.rules, self.name = columns, numeric, min_rows, dict(rules or {}), name
        self._seen = Observation()
        self._df: DataFrame | None = None

    def watch(self, df: DataFrame) -> DataFrame:
        """The table, unchanged; the checks are complete once it has been written or read in full."""
        expect_columns(df, list(self.columns), self.name)
        self._df = df
        broken = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"broken{i}") for i, rule in enumerate(self.rules.values())]
        return df.observe(self._seen, F.count(F.lit(1)).alias("rows"), *broken)

    def results(self) -> list[tuple[str, str, bool, str | None]]:
        """(check, subject, passed, message) of all checks, after the table has gone through."""
        rows = self._seen.get["rows"]
        found = [("rows", self.name, rows > 0, f"{self.name}: the table has no rows")]
        found += [("column", c, True, None) for c in self.columns]
        found += [("numeric", c, is_numeric(self._df, c), f"{self.name}: not numeric: {[c]}") for c in self.numeric]
        found += [("min_rows", str(self.min_rows), rows >= self.min_rows, f"{self.name}: {rows} row(s), at least {self.min_rows} needed")]
        for i, rule in enumerate(self.rules):
            broken = self._seen.get[f"broken{i}"]
            found.append(("rule", rule, broken == 0, f"{self.name}: {broken} of {rows} row(s) break {rule!r}"))
        return [(check, subject, passed, None if passed else message) for check, subject, passed, message in found]

    def report(self) -> DataFrame:
        return self._df.sparkSession.createDataFrame(self.results(), "check string, subject string, passed boolean, message string")

    def check(self) -> None:
        failed = [message for _, _, passed, message in self.results() if not passed]
        if failed:
            raise ExpectationError("; ".join(failed), {"failed": failed})


def gated_write(df: DataFrame, path: str, gate: Gate) -> DataFrame:
    """Write the table as Parquet and count the gate's checks on the way; the report of the checks."""
    gate.watch(df).write.parquet(path)
    return gate.report()


def expectations(df: DataFrame, columns: Sequence[str] = (), numeric: Sequence[str] = (),
                 min_rows: int = 5, name: str = "table") -> DataFrame:
    """All checks; the table passes through unchanged."""
    expect_table(df, name)
    expect_columns(df, columns, name)
    expect_numeric(df, numeric, name)
    return expect_min_rows(df, min_rows, name)
