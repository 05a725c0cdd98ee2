"""Projections, derived columns and filters; all narrow, so they also run on a stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions.columns import half_even, number, ratio
from tabulith.functions.kinds import is_numeric, is_text, present, require_columns, require_numeric

WIDEST = 5_000  # columns that one-hot coding or a pivot may add to a table



def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Renamed table; unchanged if ``old`` is missing or ``new`` is taken."""
    if old not in df.columns or new in df.columns:
        return df
    return df.withColumnRenamed(old, new)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def calculated_column(df: DataFrame, name: str, left: str, right: str, operation: str) -> DataFrame:
    """``name`` = left (add | subtract | multiply | divide | ratio_pct) right, rounded to 2 places."""
    require_columns(df, left, right)
    a, b = number(left), number(right)
    formulas = {
        "add": a + b,
        "subtract": a - b,
        "multiply": a * b,
        "divide": ratio(a, b),
        "ratio_pct": ratio(a, b) * 100.0,
    }
    if operation not in formulas:
        raise ValueError(f"unknown operation {operation!r}; use one of {sorted(formulas)}")
    return df.withColumn(name, half_even(formulas[operation]))


def bin_number(x: Column, lo: float, hi: float, bins: int) -> Column:
    """1-based number of the right-closed equal-width bin that holds ``x``."""
    width = (hi - lo) / bins
    guess = F.ceil((x - lo) / F.lit(width))
    # the division may land one bin off; compare with the edges themselves
    settled = (F.when(x <= lo + (guess - 1) * F.lit(width), guess - 1)
               .when(x > lo + guess * F.lit(width), guess + 1).otherwise(guess))
    # greatest and least skip nulls, a missing value has no bin
    return F.when(x.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(bins), settled))).cast("int")


def bin_range(df: DataFrame, column: str) -> tuple[float, float] | None:
    """Smallest and largest value, pulled apart by 0.1 % when they are equal."""
    lo, hi = df.agg(F.min(number(column)), F.max(number(column))).first()
    if lo is None:
        return None
    if lo == hi:
        return lo - (0.001 * abs(lo) or 0.001), hi + (0.001 * abs(hi) or 0.001)
    return lo, hi


def bin_equal_width(df: DataFrame, column: str, bins: int = 5,
                    labels: Sequence[str] | None = None) -> DataFrame:
    """Adds ``{column}_bin`` (1..bins), its edges and ``{column}_binned`` (label)."""
    require_numeric(df, column)
    span = bin_range(df, column)
    if span is None:
        empty = F.lit(None)
        return df.withColumns({f"{column}_bin": empty.cast("int"), f"{column}_bin_lo": empty.cast("double"),
                               f"{column}_bin_hi": empty.cast("double"), f"{column}_binned": empty.cast("string")})
    lo, hi = span
    width = (hi - lo) / bins
    low_end = lo - 0.001 * (hi - lo)  # the first edge moves down so that the minimum is inside
    out = df.withColumn(f"{column}_bin", bin_number(number(column), lo, hi, bins))
    i = F.col(f"{column}_bin")
    out = out.withColumn(f"{column}_bin_lo", F.when(i == 1, F.lit(low_end)).otherwise(lo + (i - 1) * width))
    out = out.withColumn(f"{column}_bin_hi", F.when(i == bins, F.lit(hi)).otherwise(lo + i * width))
    if labels is not None and len(labels) == bins:
        text = F.get(F.array(*[F.lit(x) for x in labels]), i - 1)
    else:
        text = F.when(i.isNotNull(), F.format_string("(%.3f, %.3f]", f"{column}_bin_lo", f"{column}_bin_hi"))
    return out.withColumn(f"{column}_binned", text)


def map_values(df: DataFrame, column: str, mapping: Mapping) -> DataFrame:
    """Values replaced by ``mapping``; others, and nulls, stay."""
    require_columns(df, column)
    if not mapping:
        return df
    pairs = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return df.withColumn(column, F.coalesce(F.try_element_at(pairs, F.col(column)), F.col(column)))


def map_values_table(df: DataFrame, column: str, lookup: DataFrame) -> DataFrame:
    """``map_values`` with the mapping in a table (from, to) of any size; of several values for a key the smallest holds."""
    new = lookup.groupBy(F.col("from").alias(column)).agg(F.min("to").alias("_to"))
    return (df.join(new, column, "left").withColumn(column, F.coalesce("_to", column))
            .select(*df.columns))


def sorted_values(df: DataFrame, column: str, other_form: str) -> list:
    """The distinct non-null values in order, for results with a column per value: at most ``WIDEST``, which bounds what
    comes to the driver and the schema. For more, the error names the form that has rows in place of columns."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(WIDEST + 1).collect()
    if len(found) > WIDEST:
        raise ValueError(f"{column!r} has more than {WIDEST} values, too many for a column each; use {other_form}")
    return sorted(r[0] for r in found)


def one_hot(df: DataFrame, column: str, drop_original: bool = True, sparse: bool = False) -> DataFrame:
    """One 0/1 column per value. ``sparse`` keeps the same coding in one map column, from the row's value to 1, which
    holds for any number of values."""
    require_columns(df, column)
    if sparse:
        out = df.withColumn(f"{column}_onehot", F.when(F.col(column).isNotNull(), F.create_map(F.col(column), F.lit(1))))
    else:
        out = df.withColumns({
            f"{column}_{v}": F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("int")
            for v in sorted_values(df, column, "sparse=True")})
    return out.drop(column) if drop_original else out


def filter_compare(df: DataFrame, column: str, operator: str, value) -> DataFrame:
    """== equals != > < >= <=. Numbers compare as doubles, other columns as case-insensitive text
    (equality only). != keeps rows without a value."""
    require_columns(df, column)
    operator = {"equals": "=="}.get(operator, operator)
    if is_numeric(df, column):
        # the bare column, so that the test reaches the file scan
        left, right = F.col(column), F.lit(float(value))
        if operator in (">", ">="):
            df = present(df, column)  # NaN is no large number
    else:
        left, right = F.lower(F.col(column).cast("string")), F.lit(str(value).lower())
    if operator == "==":
        return df.where(left == right)
    if operator == "!=":
        return df.where(~left.eqNullSafe(right))
    if operator not in (">", "<", ">=", "<="):
        raise ValueError(f"unknown operator {operator!r}")
    if is_text(df, column):
        raise ValueError(f"{operator} needs a numeric column, {column!r} is text")
    test = {">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}
    return df.where(test[operator])


def filter_contains(df: DataFrame, column: str, pattern: str, negate: bool = False) -> DataFrame:
    """Case-insensitive regular-expression search; the negation keeps rows without a value."""
    require_columns(df, column)
    found = F.coalesce(F.col(column).cast("string").rlike("(?i)" + pattern), F.lit(False))
    return df.where(~found if negate else found)


def filter_between(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    require_numeric(df, column)
    return df.where(F.col(column).between(float(low), float(high)))


def filter_auto(df: DataFrame, column: str, value: str) -> DataFrame:
    """Equality for a number in a numeric column, otherwise a text search."""
    require_columns(df, column)
    try:
        wanted = float(value) if is_numeric(df, column) else None
    except ValueError:
        wanted = None
    if wanted is not None:
        return filter_compare(df, column, "==", wanted)
    return filter_contains(df, column, value)
