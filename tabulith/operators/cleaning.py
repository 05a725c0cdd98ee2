"""The cleaning steps: missing-value markers, names, types, duplicates, imputation."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions.columns import strip
from tabulith.functions.kinds import datetime_columns, numeric_columns, text_columns
from tabulith.operators.moments import moments, with_quantiles
from tabulith.operators.ordering import fill_both_ways, lay_out
from tabulith.session import lookup

# Texts that mean "missing", compared after stripping, case matters.
MARKERS = (
    "", " ", "nan", "NaN", "NAN", "null", "NULL", "none", "None", "NONE",
    "n/a", "N/A", "NA", "na", "#N/A", "#NA", "#REF!", "#VALUE!", "#DIV/0!",
    "-", "--", "---", ".", "..", "missing", "Missing", "MISSING",
    "undefined", "not available", "not applicable", "nil", "NIL",
)
# Currency signs and the thousands separator, dropped before a number is read.
CURRENCY = "[$€£¥,]"
UNKNOWN = "Unknown"

# The month abbreviations in calendar order.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

_YEAR_FIRST = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})((?:[T ]\d.*)?)$"
_YEAR_LAST = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})((?:[T ]\d.*)?)$"
_DAY_MONTH = r"^(\d{1,2})[- ]([A-Za-z]{3})[a-z]*[- ,]+(\d{4})((?:[T ]\d.*)?)$"
_MONTH_DAY = r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})((?:[T ]\d.*)?)$"


def is_marker(col: Column) -> Column:
    return strip(col).isin(*MARKERS)


def null_markers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Marker texts become null; other values keep their blanks."""
    names = text_columns(df) if columns is None else columns
    return df.withColumns({c: F.when(~is_marker(F.col(c)), F.col(c)) for c in names}) if names else df


def marker_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How many values of each text column are markers."""
    names = text_columns(df) if columns is None else columns
    cells = [F.struct(F.lit(c).alias("column"), F.count_if(is_marker(F.col(c))).alias("markers")) for c in names]
    return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("c")).select("c.*")


def standard_name(name: str) -> str:
    """Lower snake case; ``unnamed_column`` if nothing is left."""
    words = re.findall(r"[^\W_]+", str(name))
    return "_".join(words).lower() or "unnamed_column"


def standard_names(names: Sequence[str]) -> list[str]:
    """Standard names made unique: a repeated one gets ``_2``, ``_3``, ..."""
    taken: set[str] = set()
    out = []
    for name in names:
        base = candidate = standard_name(name)
        k = 1
        while candidate in taken:
            k += 1
            candidate = f"{base}_{k}"
        taken.add(candidate)
        out.append(candidate)
    return out


def standardize_names(df: DataFrame) -> DataFrame:
    return df.toDF(*standard_names(df.columns))


def as_timestamp(col: Column) -> Column:
    """The text as a timestamp, else null; bare numbers are no dates.

    The text is brought to year-month-day form by its shape, then cast: a cast that fails costs
    nothing, while trying one format after the other would raise inside for every miss. In
    03/04/2024 the month comes first unless that cannot be.
    """
    text = strip(col)

    def iso(pattern: str, parts: str) -> Column:
        return F.regexp_replace(text, pattern, parts).try_cast("timestamp_ntz")

    def named_month(pattern: str, name: int, day: int) -> Column:
        at = F.instr(F.lit(MONTHS), F.lower(F.regexp_extract(text, pattern, name)))
        month = F.when(at % 3 == 1, F.floor((at + 2) / 3)).cast("string")
        whole = F.concat(F.regexp_extract(text, pattern, 3), F.lit("-"), month, F.lit("-"),
                         F.regexp_extract(text, pattern, day), F.regexp_extract(text, pattern, 4))
        return whole.try_cast("timestamp_ntz")

    return (F.when(text.rlike(_YEAR_FIRST), iso(_YEAR_FIRST, "$1-$2-$3$4"))
            .when(text.rlike(_YEAR_LAST), F.coalesce(iso(_YEAR_LAST, "$3-$1-$2$4"), iso(_YEAR_LAST, "$3-$2-$1$4")))
            .when(text.rlike(_DAY_MONTH), named_month(_DAY_MONTH, 2, 1))
            .when(text.rlike(_MONTH_DAY), named_month(_MONTH_DAY, 1, 2)))


def as_number(col: Column) -> Column:
    """The text as a double without currency signs and separators, else null."""
    bare = strip(F.regexp_replace(col, CURRENCY, ""))
    # a cast would also read the Java suffixes of 1d and 2f
    plain = F.when(~bare.rlike("[0-9.][dDfF]$"), bare.try_cast("double"))
    return F.nanvl(plain, F.lit(None).cast("double"))


def kind_of(values: int, dates: int, numbers: int) -> str:
    """The kind of a text column from its non-null texts and those that parse."""
    return "datetime" if values and dates / values > 0.7 else "numeric" if values and numbers / values > 0.8 else "text"


def inferred_kinds(df: DataFrame) -> dict[str, str]:
    """datetime (> 70 % of the non-null texts parse), numeric (> 80 %) or text, per text column.

    One aggregate over all rows decides.
    """
    names = text_columns(df)
    if not names:
        return {}
    aggs = []
    for i, c in enumerate(names):
        aggs += [F.count(F.col(c)).alias(f"n{i}"), F.count(as_timestamp(F.col(c))).alias(f"d{i}"),
                 F.count(as_number(F.col(c))).alias(f"x{i}")]
    row = df.agg(*aggs).first()
    counts = {c: (row[f"n{i}"], row[f"d{i}"], row[f"x{i}"]) for i, c in enumerate(names)}
    return {c: kind_of(*counts[c]) for c in names}


def convert_kinds(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Convert whole columns; what does not parse becomes null, remaining texts are stripped."""
    convert = {"datetime": as_timestamp, "numeric": as_number, "text": strip}
    return df.withColumns({c: convert[k](F.col(c)) for c, k in kinds.items()}) if kinds else df


def infer_types(df: DataFrame) -> DataFrame:
    return convert_kinds(df, inferred_kinds(df))


def trim_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = text_columns(df) if columns is None else columns
    return df.withColumns({c: strip(F.col(c)) for c in names}) if names else df


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One of each set of equal rows; null equals null."""
    return df.dropDuplicates()


def numeric_fill_values(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, tuple[str, float]]:
    """Per column with gaps the fill method and value: median if |skew| > 1, else mean."""
    names = list(columns or numeric_columns(df))
    if not names:
        return {}
    stats = moments(df, names).where("nulls > 0 AND n > 0").select("column", "mean", "skew").collect()
    skewed = [r["column"] for r in stats if r["skew"] is not None and abs(r["skew"]) > 1]
    fills = {r["column"]: ("mean", r["mean"]) for r in stats}
    if skewed:
        for r in with_quantiles(df, skewed, [0.5], ["median"]).collect():
            fills[r["column"]] = ("median", r["median"])
    return {c: (how, round(v, 2)) for c, (how, v) in fills.items()}


def impute_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Gaps take the rounded median or mean; a filled column is a double."""
    return fill_numeric(df, numeric_fill_values(df, columns))


def fill_numeric(df: DataFrame, fills: Mapping[str, tuple[str, float]]) -> DataFrame:
    if not fills:
        return df
    return df.withColumns({
        c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(float(v)))
        for c, (_, v) in fills.items()})


def carried_dates(laid: DataFrame, keys: Sequence[str], dates: Sequence[str]) -> DataFrame:
    """``keys`` and ``_d0.._dn``: what the rows with a gap in one of ``dates`` have once these are filled in the order of ``laid``."""
    gap = reduce(Column.__or__, [F.col(c).isNull() for c in dates])
    filled = fill_both_ways(laid.select(*keys, *dates, "_part", "_pos", gap.alias("_gap")), dates).where("_gap")
    return filled.groupBy(*keys).agg(*[F.max(c).alias(f"_d{i}") for i, c in enumerate(dates)])


def with_carried_dates(df: DataFrame, order: Sequence[str], carried: DataFrame, keys: Sequence[str], dates: Sequence[str]) -> DataFrame:
    """The gaps of ``df`` filled from ``carried_dates``, matched by the order columns."""
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(order, keys)])
    return df.join(lookup(carried), same, "left").withColumns({c: F.coalesce(c, f"_d{i}") for i, c in enumerate(dates)}).select(*df.columns)


def impute_datetime(df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Forward then backward fill in the given order; tables without gaps are left alone. Only the order columns and the
    columns with gaps are put in order, and rows without a gap are not touched."""
    names = datetime_columns(df) if columns is None else list(columns)
    if not names:
        return df
    holes = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).first()
    names = [c for c in names if holes[c]]
    if not names:
        return df
    keys = [f"_k{i}" for i in range(len(order_by))]
    laid = lay_out(df.select(*[F.col(c).alias(k) for c, k in zip(order_by, keys)], *names), keys)
    return with_carried_dates(df, order_by, carried_dates(laid, keys, names), keys, names)


def impute_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = text_columns(df) if columns is None else list(columns)
    return df.fillna(UNKNOWN, subset=names) if names else df


def completeness(missing: int, markers: int, rows: int, width: int) -> tuple[float, float]:
    """(data_completeness, completeness_simple) in percent. The first counts a marker twice, as a
    marker and as the missing value it became; the second counts every cell once."""
    cells = max(rows * width, 1)
    return (round((1 - (missing + markers) / cells) * 100, 1), round((1 - missing / cells) * 100, 1))
