"""markers -> names -> duplicates -> types -> imputation, with a report of what was done."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tabulith.functions.columns import number
from tabulith.functions.kinds import datetime_columns, is_numeric, text_columns
from tabulith.operators import cleaning as C
from tabulith.operators.moments import with_quantiles
from tabulith.operators.ordering import lay_out, number_rows
from tabulith.operators.sorting import first_rows
from tabulith.session import written_once

REPORT = "column string, metric string, value string"


@dataclass
class Cleaned:
    """The cleaned table and its report, a long table (column, metric, value)."""

    table: DataFrame
    report: DataFrame
    duplicates_removed: int
    data_completeness: float
    completeness_simple: float


def clean_table(df: DataFrame, order_by: Sequence[str]) -> Cleaned:
    """Clean a table whose row order is given by ``order_by`` (columns as they are named before
    cleaning; no two rows are equal in all of them).

    The rows are read once: while the distinct ones are written, the same job counts markers, and gathers of every column
    its values, what they can be read as, and their moments. These decide types, gaps and fill values; only medians read the written
    rows again. The order columns and the dates with gaps are put in order, for the row numbers of gaps and the forward fill.
    """
    width = len(df.columns)
    names = C.standard_names(df.columns)
    order = [names[df.columns.index(c)] for c in order_by]
    texts = text_columns(df)
    before, after = Observation(), Observation()
    marked = C.null_markers(df.observe(before, F.count(F.lit(1)).alias("rows"), *[
        F.count_if(C.is_marker(F.col(c))).alias(f"markers{i}") for i, c in enumerate(texts)]))
    distinct = written_once(_gathered(C.drop_duplicate_rows(C.standardize_names(marked)), after), "distinct")
    state = after.get
    # without any row the part of the plan that counts them is dropped
    first = before.get if state["rows"] else {}
    rows_before, markers = first.get("rows", 0), {c: first.get(f"markers{i}", 0) for i, c in enumerate(texts)}
    rows, kinds, filled = _contents(distinct, state)
    typed = C.convert_kinds(distinct, kinds)
    gaps = {c: rows - n for c, n in filled.items() if n < rows}
    dates = [c for c in datetime_columns(typed) if c in gaps]
    numbers = [c for c in gaps if is_numeric(typed, c)]
    fills = _fill_values(typed, numbers, state)
    out, where = typed, {}
    if gaps:
        holes = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in gaps]))
        keys = [f"_k{i}" for i in range(len(order))]
        laid = lay_out(typed.select(*[F.col(c).alias(k) for c, k in zip(order, keys)], *dates, holes.alias("_holes")), keys)
        where = _first_gaps(laid)
        if dates:
            out = C.with_carried_dates(typed, order, C.carried_dates(laid, keys, dates), keys, dates)
    out = C.fill_numeric(out.select(*names), fills)
    out = C.impute_categorical(out, [c for c in text_columns(out) if c in gaps])

    full, simple = C.completeness(sum(gaps.values()), sum(markers.values()), rows_before, width)
    facts: list[tuple[str | None, str, str]] = [
        (None, "original_rows", str(rows_before)), (None, "original_columns", str(width)),
        (None, "cleaned_rows", str(rows)), (None, "cleaned_columns", str(len(names))),
        (None, "rows_removed", str(rows_before - rows)), (None, "duplicates_removed", str(rows_before - rows)),
        (None, "data_completeness", str(full)), (None, "completeness_simple", str(simple)),
    ]
    facts += [(old, "renamed_to", new) for old, new in zip(df.columns, names) if old != new]
    facts += [(c, "markers_replaced", str(n)) for c, n in markers.items() if n]
    facts += [(c, "converted_to", k) for c, k in kinds.items() if k != "text"]
    for c, n in gaps.items():
        facts.append((c, "missing_before", str(n)))
        facts.append((c, "missing_rows", ", ".join(map(str, where[c])) + ("..." if n > len(where[c]) else "")))
        if c in fills:
            action = f"filled {n} with {fills[c][0]} {fills[c][1]}"
        elif c in dates:
            action = f"filled {n} forward, then backward"
        elif c in numbers:
            action = f"left {n}: the column has no value"
        else:
            action = f"filled {n} with '{C.UNKNOWN}'"
        facts.append((c, "action", action))
    report = df.sparkSession.createDataFrame(facts, REPORT)
    return Cleaned(out, report, rows_before - rows, full, simple)


def _gathered(df: DataFrame, seen: Observation) -> DataFrame:
    """The rows unchanged; ``seen`` gets their number and, per column, the values, those that read as dates and as numbers, and the
    mean and skewness of the numbers."""
    texts, parsed, wanted = text_columns(df), {}, [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        wanted.append(F.count(F.col(c)).alias(f"n{i}"))
        if c in texts:
            parsed |= {f"_date{i}": C.as_timestamp(F.col(c)), f"_number{i}": C.as_number(F.col(c))}
            wanted.append(F.count(f"_date{i}").alias(f"dates{i}"))
        elif is_numeric(df, c):
            parsed[f"_number{i}"] = number(c)
        if f"_number{i}" in parsed:
            x = F.col(f"_number{i}")
            wanted += [F.count(x).alias(f"numbers{i}"), F.avg(x).alias(f"mean{i}"), F.skewness(x).alias(f"skew{i}")]
    return df.withColumns(parsed).observe(seen, *wanted).drop(*parsed) if parsed else df.observe(seen, *wanted)


def _contents(df: DataFrame, state: dict) -> tuple[int, dict[str, str], dict[str, int]]:
    """Row count, the kind of every text column, and the values of every column once it is converted."""
    kinds, filled = {}, {}
    for i, c in enumerate(df.columns):
        filled[c] = state[f"n{i}"]
        if f"dates{i}" in state:
            kinds[c] = C.kind_of(state[f"n{i}"], state[f"dates{i}"], state[f"numbers{i}"])
            filled[c] = {"datetime": state[f"dates{i}"], "numeric": state[f"numbers{i}"]}.get(kinds[c], filled[c])
    return state["rows"], kinds, filled


def _fill_values(typed: DataFrame, columns: Sequence[str], state: dict) -> dict[str, tuple[str, float]]:
    """``numeric_fill_values`` from the gathered moments."""
    means, skewed = {}, []
    for c in columns:
        i = typed.columns.index(c)
        n, mean, g1 = state[f"numbers{i}"], state[f"mean{i}"], state[f"skew{i}"]
        if n:
            means[c] = ("mean", mean)
            if n >= 3 and g1 is not None and abs(g1) * math.sqrt(n * (n - 1)) / (n - 2) > 1:
                skewed.append(c)
    if skewed:
        for r in with_quantiles(typed, skewed, [0.5], ["median"]).collect():
            means[r["column"]] = ("median", r["median"])
    return {c: (how, round(v, 2)) for c, (how, v) in means.items()}


def _first_gaps(laid: DataFrame, n: int = 10) -> dict[str, list[int]]:
    """The 1-based numbers of the first ``n`` rows without a value, per column with gaps."""
    rows = number_rows(laid, "_row").select("_row", F.explode("_holes").alias("column"))
    found: dict[str, list[int]] = {}
    for r in first_rows(rows, ["_row"], n, ["column"]).orderBy("_row").collect():
        found.setdefault(r["column"], []).append(r["_row"] + 1)
    return found
