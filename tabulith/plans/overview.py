"""Whole flows over one or two tables, built from the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.functions.kinds import numeric_columns, text_columns
from tabulith.operators import aggregation, anomalies, insights, joins, profiling
from tabulith.operators.forest import isolation_forest
from tabulith.operators.neighbours import lof
from tabulith.plans.cleaning import Cleaned
from tabulith.session import written_once
from tabulith.sources.report import column_profile

Tables = dict[str, DataFrame]


def _made(parts: dict[str, tuple[bool, Callable[[], DataFrame | None]]]) -> Tables:
    """The parts whose condition holds and that have a result."""
    made = {name: build() for name, (wanted, build) in parts.items() if wanted}
    return {name: table for name, table in made.items() if table is not None}


def profile_flow(df: DataFrame) -> Tables:
    profiling.expect_table(df, "table to profile")
    return _made({
        "columns": (True, lambda: column_profile(df)),
        "constants": (True, lambda: profiling.constant_columns(df)),
        "dataset": (True, lambda: profiling.profile_dataset(df)),
        "high_cardinality": (bool(text_columns(df)), lambda: profiling.high_cardinality(df)),
    })


def analysis_flow(df: DataFrame, order_by: Sequence[str]) -> Tables:
    profiling.expect_table(df, "table to analyse")
    numbers, texts = bool(numeric_columns(df)), bool(text_columns(df))
    return _made({
        "categories": (texts, lambda: aggregation.describe_categorical(df)),
        "kpis": (numbers, lambda: aggregation.kpis(df, order_by)),
        "numbers": (numbers, lambda: aggregation.describe_numeric(df)),
        "shape": (True, lambda: aggregation.shape_info(df)),
    })


def insight_flow(cleaned: Cleaned, order_by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(findings, one-row summary) of a cleaned table and its report. The rules read the table many
    times, so the cleaning is done once and kept."""
    table = written_once(cleaned.table, "cleaned")
    found = insights.insights(table, order_by, cleaned.data_completeness, cleaned.duplicates_removed)
    return found, insights.insight_summary(table, order_by, found)


def contamination_for(sensitivity: float) -> float:
    """The default share of anomalies: 1 / sensitivity, kept between 0.01 and 0.3."""
    return max(0.01, min(0.3, 1.0 / sensitivity))


@dataclass
class AnomalyRun:
    """Column findings and their summary; a model's run has its scored rows and share of anomalies too."""

    columns: DataFrame
    summary: DataFrame
    rows: DataFrame | None = None
    contamination: float | None = None


#: per method: the rule for single columns, and the model for whole rows
METHODS: dict[str, tuple[str, Callable[..., DataFrame] | None]] = {
    "zscore": ("zscore", None), "iqr": ("iqr", None), "isolation_forest": ("zscore", isolation_forest), "lof": ("zscore", lof)}


def anomaly_flow(df: DataFrame, method: str = "zscore", sensitivity: float = 2.0, contamination: float | None = None
                 ) -> AnomalyRun:
    """One of ``METHODS``. ``sensitivity`` is the threshold of the column rule (the multiplier of "iqr");
    ``contamination`` is the model's share of anomalies, by default ``contamination_for(sensitivity)``."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; use one of {', '.join(METHODS)}")
    profiling.expect_table(df, "table to search")
    rule, model = METHODS[method]
    run = AnomalyRun(anomalies.outliers_all_columns(df, rule, sensitivity), anomalies.anomaly_summary(df, rule, sensitivity))
    if model is not None:
        run.contamination = contamination_for(sensitivity) if contamination is None else contamination
        run.rows = model(df, contamination=run.contamination)
    return run


def flagged_summary(rows: DataFrame, method: str, columns: Sequence[str]) -> DataFrame:
    """How many rows a model flagged, in one row with a sentence."""
    return rows.agg(F.count_if("is_anomaly").alias("count")).select(
        F.lit(method).alias("method"), F.lit(len(columns)).alias("columns_used"), "count",
        F.format_string("%s: %d unusual row(s) over %d column(s)", F.lit(method), "count",
                        F.lit(len(columns))).alias("summary"))


def join_flow(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "left"
              ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(joined rows, statistics, quality)."""
    for table, key, side in ((left, left_on, "left"), (right, right_on, "right")):
        profiling.expect_table(table, f"{side} side")
        profiling.expect_columns(table, key, f"{side} side")
    arguments = (left, right, left_on, right_on)
    return joins.smart_join(*arguments, how), joins.join_stats(*arguments, how), joins.join_quality(*arguments)
