"""Report tables: one folder per section."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tabulith.operators.aggregation import describe_numeric, kpis
from tabulith.operators.anomalies import anomalies_combined
from tabulith.operators.profiling import profile_categorical, profile_datetime, profile_numeric
from tabulith.functions.kinds import datetime_columns, numeric_columns, text_columns
from tabulith.sources.files import column_totals


def column_profile(df: DataFrame) -> DataFrame | None:
    """The profiles of all kinds of columns in one table."""
    parts = [make(df) for make, names in ((profile_numeric, numeric_columns(df)),
                                          (profile_datetime, datetime_columns(df)),
                                          (profile_categorical, text_columns(df))) if names]
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def report_sections(df: DataFrame, order_by: Sequence[str], cleaning_report: DataFrame | None = None,
                    method: str = "zscore", threshold: float = 2.0) -> dict[str, DataFrame]:
    """All tables of the report over a cleaned table."""
    sections = {"cleaned_data": df, "column_totals": column_totals(df)}
    if numeric_columns(df):
        sections["dashboard"] = kpis(df, order_by)
        sections["statistics"] = describe_numeric(df)
        sections["anomalies"] = anomalies_combined(df, method, threshold)
    profile = column_profile(df)
    if profile is not None:
        sections["data_profile"] = profile
    if cleaning_report is not None:
        sections["cleaning_report"] = cleaning_report
    return sections


def report_sink(sections: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, str]:
    """Write every section to ``path/section``; returns where each one went."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unsupported report format {fmt!r}")
    written = {}
    for name, df in sections.items():
        target = f"{path.rstrip('/')}/{name}"
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(target)
        written[name] = target
    return written
