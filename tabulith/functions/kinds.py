"""Which columns are numeric, text, date-like or boolean; name lookups. Schema only, no Spark job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that mark a column name as financial.
FINANCE_WORDS = (
    "amount", "price", "cost", "revenue", "sales", "profit", "expense", "budget", "actual",
    "variance", "tax", "vat", "total", "subtotal", "discount", "payment", "balance", "income",
    "debit", "credit", "net", "gross", "fee", "salary", "wage", "bonus", "commission", "invoice",
)

_DATE_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _names(df: DataFrame, *types: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types)]


def numeric_columns(df: DataFrame) -> list[str]:
    """Integer, float and decimal columns; booleans are not numbers here."""
    return _names(df, T.NumericType)


def text_columns(df: DataFrame) -> list[str]:
    return _names(df, T.StringType)


def datetime_columns(df: DataFrame) -> list[str]:
    return _names(df, *_DATE_TYPES)


def boolean_columns(df: DataFrame) -> list[str]:
    return _names(df, T.BooleanType)


def columns_by_kind(df: DataFrame) -> dict[str, list[str]]:
    return {
        "numeric": numeric_columns(df),
        "categorical": text_columns(df),
        "datetime": datetime_columns(df),
        "boolean": boolean_columns(df),
    }


def list_columns(df: DataFrame) -> list[tuple[str, str]]:
    return list(df.dtypes)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def financial_columns(df: DataFrame) -> list[str]:
    """Numeric columns with a financial word in the name; every numeric column if there is none."""
    numbers = numeric_columns(df)
    named = [c for c in numbers if any(word in c.lower() for word in FINANCE_WORDS)]
    return named or numbers


def resolve_column(df: DataFrame, candidates: Iterable[str]) -> str | None:
    """The column whose lower-case, underscore-joined name comes first in ``candidates``."""
    by_name = {c.lower().replace(" ", "_"): c for c in df.columns}
    return next((by_name[name] for name in candidates if name in by_name), None)


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such column(s): {missing}; the table has {df.columns}")


def require_numeric(df: DataFrame, *names: str) -> None:
    require_columns(df, *names)
    other = [n for n in names if not is_numeric(df, n)]
    if other:
        raise ValueError(f"column(s) must be numeric: {other}")


def present(df: DataFrame, *names: str) -> DataFrame:
    """Rows where none of the columns is missing, in tests that reach the file scan."""
    for name in dict.fromkeys(names):
        df = df.where(F.col(name).isNotNull())
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            df = df.where(~F.isnan(name))
    return df
