"""Checks on tax rates, tax ids, document dates and repeated amounts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.functions.columns import number, percent, strip
from tabulith.functions.kinds import is_numeric, present, require_columns, resolve_column
from tabulith.operators.ordering import sorted_rows
from tabulith.operators.windows import sequence_gaps
from tabulith.session import lookup

# Column names looked for, in this order.
ITEM_NAMES = ("item", "product", "service", "description", "name", "particular")
TAX_NAMES = ("tax", "vat", "gst", "tax_rate", "vat_rate", "tax_pct", "tax_amount")
TAX_ID_NAMES = ("trn", "tax_registration", "tin", "vat_number", "gst_number", "tax_id", "registration_number", "ein")
DATE_NAMES = ("date", "invoice_date", "transaction_date", "bill_date", "posting_date")
INVOICE_NAMES = ("invoice", "invoice_no", "invoice_number", "bill_no", "receipt_no", "doc_no")
AMOUNT_NAMES = ("amount", "total", "value", "invoice_amount", "net_amount")


def _rates(df: DataFrame, item: str, tax: str) -> DataFrame:
    """Per item: distinct rates, mean, min, max. Rates are counted before items are grouped."""
    x = number(tax)
    counts = (df.select(item, x.alias("rate")).transform(present, item)
              .groupBy(item, "rate").agg(F.count("rate").alias("n")))
    return counts.groupBy(item).agg(
        F.count("rate").alias("distinct_rates"),
        (F.sum(F.col("rate") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("average_rate"),
        F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"))


def tax_consistency(df: DataFrame, item: str | None = None, tax: str | None = None) -> DataFrame | None:
    """Items with more than one tax rate; None when the columns cannot be found."""
    item = item or resolve_column(df, ITEM_NAMES)
    tax = tax or resolve_column(df, TAX_NAMES)
    if item is None or tax is None or not {item, tax} <= set(df.columns):
        return None
    return _rates(df, item, tax).where("distinct_rates > 1")


def tax_consistency_rates(df: DataFrame, item: str, tax: str) -> DataFrame:
    """All rates of the inconsistent items, as rows (item, rate, n) rather than one list per item."""
    counts = (df.select(item, number(tax).alias("rate")).transform(present, item)
              .groupBy(item, "rate").agg(F.count(F.lit(1)).alias("n")))
    mixed = tax_consistency(df, item, tax).select(item)
    return counts.join(mixed, item, "left_semi")


def tax_consistency_summary(df: DataFrame, item: str, tax: str) -> DataFrame:
    rates = _rates(df, item, tax)
    return rates.agg(F.count(F.lit(1)).alias("items_checked"),
                     F.count_if(F.col("distinct_rates") > 1).alias("inconsistent_items")).withColumn(
        "pct_inconsistent", percent(F.col("inconsistent_items"), F.col("items_checked")))


def missing_tax_id(df: DataFrame, column: str | None = None) -> DataFrame | None:
    """Rows whose tax id is null or blank; None when there is no such column."""
    column = column or resolve_column(df, TAX_ID_NAMES)
    if column is None:
        return None
    text = strip(F.col(column).cast("string"))
    return df.where(text.isNull() | (text == ""))


def missing_tax_id_summary(df: DataFrame, column: str | None = None) -> DataFrame | None:
    column = column or resolve_column(df, TAX_ID_NAMES)
    if column is None:
        return None
    text = strip(F.col(column).cast("string"))
    return df.agg(F.count(F.lit(1)).alias("total_records"),
                  F.count_if(text.isNull() | (text == "")).alias("missing")).withColumn(
        "missing_pct", percent(F.col("missing"), F.col("total_records")))


def _as_time(df: DataFrame, column: str):
    """The column as a timestamp without zone; text that is not a date becomes null."""
    require_columns(df, column)
    return F.expr(f"try_cast(`{column}` AS timestamp_ntz)")


def _moment(as_of: datetime | None):
    return F.lit(as_of or datetime.now()).cast("timestamp_ntz")


def future_dated(df: DataFrame, date: str, as_of: datetime | None = None) -> DataFrame:
    return df.where(_as_time(df, date) > _moment(as_of))


def aged_records(df: DataFrame, date: str, as_of: datetime | None = None, days: int = 730) -> DataFrame:
    return df.where(_as_time(df, date) < _moment(as_of) - F.expr(f"INTERVAL {days} DAYS"))


def duplicate_amounts(df: DataFrame, amount: str | None = None) -> DataFrame | None:
    """All rows whose amount occurs more than once (missing amounts count as equal), by amount.

    Amounts are counted first and joined back, so a hot amount is never one window; the
    adaptive skew join splits its rows.
    """
    amount = amount or resolve_column(df, AMOUNT_NAMES)
    if amount is None or not is_numeric(df, amount):
        return None
    x = number(amount)
    repeated = lookup(df.select(x.alias("_amount")).groupBy("_amount").agg(F.count(F.lit(1)).alias("_n"))
                      .where("_n > 1").select("_amount"))
    rows = df.withColumn("_x", x)
    found = rows.join(repeated, rows["_x"].eqNullSafe(repeated["_amount"]), "left_semi").drop("_x")
    return sorted_rows(found, F.col(amount).asc_nulls_last())


def compliance_summary(df: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """All checks on the columns that can be found, in one row. Repeated amounts are counted in a
    column of their own and do not enter the issues."""
    tax = tax_consistency(df)
    mixed = 0 if tax is None or tax.isEmpty() else 1
    ids = missing_tax_id(df)
    no_id = 0 if ids is None else ids.count()
    date, invoice = resolve_column(df, DATE_NAMES), resolve_column(df, INVOICE_NAMES)
    late = old = gaps = 0
    if date:
        t, now = _as_time(df, date), _moment(as_of)
        late, old = df.agg(F.count_if(t > now), F.count_if(t < now - F.expr("INTERVAL 730 DAYS"))).first()
    if invoice:
        gaps = sequence_gaps(df, invoice).count()
    twins = duplicate_amounts(df)
    repeated = 0 if twins is None else twins.count()
    dated = late + old + gaps
    issues = mixed + no_id + dated
    status = "Clean" if issues == 0 else "Minor Issues" if issues < 5 else "Needs Review"
    row = (4, sum(bool(n) for n in (mixed, no_id, dated)), issues, status, late, old, gaps, no_id, repeated)
    return df.sparkSession.createDataFrame([row], (
        "total_checks int, checks_with_issues int, total_issues long, overall_status string, future_dated long, "
        "aged long, sequence_gaps long, missing_tax_ids long, duplicate_amount_rows long"))
