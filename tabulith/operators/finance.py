"""Budget, expense, tax and income reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions.columns import half_even, number, ratio, total
from tabulith.functions.kinds import present, require_numeric
from tabulith.operators.moments import quantiles
from tabulith.operators.windows import cumulative_share

# Words that mark a transaction type as income.
INCOME_WORDS = ("income", "revenue", "credit", "deposit", "sale", "earning")


def budget_detail(df: DataFrame, budget: str, actual: str) -> DataFrame:
    """Adds variance, variance_pct (null for a zero budget) and status to every row."""
    require_numeric(df, budget, actual)
    b, a = number(budget), number(actual)
    v = a - b
    return df.withColumns({
        "variance": v,
        "variance_pct": half_even(ratio(v, b) * 100.0),
        "status": F.when(v < 0, "Under Budget").when(v > 0, "Over Budget").otherwise("On Target"),
    })


def _totals(budget: str, actual: str) -> list[Column]:
    return [total(number(budget)).alias("b"), total(number(actual)).alias("a")]


def budget_summary(df: DataFrame, budget: str, actual: str) -> DataFrame:
    """Totals and the number of items over, under and exactly on budget, in one row."""
    require_numeric(df, budget, actual)
    v = number(actual) - number(budget)
    sums = df.agg(*_totals(budget, actual), F.count_if(v > 0).alias("over_budget_items"),
                  F.count_if(v < 0).alias("under_budget_items"), F.count_if(v == 0).alias("on_target_items"))
    gap = F.col("a") - F.col("b")
    return sums.select(
        half_even(F.col("b")).alias("total_budget"), half_even(F.col("a")).alias("total_actual"),
        half_even(gap).alias("total_variance"),
        half_even(F.coalesce(ratio(gap, F.col("b")) * 100.0, F.lit(0.0))).alias("total_variance_pct"),
        "over_budget_items", "under_budget_items", "on_target_items")


def budget_by_category(df: DataFrame, budget: str, actual: str, category: str) -> DataFrame:
    """Sums per category, largest variance first; the percentage uses the rounded sums."""
    require_numeric(df, budget, actual)
    gap = number(actual) - number(budget)
    sums = df.transform(present, category).groupBy(category).agg(
        half_even(total(number(budget))).alias("budget"), half_even(total(number(actual))).alias("actual"),
        half_even(total(gap)).alias("variance"))
    pct = ratio(F.col("actual") - F.col("budget"), F.col("budget")) * 100.0
    return sums.withColumn("variance_pct", half_even(pct)).orderBy(F.col("variance").desc(), category)


def expense_breakdown(df: DataFrame, amount: str, category: str) -> DataFrame:
    """Per category total, average, count, min, max, share of the rounded total and running share."""
    require_numeric(df, amount)
    x = number(amount)
    groups = df.transform(present, category).groupBy(category).agg(
        half_even(total(x)).alias("total"), half_even(F.avg(x)).alias("average"), F.count(x).alias("count"),
        half_even(F.min(x)).alias("min"), half_even(F.max(x)).alias("max"))
    whole = groups.agg(F.sum("total")).first()[0] or 0.0
    share = half_even(ratio(F.col("total"), F.lit(whole)) * 100.0, 1)
    shares = cumulative_share(groups.withColumn("percentage", share), category, "percentage", "total")
    return shares.withColumnRenamed("cumulative_share", "cumulative_pct")


def expense_summary(df: DataFrame, amount: str, category: str) -> DataFrame:
    """Total, number of categories, the three largest and their share (100 if there are fewer)."""
    rows = expense_breakdown(df, amount, category)
    at = lambda col, i: F.max(F.when(F.col("position") == i, F.col(col)))
    return rows.agg(
        half_even(F.sum("total")).alias("total_expenses"), F.count(F.lit(1)).alias("n_categories"),
        F.concat_ws(", ", *[at(category, i) for i in range(3)]).alias("top_3_categories"),
        F.coalesce(half_even(at("cumulative_pct", 2), 1), F.lit(100.0)).alias("top_3_percentage"),
        at(category, 0).cast("string").alias("largest_category"), at("total", 0).alias("largest_amount"))


def _finding(check: str, severity: str, n: Column) -> Column:
    return F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), n.alias("count"))


def tax_audit_flags(df: DataFrame, amount: str, tax: str) -> DataFrame:
    """Rows without tax, with zero tax on a positive amount, and with negative tax."""
    require_numeric(df, amount, tax)
    a, t = number(amount), number(tax)
    counts = F.array(
        _finding("missing_tax", "critical", F.count_if(t.isNull())),
        _finding("zero_tax", "warning", F.count_if((t == 0) & (a > 0))),
        _finding("negative_tax", "warning", F.count_if(t < 0)))
    return df.agg(counts.alias("f")).select(F.explode("f").alias("f")).select("f.*")


def effective_rates(df: DataFrame, amount: str, tax: str) -> DataFrame:
    """Rows with positive amount and tax, and their ``effective_rate`` in percent."""
    require_numeric(df, amount, tax)
    a, t = number(amount), number(tax)
    return df.where((a > 0) & (t > 0)).withColumn("effective_rate", half_even(t / a * 100.0))


def tax_rate_detail(df: DataFrame, amount: str, tax: str, item: str) -> DataFrame:
    """Every effective rate of every item with its row count."""
    return (effective_rates(df, amount, tax).transform(present, item)
            .groupBy(item, "effective_rate").agg(F.count(F.lit(1)).alias("n")))


def tax_rate_inconsistency(df: DataFrame, amount: str, tax: str, item: str) -> DataFrame:
    """Items taxed at more than one effective rate: rows, rates, lowest and highest rate. The rates
    themselves are rows of ``tax_rate_detail``, since one item may have any number of them."""
    rates = tax_rate_detail(df, amount, tax, item)
    return rates.groupBy(item).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_rates"),
        F.min("effective_rate").alias("min_rate"), F.max("effective_rate").alias("max_rate"),
    ).where("distinct_rates > 1")


def tax_rate_outliers(df: DataFrame, amount: str, tax: str) -> DataFrame:
    """Rows whose effective rate lies outside 1.5 interquartile ranges; needs more than 5 rates."""
    rows = effective_rates(df, amount, tax)
    if rows.select(F.lit(1)).limit(6).count() <= 5:
        return rows.where(F.lit(False))
    q1, q3 = quantiles(rows, ["effective_rate"], [0.25, 0.75]).first()["q"]
    reach = 1.5 * (q3 - q1)
    rate = F.col("effective_rate")
    return rows.where((rate < q1 - reach) | (rate > q3 + reach))


def tax_findings(df: DataFrame, amount: str, tax: str, item: str | None = None) -> DataFrame:
    """One row per finding: check, subject, severity, count; a positive row when there is none."""
    flags = tax_audit_flags(df, amount, tax).where("count > 0").withColumn("subject", F.lit(None).cast("string"))
    parts = [flags]
    if item is not None:
        parts.append(tax_rate_inconsistency(df, amount, tax, item).select(
            F.lit("inconsistent_rate").alias("check"), F.lit("critical").alias("severity"),
            F.col("rows").alias("count"), F.col(item).cast("string").alias("subject")))
    odd = tax_rate_outliers(df, amount, tax).agg(F.count(F.lit(1)).alias("count")).where("count > 0")
    parts.append(odd.select(F.lit("rate_outlier").alias("check"), F.lit("warning").alias("severity"), "count",
                            F.lit(None).cast("string").alias("subject")))
    found = reduce(DataFrame.unionByName, parts)
    clean = found.agg(F.count(F.lit(1)).alias("k")).where("k = 0").select(
        F.lit("none").alias("check"), F.lit("positive").alias("severity"), F.col("k").alias("count"),
        F.lit(None).cast("string").alias("subject"))
    return found.unionByName(clean).select("check", "subject", "severity", "count")


def audit_summary(df: DataFrame, amount: str, tax: str, item: str | None = None) -> DataFrame:
    """Sum of the counts of all findings, and how many findings are critical and warnings."""
    severity = F.col("severity")
    return tax_findings(df, amount, tax, item).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_findings"),
        F.count_if(severity == "critical").alias("critical_count"),
        F.count_if(severity == "warning").alias("warning_count"))


def financial_ratios(df: DataFrame, revenue: str | None = None, cost: str | None = None,
                     profit: str | None = None, assets: str | None = None) -> DataFrame:
    """One row; a ratio is null where its denominator is not positive and absent without its columns."""
    def share(top: Column, bottom: Column) -> Column:
        return half_even(F.when(bottom > 0, ratio(top, bottom) * 100.0))

    sums = {k: total(number(c)) for k, c in
            (("revenue", revenue), ("cost", cost), ("profit", profit), ("assets", assets)) if c}
    out = []
    if revenue and cost:
        out += [share(sums["revenue"] - sums["cost"], sums["revenue"]).alias("gross_margin"),
                share(sums["cost"], sums["revenue"]).alias("cost_ratio")]
    if profit and revenue:
        out.append(share(sums["profit"], sums["revenue"]).alias("profit_margin"))
    if profit and assets:
        out.append(share(sums["profit"], sums["assets"]).alias("roa"))
    if revenue:
        x = number(revenue)
        out += [half_even(F.avg(x)).alias("avg_revenue"), half_even(sums["revenue"]).alias("total_revenue"),
                half_even(F.stddev_samp(x)).alias("revenue_std")]
    if not out:
        raise ValueError("name at least a revenue column, or profit and assets")
    return df.agg(*out)


def income_expense(df: DataFrame, amount: str, type_column: str | None = None) -> DataFrame:
    """Income against expense in one row: by the words of ``type_column`` (everything that is not
    income is expense), or by the sign of the amount."""
    require_numeric(df, amount)
    x = number(amount)
    if type_column:
        is_income = F.coalesce(F.lower(F.col(type_column).cast("string")).rlike("|".join(INCOME_WORDS)), F.lit(False))
        spent = total(F.when(~is_income, x))
    else:
        is_income = x >= 0
        spent = F.abs(total(F.when(x < 0, x)))
    sums = df.agg(total(F.when(is_income, x)).alias("i"), spent.alias("e"))
    i, e = F.col("i"), F.col("e")
    share = lambda part, whole: half_even(part / F.greatest(whole, F.lit(1.0)) * 100.0, 1)
    return sums.select(
        half_even(i).alias("total_income"), half_even(e).alias("total_expenses"),
        half_even(i - e).alias("net_amount"), share(i, i + e).alias("income_pct"),
        share(e, i + e).alias("expense_pct"), share(i - e, i).alias("savings_rate"))
