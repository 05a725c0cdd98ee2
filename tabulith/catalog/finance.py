"""Finance queries over line items, with taxes that are partly missing, zero or negative."""

from tabulith.catalog import query, table
from tabulith.catalog.aggregation import rounded
from tabulith.operators import finance as F

_ACTUAL = "l_extendedprice * (1 - l_discount)"
_LINES = f"(SELECT *, {_ACTUAL} AS actual FROM lineitem)"


def lines(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "*", f"{_ACTUAL} AS actual")


@query("budget_detail", f"""SELECT l_orderkey, l_partkey, round(actual - l_extendedprice, 4) AS variance,
 round((actual - l_extendedprice) / nullif(l_extendedprice, 0) * 100, 1) AS variance_pct,
 CASE WHEN actual < l_extendedprice THEN 'Under Budget' WHEN actual > l_extendedprice THEN 'Over Budget'
  ELSE 'On Target' END AS status FROM {_LINES}""")
def _(spark, sf):
    from pyspark.sql import functions as S
    out = F.budget_detail(lines(spark, sf), "l_extendedprice", "actual")
    return rounded(out.select("l_orderkey", "l_partkey", S.round("variance", 4).alias("variance"), "variance_pct",
                              "status"), "variance_pct", digits=1)


@query("budget_summary", f"""SELECT round_even(sum(l_extendedprice), 2) AS total_budget, round_even(sum(actual), 2) AS total_actual,
 round_even(sum(actual) - sum(l_extendedprice), 2) AS total_variance,
 round_even((sum(actual) - sum(l_extendedprice)) / sum(l_extendedprice) * 100, 2) AS total_variance_pct,
 count(*) FILTER (actual > l_extendedprice) AS over_budget_items, count(*) FILTER (actual < l_extendedprice) AS under_budget_items,
 count(*) FILTER (actual = l_extendedprice) AS on_target_items FROM {_LINES}""")
def _(spark, sf):
    return F.budget_summary(lines(spark, sf), "l_extendedprice", "actual")


@query("budget_by_category", f"""SELECT l_returnflag, budget, actual, variance,
 round_even((actual - budget) / nullif(budget, 0) * 100, 2) AS variance_pct FROM (SELECT l_returnflag,
  round_even(sum(l_extendedprice), 2) AS budget, round_even(sum(actual), 2) AS actual,
  round_even(sum(actual - l_extendedprice), 2) AS variance FROM {_LINES} GROUP BY 1)""")
def _(spark, sf):
    return F.budget_by_category(lines(spark, sf), "l_extendedprice", "actual", "l_returnflag")


_EXPENSE = """WITH g AS (SELECT o_orderpriority, round_even(sum(o_totalprice), 2) AS total, round_even(avg(o_totalprice), 2) AS average,
  count(*) AS count, round_even(min(o_totalprice), 2) AS min, round_even(max(o_totalprice), 2) AS max FROM orders GROUP BY 1),
 s AS (SELECT *, round_even(total / (SELECT sum(total) FROM g) * 100, 1) AS percentage FROM g),
 c AS (SELECT *, round_even(sum(percentage) OVER w, 1) AS cumulative_pct, row_number() OVER w - 1 AS position FROM s
  WINDOW w AS (ORDER BY total DESC, o_orderpriority))"""


@query("expense_breakdown", _EXPENSE + " SELECT * FROM c")
def _(spark, sf):
    return F.expense_breakdown(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")


@query("expense_summary", _EXPENSE + """ SELECT round_even(sum(total), 2) AS total_expenses, count(*) AS n_categories,
 string_agg(CASE WHEN position < 3 THEN o_orderpriority END, ', ' ORDER BY position) AS top_3_categories,
 max(CASE WHEN position = 2 THEN cumulative_pct END) AS top_3_percentage,
 max(CASE WHEN position = 0 THEN o_orderpriority END) AS largest_category, max(total) AS largest_amount FROM c""")
def _(spark, sf):
    return F.expense_summary(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")


# the tax amount of a line: absent for returned lines of quantity 7, negative for those of quantity 9
_TAX = """CASE WHEN l_returnflag = 'R' AND l_quantity = 7 THEN NULL
 WHEN l_returnflag = 'R' AND l_quantity = 9 THEN -l_extendedprice * l_tax
 WHEN l_returnflag = 'A' AND l_quantity = 11 THEN l_extendedprice * l_tax * 9 ELSE l_extendedprice * l_tax END"""
_TAXED = f"(SELECT *, {_TAX} AS tax_amount FROM lineitem)"
_RATED = f"(SELECT *, round_even(tax_amount / l_extendedprice * 100, 2) AS effective_rate FROM {_TAXED} WHERE l_extendedprice > 0 AND tax_amount > 0)"
_FLAGS = f"""SELECT 'missing_tax' AS "check", 'critical' AS severity, count(*) FILTER (tax_amount IS NULL) AS count FROM {_TAXED}
 UNION ALL SELECT 'zero_tax', 'warning', count(*) FILTER (tax_amount = 0 AND l_extendedprice > 0) FROM {_TAXED}
 UNION ALL SELECT 'negative_tax', 'warning', count(*) FILTER (tax_amount < 0) FROM {_TAXED}"""
_MIXED = f"""SELECT l_partkey, count(*) AS rows, count(DISTINCT effective_rate) AS distinct_rates, min(effective_rate) AS min_rate,
 max(effective_rate) AS max_rate FROM {_RATED} GROUP BY 1 HAVING count(DISTINCT effective_rate) > 1"""
_ODD = f"""SELECT l_orderkey, l_partkey, l_quantity, effective_rate FROM {_RATED},
 (SELECT quantile_cont(effective_rate, 0.25) AS q1, quantile_cont(effective_rate, 0.75) AS q3 FROM {_RATED}) q
 WHERE effective_rate < q1 - 1.5 * (q3 - q1) OR effective_rate > q3 + 1.5 * (q3 - q1)"""
_FINDINGS = f"""SELECT "check", NULL::VARCHAR AS subject, severity, count FROM ({_FLAGS}) WHERE count > 0
 UNION ALL SELECT 'inconsistent_rate', l_partkey::VARCHAR, 'critical', rows FROM ({_MIXED})
 UNION ALL SELECT 'rate_outlier', NULL, 'warning', count(*) FROM ({_ODD}) HAVING count(*) > 0"""
_TAX_ARGS = ("l_extendedprice", "tax_amount")


def taxed(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("*", f"{_TAX} AS tax_amount")


@query("tax_audit_flags", _FLAGS)
def _(spark, sf):
    return F.tax_audit_flags(taxed(spark, sf), *_TAX_ARGS)


@query("tax_rate_detail", f"SELECT l_partkey, effective_rate, count(*) AS n FROM {_RATED} GROUP BY 1, 2")
def _(spark, sf):
    return F.tax_rate_detail(taxed(spark, sf), *_TAX_ARGS, "l_partkey")


@query("tax_rate_inconsistency", _MIXED)
def _(spark, sf):
    return F.tax_rate_inconsistency(taxed(spark, sf), *_TAX_ARGS, "l_partkey")


@query("tax_rate_outliers", _ODD)
def _(spark, sf):
    return F.tax_rate_outliers(taxed(spark, sf), *_TAX_ARGS).select("l_orderkey", "l_partkey", "l_quantity", "effective_rate")


@query("tax_findings", _FINDINGS)
def _(spark, sf):
    return F.tax_findings(taxed(spark, sf), *_TAX_ARGS, "l_partkey")


@query("audit_summary", f"""SELECT sum(count)::BIGINT AS total_findings, count(*) FILTER (severity = 'critical') AS critical_count,
 count(*) FILTER (severity = 'warning') AS warning_count FROM ({_FINDINGS})""")
def _(spark, sf):
    return F.audit_summary(taxed(spark, sf), *_TAX_ARGS, "l_partkey")


@query("financial_ratios", f"""SELECT round_even((sum(l_extendedprice) - sum(actual)) / sum(l_extendedprice) * 100, 2) AS gross_margin,
 round_even(sum(actual) / sum(l_extendedprice) * 100, 2) AS cost_ratio, round_even(sum(l_tax) / sum(l_extendedprice) * 100, 2) AS profit_margin,
 round_even(sum(l_tax) / sum(l_quantity) * 100, 2) AS roa, round_even(avg(l_extendedprice), 2) AS avg_revenue,
 round_even(sum(l_extendedprice), 2) AS total_revenue, round_even(stddev_samp(l_extendedprice), 2) AS revenue_std FROM {_LINES}""")
def _(spark, sf):
    return F.financial_ratios(lines(spark, sf), "l_extendedprice", "actual", "l_tax", "l_quantity")


_SPLIT = """SELECT round_even(i, 2) AS total_income, round_even(e, 2) AS total_expenses, round_even(i - e, 2) AS net_amount,
 round_even(i / greatest(i + e, 1) * 100, 1) AS income_pct, round_even(e / greatest(i + e, 1) * 100, 1) AS expense_pct,
 round_even((i - e) / greatest(i, 1) * 100, 1) AS savings_rate FROM """


@query("income_expense", _SPLIT + """(SELECT coalesce(sum(c_acctbal) FILTER (c_acctbal >= 0), 0) AS i,
 abs(coalesce(sum(c_acctbal) FILTER (c_acctbal < 0), 0)) AS e FROM customer)""")
def _(spark, sf):
    return F.income_expense(table(spark, sf, "customer"), "c_acctbal")


_KIND = "CASE event_type WHEN 'purchase' THEN 'Sale of goods' WHEN 'signup' THEN 'Deposit' ELSE event_type END"


@query("income_expense_typed", _SPLIT + f"""(SELECT sum(value) FILTER (regexp_matches(lower(kind), 'income|revenue|credit|deposit|sale|earning')) AS i,
 sum(value) FILTER (NOT regexp_matches(lower(kind), 'income|revenue|credit|deposit|sale|earning')) AS e
 FROM (SELECT value, {_KIND} AS kind FROM events))""")
def _(spark, sf):
    return F.income_expense(table(spark, sf, "events").selectExpr("value", f"{_KIND} AS kind"), "value", "kind")
