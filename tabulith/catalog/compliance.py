"""Compliance queries."""

from datetime import datetime

from tabulith.catalog import query, table
from tabulith.catalog.aggregation import rounded
from tabulith.operators import compliance as C

_RATES = """SELECT l_partkey, count(DISTINCT l_tax) AS distinct_rates, round(avg(l_tax), 10) AS average_rate, min(l_tax) AS min_rate,
 max(l_tax) AS max_rate FROM lineitem GROUP BY 1"""


@query("tax_consistency", f"SELECT * FROM ({_RATES}) WHERE distinct_rates > 1")
def _(spark, sf):
    return rounded(C.tax_consistency(table(spark, sf, "lineitem"), "l_partkey", "l_tax"), "average_rate", digits=10)


@query("tax_consistency_rates", f"""SELECT l_partkey, l_tax AS rate, count(*) AS n FROM lineitem
 WHERE l_partkey IN (SELECT l_partkey FROM ({_RATES}) WHERE distinct_rates > 1) GROUP BY 1, 2""")
def _(spark, sf):
    return C.tax_consistency_rates(table(spark, sf, "lineitem"), "l_partkey", "l_tax")


@query("tax_consistency_summary", f"""SELECT count(*) AS items_checked, count(*) FILTER (distinct_rates > 1) AS inconsistent_items,
 round_even(count(*) FILTER (distinct_rates > 1)::DOUBLE / greatest(count(*), 1) * 100, 1) AS pct_inconsistent FROM ({_RATES})""")
def _(spark, sf):
    return C.tax_consistency_summary(table(spark, sf, "lineitem"), "l_partkey", "l_tax")


_TAX_ID = """CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN NULL WHEN c_mktsegment = 'MACHINERY' AND c_acctbal < 500 THEN '   '
 ELSE concat('TX', cast(c_custkey AS varchar(20))) END"""
_WITH_ID = f"(SELECT c_custkey, c_mktsegment, {_TAX_ID} AS tax_id FROM customer)"


def _customers(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey", "c_mktsegment", f"{_TAX_ID} AS tax_id")


@query("missing_tax_id", f"SELECT * FROM {_WITH_ID} WHERE tax_id IS NULL OR trim(tax_id) = ''")
def _(spark, sf):
    return C.missing_tax_id(_customers(spark, sf))


@query("missing_tax_id_summary", f"""SELECT count(*) AS total_records, count(*) FILTER (tax_id IS NULL OR trim(tax_id) = '') AS missing,
 round_even(count(*) FILTER (tax_id IS NULL OR trim(tax_id) = '')::DOUBLE / count(*) * 100, 1) AS missing_pct FROM {_WITH_ID}""")
def _(spark, sf):
    return C.missing_tax_id_summary(_customers(spark, sf))


_AS_OF = datetime(2000, 1, 1)


@query("future_dated", "SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01'")
def _(spark, sf):
    return C.future_dated(table(spark, sf, "orders"), "o_orderdate", _AS_OF)


@query("aged_records", "SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 730 DAYS")
def _(spark, sf):
    return C.aged_records(table(spark, sf, "orders"), "o_orderdate", _AS_OF)


_TWINS = "SELECT * FROM events WHERE value IN (SELECT value FROM events GROUP BY 1 HAVING count(*) > 1)"


@query("duplicate_amounts", _TWINS)
def _(spark, sf):
    return C.duplicate_amounts(table(spark, sf, "events"), "value")


@query("duplicate_amounts_orders", "SELECT * FROM orders WHERE o_totalprice IN (SELECT o_totalprice FROM orders "
                                   "GROUP BY 1 HAVING count(*) > 1)")
def _(spark, sf):
    return C.duplicate_amounts(table(spark, sf, "orders"), "o_totalprice")


# invoice numbers are moved up by 10 after every 50, which plants the gaps
_BILLS = """(SELECT o_orderkey + 10 * (o_orderkey // 50) AS invoice_no, o_orderdate AS invoice_date, o_totalprice AS amount FROM orders)"""


@query("compliance_summary", f"""WITH b AS (SELECT * FROM {_BILLS}),
 g AS (SELECT invoice_no - lag(invoice_no) OVER (ORDER BY invoice_no) AS gap FROM b),
 n AS (SELECT count(*) FILTER (invoice_date > TIMESTAMP '2000-01-01') AS future_dated,
   count(*) FILTER (invoice_date < TIMESTAMP '2000-01-01' - INTERVAL 730 DAYS) AS aged,
   (SELECT count(*) FROM g WHERE gap > 3 * (SELECT quantile_cont(gap, 0.5) FROM g)) AS sequence_gaps, 0::BIGINT AS missing_tax_ids,
   (SELECT count(*) FROM b WHERE amount IN (SELECT amount FROM b GROUP BY 1 HAVING count(*) > 1)) AS duplicate_amount_rows FROM b)
 SELECT 4::INT AS total_checks, (future_dated + aged + sequence_gaps > 0)::INT AS checks_with_issues, future_dated + aged + sequence_gaps AS total_issues,
  CASE WHEN future_dated + aged + sequence_gaps = 0 THEN 'Clean' WHEN future_dated + aged + sequence_gaps < 5 THEN 'Minor Issues'
   ELSE 'Needs Review' END AS overall_status, * FROM n""")
def _(spark, sf):
    bills = table(spark, sf, "orders").selectExpr(
        "o_orderkey + 10 * (o_orderkey div 50) AS invoice_no", "o_orderdate AS invoice_date", "o_totalprice AS amount")
    return C.compliance_summary(bills, _AS_OF)
