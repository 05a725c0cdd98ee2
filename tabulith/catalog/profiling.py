"""Profile and quality queries."""

from pyspark.sql import functions as F

from tabulith.catalog import query, table
from tabulith.catalog.aggregation import each, modes
from tabulith.catalog.cleaning import MESSY_SQL, messy_orders
from tabulith.operators import profiling as P
from tabulith.session import scratch_path

_LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax")
_LINE_COLUMNS = (*_LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate")
_MESSY_COLUMNS = ("o_orderkey", "o_custkey", "price_text", "priority_text", "order_ts", "skewed", "price")


def profile_sql(columns, source: str, numeric: int, text: int, time: int) -> str:
    gaps = " + ".join(f"(count(*) - count({c}))" for c in columns)
    return f"""WITH s AS (SELECT * FROM ({source})), g AS (SELECT count(*) AS rows, {gaps} AS missing FROM s),
 d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM s))
 SELECT rows, {len(columns)}::INT AS columns, rows * {len(columns)} AS total_cells, missing AS total_missing,
  round_even(missing::DOUBLE / greatest(rows * {len(columns)}, 1) * 100, 1) AS missing_pct, rows - n AS total_duplicates,
  round_even((rows - n)::DOUBLE / greatest(rows, 1) * 100, 1) AS duplicate_pct, {numeric}::INT AS numeric_columns,
  {text}::INT AS categorical_columns, {time}::INT AS datetime_columns, 0::INT AS boolean_columns FROM g, d"""


@query("profile_dataset", profile_sql(_LINE_COLUMNS, "SELECT * FROM lineitem", 8, 2, 1))
def _(spark, sf):
    return P.profile_dataset(table(spark, sf, "lineitem"))


@query("profile_dataset_messy", profile_sql(_MESSY_COLUMNS, MESSY_SQL, 4, 2, 1))
def _(spark, sf):
    return P.profile_dataset(messy_orders(spark, sf))


_PRESENCE = """'{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing,
 round_even((count(*) - count({c}))::DOUBLE / count(*) * 100, 1) AS missing_pct, count(DISTINCT {c}) AS unique,
 round_even(count(DISTINCT {c})::DOUBLE / greatest(count(*), 1) * 100, 1) AS unique_pct"""
_NUMERIC = "SELECT " + _PRESENCE + """, round_even(avg({c}), 2) AS mean, round_even(stddev_samp({c}), 2) AS std,
 round_even(min({c})::DOUBLE, 2) AS min, round_even(quantile_cont({c}, 0.25)::DOUBLE, 2) AS q25,
 round_even(quantile_cont({c}, 0.5)::DOUBLE, 2) AS median, round_even(quantile_cont({c}, 0.75)::DOUBLE, 2) AS q75,
 round_even(max({c})::DOUBLE, 2) AS max, round_even(skewness({c}), 2) AS skewness, round_even(kurtosis({c}), 2) AS kurtosis,
 count(*) FILTER ({c} = 0) AS zeros, round_even((count(*) FILTER ({c} = 0))::DOUBLE / count({c}) * 100, 1) AS zeros_pct,
 count(*) FILTER ({c} < 0) AS negative FROM """


@query("profile_numeric", each(_LINE_NUMBERS, _NUMERIC + "lineitem"))
def _(spark, sf):
    return P.profile_numeric(table(spark, sf, "lineitem"))


@query("profile_numeric_messy", each(("o_orderkey", "o_custkey", "skewed", "price"), _NUMERIC + f"(SELECT * REPLACE (price * 0.377 AS price) FROM ({MESSY_SQL}))"))
def _(spark, sf):
    messy = messy_orders(spark, sf)
    return P.profile_numeric(messy.withColumn("price", messy["price"] * 0.377))


_TIMES = "SELECT " + _PRESENCE + """, min({c}) AS min_date, max({c}) AS max_date,
 floor((epoch(max({c})) - epoch(min({c}))) / 86400)::BIGINT AS date_range_days FROM """


@query("profile_datetime", _TIMES.format(c="ts") + "events")
def _(spark, sf):
    return P.profile_datetime(table(spark, sf, "events"))


@query("profile_datetime_orders", _TIMES.format(c="o_orderdate") + "orders")
def _(spark, sf):
    return P.profile_datetime(table(spark, sf, "orders"))


def texts_sql(columns, source: str) -> str:
    presence = each(columns, "SELECT " + _PRESENCE + f", round_even(avg(length({{c}})), 1) AS avg_length FROM ({source}) x")
    return modes(f"({source})", columns) + f""", p AS ({presence})
 SELECT p.*, most_common, most_common_count, round_even(most_common_count::DOUBLE / m.count * 100, 1) AS most_common_pct,
  least_common FROM p LEFT JOIN m USING ("column")"""


@query("profile_categorical", texts_sql(("p_name", "p_brand", "p_type"), "SELECT * FROM part"))
def _(spark, sf):
    return P.profile_categorical(table(spark, sf, "part"))


@query("missing_matrix", "SELECT m_key, " + ", ".join(f"{c} IS NULL AS {c}" for c in _MESSY_COLUMNS)
       + f" FROM (SELECT *, o_orderkey AS m_key FROM ({MESSY_SQL}))")
def _(spark, sf):
    return P.missing_matrix(messy_orders(spark, sf).selectExpr("*", "o_orderkey AS m_key"), ["m_key"])


@query("constant_columns", "SELECT 'one' AS \"column\", '1' AS value UNION ALL SELECT 'nothing', 'N/A'")
def _(spark, sf):
    return P.constant_columns(table(spark, sf, "nation").selectExpr("*", "1 AS one", "cast(null as string) AS nothing"))


@query("high_cardinality", """SELECT 'c_name' AS "column", count(DISTINCT c_name) AS unique_count,
 round_even(count(DISTINCT c_name)::DOUBLE / count(*) * 100, 1) AS unique_pct FROM customer HAVING count(DISTINCT c_name) > 0.9 * count(*)
 UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), round_even(count(DISTINCT c_mktsegment)::DOUBLE / count(*) * 100, 1)
 FROM customer HAVING count(DISTINCT c_mktsegment) > 0.9 * count(*)""")
def _(spark, sf):
    return P.high_cardinality(table(spark, sf, "customer"))


_FLAT = "SELECT *, 1 AS one, l_tax * 0 AS nought FROM lineitem"


@query("zero_variance", each((*_LINE_NUMBERS, "one", "nought"), "SELECT '{c}' AS \"column\" FROM "
                             f"({_FLAT}) HAVING coalesce(stddev_samp({{c}}), 0) = 0 OR count(DISTINCT {{c}}) <= 1"))
def _(spark, sf):
    return P.zero_variance(table(spark, sf, "lineitem").selectExpr("*", "1 AS one", "l_tax * 0 AS nought"))


_MARKS = f"SELECT " + ", ".join(f"({c} IS NULL)::INT AS {c}" for c in ("price_text", "priority_text", "skewed", "price", "twin")) \
         + f" FROM (SELECT *, CASE WHEN price IS NULL THEN NULL ELSE 1 END AS twin FROM ({MESSY_SQL}))"
_NAMES = ("price_text", "priority_text", "skewed", "price", "twin")


@query("missing_correlation", f"WITH m AS ({_MARKS}), p AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col1, '{b}' AS col2, round(corr({a}, {b}), 6) AS r FROM m"
    for i, a in enumerate(_NAMES) for b in _NAMES[i + 1:]) + ") SELECT * FROM p WHERE abs(r) > 0.5 AND NOT isnan(r)")
def _(spark, sf):
    from tabulith.catalog.aggregation import rounded
    messy = messy_orders(spark, sf).selectExpr("*", "CASE WHEN price IS NULL THEN NULL ELSE 1 END AS twin")
    return rounded(P.missing_correlation(messy.select(*_NAMES)), "r", digits=6)


@query("expectations", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    orders = P.expectations(table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus"], ["o_totalprice"], 5)
    return orders.groupBy("o_orderstatus").agg({"*": "count"}).withColumnRenamed("count(1)", "n")


_RULES = {"a price": "o_totalprice > 0", "a key": "o_orderkey IS NOT NULL", "no large order": "o_totalprice < 300000",
          "a known state": "o_orderstatus IN ('F', 'O')"}


@query("expectation_report", """SELECT * FROM (VALUES ('rows', 'orders', true, NULL), ('column', 'o_orderkey', true, NULL),
 ('column', 'o_orderstatus', true, NULL), ('numeric', 'o_totalprice', true, NULL),
 ('numeric', 'o_orderstatus', false, 'orders: not numeric: [''o_orderstatus'']')) v("check", subject, passed, message)
 UNION ALL SELECT 'min_rows', '1000000000', n >= 1000000000, 'orders: ' || n || ' row(s), at least 1000000000 needed'
 FROM (SELECT count(*) AS n FROM orders)""" + "".join(f"""
 UNION ALL SELECT 'rule', '{name}', b = 0, CASE WHEN b > 0 THEN 'orders: ' || b || ' of ' || n || ' row(s) break ''{name}''' END
 FROM (SELECT count(*) AS n, count(*) FILTER (NOT coalesce({rule}, false)) AS b FROM orders)""" for name, rule in _RULES.items()))
def _(spark, sf):
    gate = P.Gate(["o_orderkey", "o_orderstatus"], ["o_totalprice", "o_orderstatus"], 10 ** 9,
                  {name: F.expr(rule) for name, rule in _RULES.items()}, "orders")
    return P.gated_write(table(spark, sf, "orders"), scratch_path(spark, "gated"), gate)
