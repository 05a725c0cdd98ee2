"""Grouping and description queries."""

from pyspark.sql import functions as F

from tabulith.catalog import query, table
from tabulith.operators import aggregation as A

_LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax")
_ORDER_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")


def each(columns, template: str) -> str:
    """One SELECT per column, united."""
    return " UNION ALL ".join(template.format(c=c) for c in columns)


def pairs(columns):
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]


_DESCRIBE = """SELECT '{c}' AS "column", count({c}) AS count, round_even(avg({c}), 2) AS mean,
 round_even(stddev_samp({c}), 2) AS std, round_even(min({c})::DOUBLE, 2) AS min,
 round_even(quantile_cont({c}, 0.25)::DOUBLE, 2) AS q25, round_even(quantile_cont({c}, 0.5)::DOUBLE, 2) AS median,
 round_even(quantile_cont({c}, 0.75)::DOUBLE, 2) AS q75, round_even(max({c})::DOUBLE, 2) AS max FROM """


@query("describe_numeric", each(_LINE_NUMBERS, _DESCRIBE + "lineitem"))
def _(spark, sf):
    return A.describe_numeric(table(spark, sf, "lineitem"))


def modes(tab: str, columns) -> str:
    """value counts of the columns and their modes, as CTEs f and m."""
    counts = each(columns, f"SELECT '{{c}}' AS col, {{c}} AS v, count(*) AS n FROM {tab} "
                           "WHERE {c} IS NOT NULL GROUP BY 2")
    return f"""WITH f AS ({counts}),
 r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS hi,
   row_number() OVER (PARTITION BY col ORDER BY n, v DESC) AS lo FROM f),
 m AS (SELECT col AS "column", sum(n)::BIGINT AS count, count(*) AS unique_values,
   max(CASE WHEN hi = 1 THEN v END) AS most_common, max(n) AS most_common_count,
   max(CASE WHEN lo = 1 THEN v END) AS least_common, min(n) AS least_common_count FROM r GROUP BY col)"""


_MODE_COLS = '"column", count, unique_values, most_common, most_common_count, least_common'


@query("describe_categorical", modes("orders", ("o_orderstatus", "o_orderpriority"))
       + f" SELECT {_MODE_COLS} FROM m")
def _(spark, sf):
    return A.describe_categorical(table(spark, sf, "orders"))


@query("describe_categorical_part", modes("part", ("p_name", "p_brand", "p_type")) + f" SELECT {_MODE_COLS} FROM m")
def _(spark, sf):
    return A.describe_categorical(table(spark, sf, "part"))


@query("shape_info", "SELECT count(*) AS rows, 6 AS columns, 3 AS numeric_columns, 2 AS categorical_columns, "
                     "1 AS datetime_columns FROM orders")
def _(spark, sf):
    return A.shape_info(table(spark, sf, "orders"))


_FUNCS = {"sum": "sum({v})", "mean": "avg({v})", "count": "count({v})", "min": "min({v})", "max": "max({v})",
          "median": "quantile_cont({v}, 0.5)", "std": "stddev_samp({v})"}


def _group_query(func: str):
    sql = _FUNCS[func].format(v="l_extendedprice")
    shown = sql if func == "count" else f"round({sql}, 4)"

    @query(f"group_agg_{func}", f"SELECT l_returnflag, {shown} AS l_extendedprice_{func} FROM lineitem "
                                "WHERE l_returnflag IS NOT NULL GROUP BY 1")
    def _(spark, sf):
        out = A.group_agg(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", func)
        return out if func == "count" else rounded(out, f"l_extendedprice_{func}")


def rounded(df, *columns, digits: int = 4):
    """Round doubles on both sides of a comparison, to hide the order of summation."""
    from pyspark.sql import functions as F
    return df.withColumns({c: F.round(c, digits) for c in columns})


for _func in _FUNCS:
    _group_query(_func)


@query("group_agg_orders", "SELECT o_custkey, round(sum(o_totalprice), 4) AS o_totalprice_sum FROM orders GROUP BY 1")
def _(spark, sf):
    return rounded(A.group_agg(table(spark, sf, "orders"), "o_custkey", "o_totalprice"), "o_totalprice_sum")


@query("auto_group", "WITH s AS (" + " UNION ALL ".join(
    f"SELECT '{g}' AS group_col, {g} AS group_value, '{v}' AS value_col, round(sum({v})::DOUBLE, 4) AS total "
    f"FROM orders WHERE {g} IS NOT NULL GROUP BY 2"
    for g in ("o_orderstatus", "o_orderpriority") for v in _ORDER_NUMBERS) + """),
 k AS (SELECT group_col, count(DISTINCT group_value) AS n FROM s GROUP BY 1)
 SELECT s.* FROM s JOIN k USING (group_col) WHERE n BETWEEN 2 AND 20""")
def _(spark, sf):
    return rounded(A.auto_group(table(spark, sf, "orders")), "total")


_COMPARE = """SELECT {g}, count({v}) AS count, round_even(avg({v}), 2) AS mean,
 round_even(quantile_cont({v}, 0.5), 2) AS median, round_even(stddev_samp({v}), 2) AS std,
 round_even(min({v}), 2) AS min, round_even(max({v}), 2) AS max, round_even(sum({v}), 2) AS total
 FROM {t} WHERE {g} IS NOT NULL GROUP BY 1"""


@query("compare_groups", _COMPARE.format(g="l_returnflag", v="l_extendedprice", t="lineitem"))
def _(spark, sf):
    return A.compare_groups(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")


@query("compare_two_values", f"""SELECT 'c_mktsegment' AS group_col, lower(c_mktsegment) AS group_value, d.*
 FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')) s,
 LATERAL ({_DESCRIBE.format(c='c_acctbal')} customer x WHERE x.c_mktsegment = s.c_mktsegment) d""")
def _(spark, sf):
    return A.compare_two_values(table(spark, sf, "customer"), "c_acctbal", "Building", "machinery")


@query("multi_agg", "SELECT l_returnflag, " + ", ".join(
    (f"count({v}) AS {v}_count" if f == "count" else f"round_even({_FUNCS[f].format(v=v)}, 2) AS {v}_{f}")
    for v in ("l_quantity", "l_extendedprice", "l_tax") for f in ("sum", "mean", "count", "min", "max", "std", "median"))
    + " FROM lineitem GROUP BY 1")
def _(spark, sf):
    return A.multi_agg(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_tax"],
                       ["sum", "mean", "count", "min", "max", "std", "median"])


@query("pivot_table", """SELECT l_returnflag,
 coalesce(round_even(avg(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END), 2), 0) AS "F",
 coalesce(round_even(avg(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END), 2), 0) AS "O"
 FROM lineitem GROUP BY 1""")
def _(spark, sf):
    return A.pivot_table(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", "mean", "l_linestatus")


@query("pivot_table_plain", "SELECT o_orderpriority, round_even(sum(o_totalprice), 2) AS o_totalprice "
                            "FROM orders GROUP BY 1")
def _(spark, sf):
    return A.pivot_table(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "sum")


def _scalar_query(func: str, sql: str):
    @query(f"scalar_agg_{func}", f"SELECT round(({sql})::DOUBLE, 4) AS value FROM lineitem")
    def _(spark, sf):
        return rounded(A.scalar_agg(table(spark, sf, "lineitem"), "l_extendedprice", func), "value")


for _func, _sql in (("average", "avg(l_extendedprice)"), ("total", "sum(l_extendedprice)"),
                    ("min", "min(l_extendedprice)"), ("max", "max(l_extendedprice)"),
                    ("median", "quantile_cont(l_extendedprice, 0.5)"), ("count", "count(l_extendedprice)")):
    _scalar_query(_func, _sql)

_KPI = """SELECT '{c}' AS "column", count(v) AS count, round_even(sum(v), 2) AS total,
 round_even(avg(v), 2) AS average, round_even(quantile_cont(v, 0.5), 2) AS median, round_even(min(v), 2) AS min,
 round_even(max(v), 2) AS max, round_even(stddev_samp(v), 2) AS std,
 round_even((avg(CASE WHEN i > n - greatest(1, n // 10) THEN v END) - avg(CASE WHEN i <= greatest(1, n // 10) THEN v END))
  / greatest(abs(avg(CASE WHEN i <= greatest(1, n // 10) THEN v END)), 1e-10) * 100, 2) AS growth_pct
 FROM (SELECT {c}::DOUBLE AS v, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS n
  FROM orders WHERE {c} IS NOT NULL) x"""


@query("kpis", each(_ORDER_NUMBERS, _KPI))
def _(spark, sf):
    return A.kpis(table(spark, sf, "orders"), ["o_orderkey"])


@query("value_counts", "SELECT p_brand, count(*) AS count FROM part WHERE p_brand IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return A.value_counts(table(spark, sf, "part"), "p_brand")


_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS col1, '{b}' AS col2, corr({a}, {b}) AS r FROM lineitem"
                            for a, b in pairs(_LINE_NUMBERS))
CORRELATION_SQL = f"""WITH p AS ({_PAIRS}), q AS (SELECT * FROM p UNION ALL SELECT col2, col1, r FROM p
 UNION ALL SELECT col1, col1, 1.0 FROM (SELECT DISTINCT col1 FROM p UNION SELECT DISTINCT col2 FROM p))
 SELECT col1, col2, round_even(r, 3) + 0.0 AS correlation FROM q"""


@query("correlation_matrix", CORRELATION_SQL)
def _(spark, sf):
    return A.correlation_matrix(table(spark, sf, "lineitem"))


# columns that go with others: strongly, against them, and in part
_RELATED = {"worth": "l_extendedprice * 2 + l_quantity", "mirror": "0.0D - l_partkey",
            "partly": "CASE WHEN l_linenumber > 2 THEN l_suppkey ELSE 0 END"}
_RELATED_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS col1, '{b}' AS col2, corr({a}, {b}) AS r FROM v" for a, b in pairs((*_LINE_NUMBERS, *_RELATED)))


@query("correlation_pairs", f"""WITH v AS (SELECT *, {', '.join(f"{x.replace('0.0D', '0.0::DOUBLE')} AS {c}" for c, x in _RELATED.items())} FROM lineitem),
 p AS ({_RELATED_PAIRS}) SELECT col1, col2, round_even(r, 3) AS correlation,
 CASE WHEN abs(r) > 0.8 THEN 'Strong' ELSE 'Moderate' END AS strength,
 CASE WHEN r > 0 THEN 'Positive' ELSE 'Negative' END AS direction FROM p WHERE abs(r) >= 0.5""")
def _(spark, sf):
    return A.correlation_pairs(table(spark, sf, "lineitem").withColumns({c: F.expr(x) for c, x in _RELATED.items()}))


@query("correlates_with", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(corr(l_extendedprice, {c}), 6) AS correlation FROM lineitem"
    for c in _LINE_NUMBERS if c != "l_extendedprice"))
def _(spark, sf):
    return rounded(A.correlates_with(table(spark, sf, "lineitem"), "l_extendedprice"), "correlation", digits=6)


_CALENDAR = """WITH c AS (SELECT 'month' AS period, month(o_orderdate)::INT AS number, monthname(o_orderdate) AS label,
  o_totalprice AS v FROM orders
 UNION ALL SELECT 'weekday', isodow(o_orderdate)::INT, dayname(o_orderdate), o_totalprice FROM orders
 UNION ALL SELECT 'quarter', quarter(o_orderdate)::INT, 'Q' || quarter(o_orderdate), o_totalprice FROM orders),
 s AS (SELECT period, number, label, round_even(avg(v), 2) AS mean FROM c GROUP BY ALL)"""


@query("seasonality", _CALENDAR + " SELECT * FROM s")
def _(spark, sf):
    return A.seasonality(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")


@query("seasonality_peaks", _CALENDAR + """ SELECT arg_min(label, [-mean, number]) AS peak_month,
 arg_min(label, [mean, number]) AS low_month, max(mean) AS peak_value, min(mean) AS low_value,
 round_even(max(mean) - min(mean), 2) AS seasonal_range FROM s WHERE period = 'month'""")
def _(spark, sf):
    return A.seasonality_peaks(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")


_P = " UNION ALL ".join(f"SELECT 'P{p}' AS percentile, round_even(quantile_cont(l_extendedprice, {p / 100}), 2) AS value "
                        "FROM lineitem" for p in A.PERCENTILES)


@query("percentile_table", f"WITH p AS ({_P}) SELECT * FROM p UNION ALL SELECT 'IQR', round_even("
       "max(CASE WHEN percentile = 'P75' THEN value END) - max(CASE WHEN percentile = 'P25' THEN value END), 2) FROM p")
def _(spark, sf):
    return A.percentile_table(table(spark, sf, "lineitem"), "l_extendedprice")


@query("distinct_rates", "SELECT l_partkey, l_tax, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    return A.distinct_rates(table(spark, sf, "lineitem"), "l_partkey", "l_tax")
