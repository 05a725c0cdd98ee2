"""Chart data queries."""

from tabulith.catalog import query, table
from tabulith.catalog.aggregation import CORRELATION_SQL, rounded
from tabulith.catalog.cleaning import MESSY_SQL, messy_orders
from tabulith.catalog.selection import bins_sql
from tabulith.catalog.windows import pareto_sql
from tabulith.operators import charts as C
from tabulith.operators.aggregation import correlation_matrix


@query("histogram", f"""WITH b AS ({bins_sql('lineitem', 'l_extendedprice', 30, 'l_orderkey')}),
 e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
 SELECT i::INT AS bin, round(lo + (i - 1) * (hi - lo) / 30, 4) AS lo, round(lo + i * (hi - lo) / 30, 4) AS hi,
  (SELECT count(*) FROM b WHERE bin = i) AS count FROM range(1, 31) r(i), e""")
def _(spark, sf):
    return rounded(C.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30), "lo", "hi")


_FENCES = """WITH q AS (SELECT l_returnflag, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
  FROM x GROUP BY 1), f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS a, q3 + 1.5 * (q3 - q1) AS b FROM q)"""
# squared prices, and planted outliers on both sides in the first orders
_V = ("CASE WHEN l_orderkey < 60 THEN -l_extendedprice * 1000 WHEN l_orderkey < 120 THEN l_extendedprice * 1000 "
      "ELSE l_extendedprice * l_extendedprice / 1000 END")
_HEAVY = f"(SELECT *, {_V} AS v FROM lineitem)"


@query("box_stats", _FENCES.replace(" x ", f" {_HEAVY} x ") + f""" SELECT l_returnflag, round(q1, 4) AS q1, round(median, 4) AS median,
 round(q3, 4) AS q3, count(v) AS n, round(min(v) FILTER (v BETWEEN a AND b), 4) AS whisker_low, round(max(v) FILTER (v BETWEEN a AND b), 4) AS whisker_high,
 count(*) FILTER (v < a OR v > b) AS outliers FROM {_HEAVY} x JOIN f USING (l_returnflag) GROUP BY l_returnflag, q1, median, q3""")
def _(spark, sf):
    return rounded(C.box_stats(_heavy(spark, sf), "v", "l_returnflag"), "q1", "median", "q3", "whisker_low", "whisker_high")


@query("box_outliers", _FENCES.replace(" x ", f" {_HEAVY} x ") + f""" SELECT l_returnflag, l_orderkey, round(v, 4) AS v
 FROM {_HEAVY} x JOIN f USING (l_returnflag) WHERE v < a OR v > b""")
def _(spark, sf):
    out = C.box_outliers(_heavy(spark, sf), "v", "l_returnflag")
    return rounded(out.select("l_returnflag", "l_orderkey", "v"), "v")


def _heavy(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_returnflag", "l_orderkey", f"{_V} AS v")


@query("category_share", """SELECT o_orderpriority, round(sum(o_totalprice), 4) AS total,
 round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders) * 100, 6) AS share_pct FROM orders GROUP BY 1""")
def _(spark, sf):
    out = C.category_share(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return rounded(rounded(out, "total"), "share_pct", digits=6)


_RADAR = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("radar_profile", "WITH m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg({c}) AS mean FROM lineitem" for c in _RADAR)
       + ') SELECT "column", round(mean, 4) AS mean, round(mean / (SELECT max(abs(mean)) FROM m) * 100, 6) AS scaled FROM m')
def _(spark, sf):
    return rounded(rounded(C.radar_profile(table(spark, sf, "lineitem")), "mean"), "scaled", digits=6)


@query("waterfall", """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS step, sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END) AS value
  FROM orders GROUP BY 1), c AS (SELECT step, value, sum(value) OVER (ORDER BY step) AS "end" FROM m)
 SELECT step, 'relative' AS measure, round(value, 3) AS value, round("end" - value, 3) AS start, round("end", 3) AS "end" FROM c
 UNION ALL SELECT 'total', 'total', round(sum(value), 3), 0.0, round(sum(value), 3) FROM m""")
def _(spark, sf):
    steps = table(spark, sf, "orders").selectExpr(
        "date_format(o_orderdate, 'yyyy-MM') AS step", "CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS value")
    return rounded(C.waterfall(steps, "step", "value"), "value", "start", "end", digits=3)


@query("funnel", """WITH s AS (SELECT event_type, sum(value) AS value FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1)
 SELECT event_type, round(value, 4) AS value, round(value / (SELECT value FROM s WHERE event_type = 'view') * 100, 6) AS share_of_first_pct FROM s""")
def _(spark, sf):
    out = C.funnel(table(spark, sf, "events"), "event_type", "value", ["view", "click", "purchase"])
    return rounded(rounded(out, "value"), "share_of_first_pct", digits=6)


@query("hierarchy_rollup", """SELECT l_returnflag, l_linestatus, 2::INT - grouping(l_returnflag, l_linestatus)::INT AS level, round(sum(l_extendedprice), 4) AS total
 FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))""")
def _(spark, sf):
    return rounded(C.hierarchy_rollup(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"), "total")


@query("scatter_sample", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
 WHERE ('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)), 1, 7))::BIGINT
  < floor(least(1, 2000::DOUBLE / (SELECT count(*) FROM lineitem)) * 268435456)""")
def _(spark, sf):
    return C.scatter_sample(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
                            ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"], points=2000)


@query("composition_over_time", """WITH c AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, o_orderstatus, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
 SELECT period, o_orderstatus, round(total, 4) AS total, round(total / sum(total) OVER (PARTITION BY period) * 100, 6) AS share_pct FROM c""")
def _(spark, sf):
    out = C.composition_over_time(table(spark, sf, "orders"), "o_orderdate", "o_orderstatus", "o_totalprice")
    return rounded(rounded(out, "total"), "share_pct", digits=6)


_HEAT = ("price_text", "priority_text", "order_ts", "skewed", "price")


@query("missing_heatmap", f"""WITH m AS (SELECT DISTINCT * FROM ({MESSY_SQL})), s AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal,
  count(*) OVER () AS n FROM m), p AS (SELECT * FROM s WHERE ordinal % greatest(1, n // 100) = 0) """
       + " UNION ALL ".join(f"SELECT ordinal, '{c}' AS \"column\", ({c} IS NULL)::INT AS missing FROM p" for c in _HEAT))
def _(spark, sf):
    messy = messy_orders(spark, sf).distinct().select("o_orderkey", *_HEAT)
    return C.missing_heatmap(messy, ["o_orderkey"])


@query("regression_line", """SELECT round(lo + i * (hi - lo) / 99, 4) AS x, round(s * (lo + i * (hi - lo) / 99) + b, 4) AS y FROM range(0, 100) r(i),
 (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, round_even(regr_slope(l_extendedprice, l_quantity), 4) AS s,
  round_even(regr_intercept(l_extendedprice, l_quantity), 4) AS b FROM lineitem)""")
def _(spark, sf):
    return rounded(C.regression_line(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), "x", "y")


@query("pareto_curve", pareto_sql("lineitem", "l_suppkey", "l_extendedprice")
       + " SELECT l_suppkey, position, round(value, 4) AS value, round(pct, 6) AS cumulative_pct FROM c")
def _(spark, sf):
    out = C.pareto_curve(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice")
    return rounded(rounded(out, "value"), "cumulative_pct", digits=6)


@query("anomaly_overlay", """SELECT ts, value, abs((value - m) / d) > 2 AS is_anomaly FROM events,
 (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events)""")
def _(spark, sf):
    return C.anomaly_overlay(table(spark, sf, "events"), "ts", "value")


@query("time_series_line", """SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low,
 max(o_totalprice) AS high, count(*) AS n FROM orders GROUP BY 1""")
def _(spark, sf):
    return rounded(C.time_series_line(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month"), "mean")


@query("time_series_rows", "SELECT o_orderdate, o_totalprice FROM orders")
def _(spark, sf):
    return C.time_series_line(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")


@query("correlation_heatmap", CORRELATION_SQL)
def _(spark, sf):
    return correlation_matrix(table(spark, sf, "lineitem"))
