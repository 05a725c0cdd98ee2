"""Order-dependent queries."""

from tabulith.catalog import query, table
from tabulith.catalog.aggregation import rounded
from tabulith.operators import windows as X

_EVENT = ["ts", "event_id"]


@query("moving_average", """SELECT user_id, ts, event_id, value, CASE WHEN i >= 7 THEN round_even(m, 2) END AS "SMA_7" FROM
 (SELECT *, row_number() OVER w AS i, avg(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m,
  count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 WHERE n >= 7""")
def _(spark, sf):
    return X.moving_average(table(spark, sf, "events"), _EVENT, "value", 7, ["user_id"])


@query("moving_average_global", """SELECT ts, event_id, value, CASE WHEN row_number() OVER w >= 21 THEN
 round_even(avg(value) OVER (w ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), 2) END AS "SMA_21" FROM events
 WINDOW w AS (ORDER BY ts, event_id)""")
def _(spark, sf):
    return X.moving_average(table(spark, sf, "events"), _EVENT, "value", 21)


@query("ema", """WITH RECURSIVE s AS (SELECT user_id, ts, event_id, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 r AS (SELECT *, value AS y FROM s WHERE i = 1 UNION ALL
  SELECT s.*, (2.0::DOUBLE / 7) * s.value + (5.0::DOUBLE / 7) * r.y FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)
 SELECT user_id, ts, event_id, value, round_even(y, 2) AS "EMA_6" FROM r""")
def _(spark, sf):
    return X.ema(table(spark, sf, "events"), _EVENT, "value", 6, ["user_id"])


# the recursion unrolled: weights below 1e-16 are left out
@query("ema_global", """WITH s AS (SELECT event_id, ts, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events),
 y AS (SELECT a.i, sum(CASE WHEN b.i = 0 THEN 1 ELSE 2.0::DOUBLE / 7 END * pow(5.0::DOUBLE / 7, a.i - b.i) * b.value) AS y
  FROM s a JOIN range(0, 120) r(j) ON j <= a.i JOIN s b ON b.i = a.i - j GROUP BY 1)
 SELECT ts, event_id, value, round_even(y, 2) AS "EMA_6" FROM s JOIN y USING (i)""")
def _(spark, sf):
    return X.ema(table(spark, sf, "events"), _EVENT, "value", 6)


@query("trend", """WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i,
  count(*) OVER () AS n FROM orders),
 a AS (SELECT regr_slope(v, i) AS slope, avg(CASE WHEN i < n // 2 THEN v END) AS f, avg(CASE WHEN i >= n // 2 THEN v END) AS l,
  count(*) AS data_points, min(v) AS lo, max(v) AS hi FROM s)
 SELECT CASE WHEN slope > 0 THEN 'Upward' WHEN slope < 0 THEN 'Downward' ELSE 'Flat' END AS direction,
  round_even(slope, 4) AS slope, round_even(f, 2) AS first_half_avg, round_even(l, 2) AS second_half_avg,
  round_even((l - f) / greatest(abs(f), 1e-10) * 100, 2) AS change_pct, data_points,
  round_even(lo, 2) AS min_value, round_even(hi, 2) AS max_value FROM a""")
def _(spark, sf):
    return X.trend(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], "o_totalprice")


_RANK = """SELECT {keep}, round((round_even((rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0)
 / count({v}) OVER (PARTITION BY {k}), 3) * 100)::DOUBLE, 4) AS {v}_percentile FROM {t}"""


@query("percentile_rank", _RANK.format(keep="p_partkey, p_brand", k="p_brand", v="p_retailprice", t="part"))
def _(spark, sf):
    out = X.percentile_rank(table(spark, sf, "part"), "p_retailprice", "p_brand")
    return rounded(out.select("p_partkey", "p_brand", "p_retailprice_percentile"), "p_retailprice_percentile")


@query("percentile_rank_global", _RANK.format(keep="l_orderkey, l_quantity", k="1", v="l_quantity", t="lineitem"))
def _(spark, sf):
    out = X.percentile_rank(table(spark, sf, "lineitem"), "l_quantity")
    return rounded(out.select("l_orderkey", "l_quantity", "l_quantity_percentile"), "l_quantity_percentile")


def pareto_sql(tab: str, group: str, value: str) -> str:
    return f"""WITH g AS (SELECT {group}, sum({value}) AS value FROM {tab} GROUP BY 1),
 c AS (SELECT {group}, value, row_number() OVER w AS position, sum(value) OVER w / sum(value) OVER () * 100 AS pct
  FROM g WINDOW w AS (ORDER BY value DESC, {group}))"""


_PARETO = pareto_sql("lineitem", "l_suppkey", "l_extendedprice")


@query("pareto", _PARETO + " SELECT l_suppkey, position, round(value, 4) AS value, round_even(pct, 1) AS cumulative_pct FROM c")
def _(spark, sf):
    return rounded(X.pareto(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice"), "value")


@query("pareto_summary", _PARETO + """ SELECT round_even(sum(value), 2) AS total,
 min(CASE WHEN round_even(pct, 1) >= 80 THEN position END) AS categories_for_80_pct, count(*) AS total_categories,
 round_even(min(CASE WHEN round_even(pct, 1) >= 80 THEN position END)::DOUBLE / count(*) * 100, 1) AS concentration_ratio FROM c""")
def _(spark, sf):
    return X.pareto_summary(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice")


_GAPS = """WITH s AS (SELECT v::DOUBLE AS value, lag(v) OVER (ORDER BY v)::DOUBLE AS previous FROM (SELECT {key} AS v FROM {tab})),
 g AS (SELECT *, value - previous AS gap FROM s WHERE previous IS NOT NULL)
 SELECT previous, value, gap FROM g WHERE gap > 3 * (SELECT quantile_cont(gap, 0.5) FROM g)"""


# all keys, moved up by 10 after every 50, which plants the gaps
@query("sequence_gaps", _GAPS.format(tab="orders", key="o_orderkey + 10 * (o_orderkey // 50)"))
def _(spark, sf):
    orders = table(spark, sf, "orders").selectExpr("o_orderkey + 10 * (o_orderkey div 50) AS o_orderkey")
    return X.sequence_gaps(orders, "o_orderkey")


@query("sequence_gaps_repeated", _GAPS.format(tab="lineitem", key="(l_orderkey * 16 + l_linenumber) // 2"))
def _(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr("(l_orderkey * 16 + l_linenumber) div 2 AS number")
    return X.sequence_gaps(lines, "number")


HEAD_TAIL = """SELECT '{c}' AS "column", n, round(h, 4) AS head_mean, round(t, 4) AS tail_mean, round((t - h) / abs(h) * 100, 4) AS change_pct
 FROM (SELECT count(*) AS n, avg(CASE WHEN i <= greatest(1, m // 5) THEN v END) AS h,
  avg(CASE WHEN i > m - greatest(1, m // 5) THEN v END) AS t
  FROM (SELECT {c}::DOUBLE AS v, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS m FROM orders) q) r"""


@query("head_tail_change", " UNION ALL ".join(HEAD_TAIL.format(c=c) for c in ("o_custkey", "o_totalprice")))
def _(spark, sf):
    out = X.head_tail_change(table(spark, sf, "orders"), ["o_orderkey"], ["o_custkey", "o_totalprice"])
    return rounded(out, "head_mean", "tail_mean", "change_pct")


@query("cumulative_share", """WITH g AS (SELECT p_type, sum(p_retailprice) AS total FROM part GROUP BY 1),
 s AS (SELECT p_type, round_even(total / sum(total) OVER () * 100, 1) AS share, total FROM g)
 SELECT p_type, share, round_even(sum(share) OVER (ORDER BY total DESC, p_type), 1) AS cumulative_share,
  row_number() OVER (ORDER BY total DESC, p_type) - 1 AS position FROM s""")
def _(spark, sf):
    from pyspark.sql import functions as F
    part = table(spark, sf, "part")
    whole = part.agg(F.sum("p_retailprice")).first()[0]
    shares = part.groupBy("p_type").agg(F.sum("p_retailprice").alias("total")).withColumn(
        "share", F.bround(F.col("total") / whole * 100, 1))
    return X.cumulative_share(shares, "p_type", "share", "total").drop("total")
