"""Insight queries over orders with planted extremes, a dominant category and gaps that go together."""

from tabulith.catalog import query, table
from tabulith.operators.insights import insight_summary, insights
from tabulith.catalog.anomalies import forest_report, forest_sql, lof_sql
from tabulith.plans.overview import anomaly_flow, flagged_summary

_VIEW = """o_orderkey, o_custkey, o_orderkey * 3 + o_custkey * 0.5 AS score,
 CASE WHEN o_custkey < 20 THEN o_totalprice * 100 ELSE o_totalprice END AS amount,
 CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE 1.5 END AS flat,
 CASE WHEN o_custkey < 20 THEN 'huge' WHEN o_orderstatus = 'F' THEN 'plain' ELSE 'usual' END AS kind, o_orderpriority, o_orderstatus, 'one' AS constant"""
_NUMBERS = ("o_orderkey", "o_custkey", "score", "amount", "price", "flat")
_TEXTS = ("kind", "o_orderpriority", "o_orderstatus", "constant")


def view(spark, sf):
    from pyspark.sql import functions as F
    out = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_orderkey * 3 + o_custkey * 0.5D AS score",
        "CASE WHEN o_custkey < 20 THEN o_totalprice * 100 ELSE o_totalprice END AS amount",
        "CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_totalprice END AS price",
        "CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE 1.5D END AS flat",
        "CASE WHEN o_custkey < 20 THEN 'huge' WHEN o_orderstatus = 'F' THEN 'plain' ELSE 'usual' END AS kind",
        "o_orderpriority", "o_orderstatus")
    return out.withColumn("constant", F.lit("one"))


def _column_rules(c: str) -> str:
    return f"""SELECT * FROM (WITH s AS (SELECT {c}::DOUBLE AS v, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS n FROM v WHERE {c} IS NOT NULL),
  a AS (SELECT count(*) AS n, avg(v) AS m, stddev_samp(v) AS d, skewness(v) AS sk, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3,
   avg(v) FILTER (i <= greatest(1, n // 5)) AS h, avg(v) FILTER (i > n - greatest(1, n // 5)) AS t FROM s),
  b AS (SELECT *, CASE WHEN abs(m) > 1e-10 THEN d / abs(m) * 100 ELSE 0 END AS cv, (t - h) / abs(h) * 100 AS ch,
   (SELECT count(*) FROM s WHERE v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1)) AS far FROM a)
  SELECT 'Variability' AS category, '{c}' AS subject, 'warning' AS severity, cv AS value FROM b WHERE cv > 80
  UNION ALL SELECT 'Stability', '{c}', 'positive', cv FROM b WHERE cv < 15 AND n > 10
  UNION ALL SELECT 'Distribution', '{c}', 'info', sk FROM b WHERE abs(sk) > 1.5 AND NOT isnan(sk)
  UNION ALL SELECT 'Trend', '{c}', CASE WHEN ch > 0 THEN 'positive' ELSE 'warning' END, ch FROM b WHERE abs(ch) > 15 AND n >= 10
  UNION ALL SELECT 'Extreme Values', '{c}', 'warning', far FROM b WHERE far > 0)"""


def _text_rules(c: str) -> str:
    return f"""SELECT * FROM (WITH f AS (SELECT {c} AS v, count(*) AS n FROM v WHERE {c} IS NOT NULL GROUP BY 1),
  m AS (SELECT count(*) AS u, max(n) * 100.0::DOUBLE / (SELECT count(*) FROM v) AS top, min(n) * 100.0::DOUBLE / (SELECT count(*) FROM v) AS low FROM f)
  SELECT 'Low Variance' AS category, '{c}' AS subject, 'info' AS severity, u::DOUBLE AS value FROM m WHERE u <= 1
  UNION ALL SELECT 'Dominance', '{c}', 'info', top FROM m WHERE u BETWEEN 2 AND 20 AND top > 50
  UNION ALL SELECT 'Imbalance', '{c}', 'warning', top FROM m WHERE u BETWEEN 3 AND 20 AND top > 10 * low)"""


def _group_rules(g: str, c: str) -> str:
    return f"""SELECT * FROM (WITH f AS (SELECT {g} AS k, sum({c}) AS s, avg({c}) AS m FROM v WHERE {g} IS NOT NULL GROUP BY 1),
  r AS (SELECT sum(s) OVER (ORDER BY s DESC, k) / sum(s) OVER () AS share FROM f),
  p AS (SELECT (SELECT count(*) FROM r WHERE share < 0.8) + 1 AS needed, (SELECT count(*) FROM f) AS u,
   ((SELECT max(m) FROM f) - (SELECT avg({c}) FROM v)) / abs((SELECT avg({c}) FROM v)) * 100 AS off)
  SELECT 'Pareto Pattern' AS category, '{g} & {c}' AS subject, 'info' AS severity, needed::DOUBLE AS value FROM p WHERE u BETWEEN 3 AND 20 AND needed <= 0.4 * u
  UNION ALL SELECT 'Group Analysis', '{g} & {c}', CASE WHEN off > 0 THEN 'positive' ELSE 'warning' END, off FROM p WHERE u BETWEEN 2 AND 10 AND abs(off) > 30)"""


def _insight_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1:]]
    rules = [*map(_column_rules, _NUMBERS), *map(_text_rules, _TEXTS),
             *[_group_rules(g, c) for g in _TEXTS for c in _NUMBERS],
             "SELECT 'Correlation', subject, 'info', r FROM (SELECT *, row_number() OVER (ORDER BY i) AS k FROM ("
             + " UNION ALL ".join(f"SELECT {i} AS i, '{a} & {b}' AS subject, corr({a}, {b}) AS r FROM v" for i, (a, b) in enumerate(pairs))
             + ") WHERE abs(r) > 0.8 AND NOT isnan(r))",
             "SELECT 'Sample Size', 'rows', 'warning', count(*) FROM v HAVING count(*) < 30",
             "SELECT 'Dataset', 'rows', 'positive', count(*) FROM v HAVING count(*) > 10000"]
    return (f"WITH v AS (SELECT {_VIEW} FROM orders), f AS (" + " UNION ALL ".join(rules) + """),
 g AS (SELECT * FROM f UNION ALL SELECT 'Recommendation', 'warnings', 'info', count(*) FROM f WHERE severity = 'warning' HAVING count(*) > 3
  UNION ALL SELECT 'Missing Data Pattern', 'price & flat', 'info', 1 FROM v WHERE price IS NULL AND flat IS NULL GROUP BY ALL HAVING count(*) > 0)""")


_G = _insight_sql()


@query("insights", _G + " SELECT category, subject, severity, round(value::DOUBLE, 4) AS value FROM g")
def _(spark, sf):
    from pyspark.sql import functions as F
    return insights(view(spark, sf), ["o_orderkey"]).select("category", "subject", "severity", F.round("value", 4).alias("value"))


@query("insight_summary", _G + """, k AS (SELECT avg(o_orderkey) FILTER (i <= greatest(1, n // 10)) AS h, avg(o_orderkey) FILTER (i > n - greatest(1, n // 10)) AS t
  FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS n FROM v)),
 c AS (SELECT count(*) FILTER (severity = 'positive') AS positive, count(*) FILTER (severity = 'warning') AS warnings, count(*) AS total_insights FROM g),
 x AS (SELECT round_even((t - h) / greatest(abs(h), 1e-10) * 100, 2) AS growth_pct FROM k)
 SELECT (SELECT count(*) FROM v) AS rows, 10::INT AS columns, 'o_orderkey' AS primary_metric, (SELECT sum(o_orderkey)::DOUBLE FROM v) AS total,
  (SELECT round_even(avg(o_orderkey), 2) FROM v) AS average, (SELECT round_even(quantile_cont(o_orderkey, 0.5), 2) FROM v) AS median, growth_pct,
  CASE WHEN growth_pct > 5 THEN 'growth' WHEN growth_pct < -5 THEN 'decline' ELSE 'steady' END AS growth_flag, 4::INT AS categorical_columns,
  positive, warnings, CASE WHEN positive > warnings THEN 'healthy' WHEN warnings > positive THEN 'attention' ELSE 'balanced' END AS balance, total_insights
 FROM c, x""")
def _(spark, sf):
    orders = view(spark, sf)
    return insight_summary(orders, ["o_orderkey"], insights(orders, ["o_orderkey"]))


_ZROWS = """SELECT '{c}' AS "column", 'Z-Score' AS method, count(*) FILTER (abs(({c} - m) / d) > 2) AS count, round_even(any_value(m - 2 * d), 2) AS threshold_lower,
 round_even(any_value(m + 2 * d), 2) AS threshold_upper FROM events, (SELECT avg({c}) AS m, stddev_samp({c}) AS d FROM events)"""


@query("detect_run", "SELECT * FROM (" + " UNION ALL ".join(_ZROWS.format(c=c) for c in ("event_id", "user_id", "value")) + ") WHERE count > 0")
def _(spark, sf):
    return anomaly_flow(table(spark, sf, "events"), "zscore", 2.0).columns


@query("detect_run_forest", forest_sql("customer"))
def _(spark, sf):
    return forest_report(spark, sf, "customer", lambda df: anomaly_flow(df, "isolation_forest", 2.0).rows, 0.3)


@query("ml_anomaly_summary", f"""SELECT 'Local Outlier Factor' AS method, 3::INT AS columns_used, count(*) FILTER (is_anomaly) AS count,
 'Local Outlier Factor: ' || count(*) FILTER (is_anomaly) || ' unusual row(s) over 3 column(s)' AS summary
 FROM ({lof_sql("supplier", "s_suppkey", ("s_suppkey", "s_nationkey", "s_acctbal"), 20, 0.3)})""")
def _(spark, sf):
    run = anomaly_flow(table(spark, sf, "supplier"), "lof", 2.0)
    return flagged_summary(run.rows, "Local Outlier Factor", ["s_suppkey", "s_nationkey", "s_acctbal"])
