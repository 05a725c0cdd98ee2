"""Outlier queries."""

from pyspark.sql import functions as F

from tabulith.catalog import query, table
from tabulith.catalog.aggregation import each, rounded
from tabulith.operators import anomalies as A
from tabulith.operators.forest import isolation_forest
from tabulith.operators.neighbours import lof

_LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax")
_ORDER_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")


@query("zscore_outliers", """SELECT l_orderkey, l_partkey, l_extendedprice, round(abs((l_extendedprice - m) / d), 6) AS zscore FROM lineitem,
 (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d FROM lineitem) WHERE abs((l_extendedprice - m) / d) > 1.7""")
def _(spark, sf):
    out = A.zscore_outliers(table(spark, sf, "lineitem"), "l_extendedprice", 1.7)
    return rounded(out.select("l_orderkey", "l_partkey", "l_extendedprice", "zscore"), "zscore", digits=6)


@query("zscore_outliers_by_group", """SELECT event_id, event_type, value, round(abs((value - m) / d), 6) AS zscore FROM events JOIN
 (SELECT event_type, avg(value) AS m, stddev_samp(value) AS d FROM events GROUP BY 1) USING (event_type) WHERE abs((value - m) / d) > 2""")
def _(spark, sf):
    out = A.zscore_outliers_by_group(table(spark, sf, "events"), "value", "event_type")
    return rounded(out.select("event_id", "event_type", "value", "zscore"), "zscore", digits=6)


_IQR = "(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})"


@query("iqr_outliers", "SELECT e.* FROM events e, " + _IQR.format(c="value", t="events")
       + " WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)")
def _(spark, sf):
    return A.iqr_outliers(table(spark, sf, "events"), "value")


_Z_SUMMARY = """SELECT '{c}' AS "column", 'Z-Score' AS method, count(*) FILTER (abs(({c} - m) / d) > 1.7) AS count,
 round_even(any_value(m - 1.7 * d), 2) AS threshold_lower, round_even(any_value(m + 1.7 * d), 2) AS threshold_upper
 FROM {t}, (SELECT avg({c}) AS m, stddev_samp({c}) AS d FROM {t})"""
_I_SUMMARY = """SELECT '{c}' AS "column", 'IQR' AS method, count(*) FILTER ({c} < q1 - 2 * (q3 - q1) OR {c} > q3 + 2 * (q3 - q1)) AS count,
 round_even(any_value(q1 - 2 * (q3 - q1)), 2) AS threshold_lower, round_even(any_value(q3 + 2 * (q3 - q1)), 2) AS threshold_upper
 FROM {t}, (SELECT quantile_cont({c}, 0.25)::DOUBLE AS q1, quantile_cont({c}, 0.75)::DOUBLE AS q3 FROM {t})"""


@query("outliers_all_columns", "SELECT * FROM (" + each(_LINE_NUMBERS, _Z_SUMMARY.replace("{t}", "lineitem")) + ") WHERE count > 0")
def _(spark, sf):
    return A.outliers_all_columns(table(spark, sf, "lineitem"), "zscore", 1.7)


@query("outliers_all_columns_iqr", "SELECT * FROM (" + each(("event_id", "user_id", "value"), _I_SUMMARY.replace("{t}", "events")) + ") WHERE count > 0")
def _(spark, sf):
    return A.outliers_all_columns(table(spark, sf, "events"), "iqr", 2.0)


@query("anomaly_summary", "WITH s AS (SELECT * FROM (" + each(_ORDER_NUMBERS, _Z_SUMMARY.replace("{t}", "orders")) + """) WHERE count > 0)
 SELECT "column" AS scope, count, 1::BIGINT AS columns FROM s UNION ALL SELECT 'TOTAL', sum(count)::BIGINT, count(*) FROM s""")
def _(spark, sf):
    return A.anomaly_summary(table(spark, sf, "orders"), "zscore", 1.7).drop("summary")


@query("flag_anomalies", """SELECT event_id, abs((value - m) / d) > 2 AS value_anomaly FROM events,
 (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events)""")
def _(spark, sf):
    events = table(spark, sf, "events")
    return A.flag_anomalies(events, A.column_bounds(events, "zscore", 2.0, ["value"])).select("event_id", "value_anomaly")


#: columns that are planted with extreme values, and one in which a gap is planted
FOREST_COLUMNS = {"lineitem": ("l_quantity", "l_extendedprice", "l_tax"), "customer": ("c_custkey", "c_acctbal", "c_acctbal")}


def forest_report(spark, sf, name, search, contamination):
    """A forest's random trees have no SQL twin, but its promises have: with ten extreme rows and ten rows with a gap added
    to the whole table, all extreme rows are flagged, no row with a gap has a score, and the flagged share is right."""
    first, second, gap = FOREST_COLUMNS[name]
    rows = table(spark, sf, name).withColumn("_planted", F.lit("no"))
    some = spark.createDataFrame(rows.orderBy(*rows.columns).limit(10).collect(), rows.schema)
    far = some.withColumns({first: F.col(first) * 0 + 10 ** 7, second: F.col(second) * 0 + 10.0 ** 9, "_planted": F.lit("far")})
    gaps = some.withColumns({gap: F.lit(None).cast("double"), "_planted": F.lit("gap")})
    found = search(rows.unionByName(far).unionByName(gaps))
    share = F.count_if("is_anomaly") / F.count("anomaly_score")
    return found.agg(F.count("*").alias("n_rows"), F.count("anomaly_score").alias("scored"),
                     F.count_if(F.col("is_anomaly") & (F.col("_planted") == "far")).alias("planted_flagged"),
                     F.count_if(F.col("is_anomaly") & (F.col("_planted") == "gap")).alias("gaps_flagged"),
                     (F.abs(share - contamination) < 0.02).alias("share_is_right"))


def forest_sql(name):
    return f"""SELECT count(*) + 20 AS n_rows, count(*) + 10 AS scored, 10::BIGINT AS planted_flagged, 0::BIGINT AS gaps_flagged,
 true AS share_is_right FROM {name}"""


@query("isolation_forest", forest_sql("lineitem"))
def _(spark, sf):
    return forest_report(spark, sf, "lineitem", isolation_forest, 0.05)


def lof_sql(tab: str, key: str, columns, k: int, contamination: float) -> str:
    z = ", ".join(f"(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ())::DOUBLE AS z{i}" for i, c in enumerate(columns))
    d = " + ".join(f"pow(a.z{i} - b.z{i}, 2)" for i in range(len(columns)))
    return f"""WITH p AS (SELECT {key} AS k, {z} FROM {tab}),
 d AS (SELECT a.k, b.k AS o, sqrt({d}) AS d FROM p a JOIN p b ON a.k <> b.k),
 n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, o) AS i FROM d) WHERE i <= {k}),
 r AS (SELECT k AS o, max(d) AS kd FROM n GROUP BY 1), l AS (SELECT k, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM n JOIN r USING (o) GROUP BY 1),
 f AS (SELECT n.k, -avg(x.lrd) / any_value(y.lrd) AS s FROM n JOIN l x ON x.k = n.o JOIN l y ON y.k = n.k GROUP BY 1)
 SELECT k AS {key}, round(s, 6) AS lof_score, s < (SELECT quantile_cont(s, {contamination}) FROM f) AS is_anomaly FROM f
 WHERE (SELECT count(*) FROM {tab}) > {k}"""


@query("lof", lof_sql("supplier", "s_suppkey", ("s_suppkey", "s_nationkey", "s_acctbal"), 20, 0.05))
def _(spark, sf):
    out = lof(table(spark, sf, "supplier"))
    return rounded(out.select("s_suppkey", "lof_score", "is_anomaly"), "lof_score", digits=6)


@query("lof_customers", lof_sql("customer", "c_custkey", ("c_custkey", "c_nationkey", "c_acctbal"), 20, 0.1))
def _(spark, sf):
    out = lof(table(spark, sf, "customer"), contamination=0.1, leaf_rows=250)
    return rounded(out.select("c_custkey", "lof_score", "is_anomaly"), "lof_score", digits=6)


# many leaves, and more columns
_PART_NUMBERS = ("p_partkey", "p_size", "p_retailprice", "worth", "cycle")
_PARTS = "(SELECT *, p_size * p_retailprice AS worth, p_partkey % 97 AS cycle FROM part)"


@query("lof_parts", lof_sql(_PARTS, "p_partkey", _PART_NUMBERS, 10, 0.05))
def _(spark, sf):
    parts = table(spark, sf, "part").selectExpr("*", "p_size * p_retailprice AS worth", "p_partkey % 97 AS cycle")
    out = lof(parts, list(_PART_NUMBERS), n_neighbors=10, leaf_rows=60)
    return rounded(out.select("p_partkey", "lof_score", "is_anomaly"), "lof_score", digits=6)
