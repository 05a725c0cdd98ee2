"""Reading, previews and report sections."""

from tabulith.catalog import query, table
from tabulith.catalog.aggregation import each, rounded
from tabulith.session import scratch_path
from tabulith.sources import files, report

_LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax")


@query("scan_parquet", "SELECT * FROM supplier")
def _(spark, sf):
    return files.scan(spark, f"{sf}/supplier.parquet").table


@query("scan_csv", "SELECT * REPLACE (l_linenumber::BIGINT AS l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate) FROM lineitem")
def _(spark, sf):
    path = scratch_path(spark, "lineitem") + ".csv"
    lines = table(spark, sf, "lineitem")
    lines.withColumn("l_shipdate", lines["l_shipdate"].cast("date")).write.option("header", True).csv(path)
    return files.scan(spark, path).table


@query("table_preview", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS kind, count(*) AS rows, count(*) - count({c}) AS null_count FROM orders"
    for c, k in (("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "categorical"), ("o_totalprice", "numeric"),
                 ("o_orderdate", "datetime"), ("o_orderpriority", "categorical"))) + ")")
def _(spark, sf):
    return files.table_preview(table(spark, sf, "orders"))


@query("preview_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def _(spark, sf):
    return files.preview_rows(table(spark, sf, "orders"), ["o_orderkey"], 5)


def hits_sql(columns, source: str, t: float, body: str) -> str:
    return " UNION ALL ".join(body.format(c=c, t=t, s=source) for c in columns)


_ZHITS = """SELECT x.*, '{c}' AS _anomaly_column, 'Z-Score' AS _method FROM {s} x,
 (SELECT avg({c}) AS m, stddev_samp({c}) AS d FROM {s}) z WHERE abs(({c} - m) / d) > {t}"""


@query("anomalies_combined", hits_sql(("o_orderkey", "o_custkey", "o_totalprice"), "orders", 1.7, _ZHITS))
def _(spark, sf):
    from tabulith.operators.anomalies import anomalies_combined
    return anomalies_combined(table(spark, sf, "orders"), "zscore", 1.7)


# the prices and quantities of the first orders are planted as extremes: no value of the table itself is that far out
_PLANTED = {"l_extendedprice": "CASE WHEN l_orderkey < 40 THEN l_extendedprice * 30 ELSE l_extendedprice END",
            "l_quantity": "CASE WHEN l_orderkey < 20 THEN l_quantity * 50 ELSE l_quantity END"}
_PLANTED_LINES = f"(SELECT * REPLACE ({', '.join(f'{x} AS {c}' for c, x in _PLANTED.items())}) FROM lineitem)"


@query("anomalies_combined_lines", hits_sql(_LINE_NUMBERS, _PLANTED_LINES, 1.9, _ZHITS))
def _(spark, sf):
    from pyspark.sql import functions as F
    from tabulith.operators.anomalies import anomalies_combined
    lines = table(spark, sf, "lineitem").withColumns({c: F.expr(x) for c, x in _PLANTED.items()})
    return anomalies_combined(lines, "zscore", 1.9)


@query("report_sink", hits_sql(("o_orderkey", "o_custkey", "o_totalprice"), "orders", 1.7, _ZHITS))
def _(spark, sf):
    orders = table(spark, sf, "orders")
    written = report.report_sink(report.report_sections(orders, ["o_orderkey"], threshold=1.7),
                                 scratch_path(spark, "report"))
    return spark.read.parquet(written["anomalies"])


_ORDER_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")


@query("report_sections", f"""SELECT * FROM (SELECT 'cleaned_data' AS section, count(*) AS n_rows, 6::INT AS n_columns FROM orders
 UNION ALL SELECT 'column_totals', 6, 9 UNION ALL SELECT 'dashboard', 3, NULL UNION ALL SELECT 'statistics', 3, NULL
 UNION ALL SELECT 'anomalies', count(*), 8 FROM ({hits_sql(_ORDER_NUMBERS, "orders", 1.7, _ZHITS)})
 UNION ALL SELECT 'data_profile', 6, NULL)""")
def _(spark, sf):
    from pyspark.sql import functions as F
    orders = table(spark, sf, "orders")
    written = report.report_sink(report.report_sections(orders, ["o_orderkey"], threshold=1.7), scratch_path(spark, "report"))
    counted = {"cleaned_data", "column_totals", "anomalies"}
    out = None
    for name, path in written.items():
        rows = spark.read.parquet(path)
        row = rows.agg(F.lit(name).alias("section"), F.count("*").alias("n_rows"),
                       F.lit(len(rows.columns) if name in counted else None).cast("int").alias("n_columns"))
        out = row if out is None else out.unionByName(row)
    return out


_TOTALS = """SELECT '{c}' AS "column", round(sum({c})::DOUBLE, 4) AS sum, round(avg({c}), 4) AS average, count({c})::DOUBLE AS count,
 min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(stddev_samp({c}), 4) AS stdev, NULL::DOUBLE AS counta, NULL::DOUBLE AS countblank FROM lineitem"""
_FILLED = """SELECT '{c}', NULL, NULL, NULL, NULL, NULL, NULL, count({c})::DOUBLE,
 (count(*) FILTER ({c} IS NULL OR trim({c}::VARCHAR) = ''))::DOUBLE FROM lineitem"""


@query("column_totals", each(_LINE_NUMBERS, _TOTALS) + " UNION ALL " + each(("l_returnflag", "l_linestatus", "l_shipdate"), _FILLED))
def _(spark, sf):
    return rounded(files.column_totals(table(spark, sf, "lineitem")), "sum", "average", "stdev")


@query("report_totals", each(_ORDER_NUMBERS, _TOTALS.replace("lineitem", "orders"))
       + " UNION ALL " + each(("o_orderstatus", "o_orderpriority", "o_orderdate"), _FILLED.replace("lineitem", "orders")))
def _(spark, sf):
    sections = {"column_totals": report.report_sections(table(spark, sf, "orders"), ["o_orderkey"])["column_totals"]}
    written = report.report_sink(sections, scratch_path(spark, "totals"))
    return rounded(spark.read.parquet(written["column_totals"]), "sum", "average", "stdev")
