"""Cleaning queries over a messy view of the orders.

The view plants markers, nulls, padded texts and repeated rows by the values of the orders; the
same text is run by Spark and by DuckDB.
"""

from tabulith.catalog import query, table
from tabulith.operators import cleaning as C
from tabulith.plans.cleaning import clean_table

_MESSY_COLUMNS = """o_orderkey, o_custkey,
 case when o_orderpriority = '5-LOW' and o_orderstatus = 'F' then 'N/A' when o_orderpriority = '5-LOW' and o_orderstatus = 'O' then ' - '
  when o_orderpriority = '5-LOW' then null else concat('$', cast(cast(o_totalprice as decimal(18,2)) as string)) end as price_text,
 case when o_totalprice < 30000 then '' when o_totalprice < 60000 then 'missing' else concat(' ', o_orderpriority, ' ') end as priority_text,
 case when month(o_orderdate) = 3 then null else o_orderdate end as order_ts,
 case when o_orderpriority = '2-HIGH' and o_orderstatus = 'P' then null else o_totalprice * o_totalprice * o_totalprice end as skewed,
 case when o_orderpriority = '3-MEDIUM' and o_orderstatus = 'F' then null else o_totalprice end as price"""
MESSY_SQL = (f"SELECT {_MESSY_COLUMNS} FROM orders UNION ALL SELECT {_MESSY_COLUMNS} FROM orders "
             "WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")


def messy_orders(spark, sf):
    orders = table(spark, sf, "orders")
    again = orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    return orders.selectExpr(*_split(_MESSY_COLUMNS)).unionAll(again.selectExpr(*_split(_MESSY_COLUMNS)))


def _split(text: str) -> list[str]:
    """The select list at its top-level commas."""
    out, depth, part = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


_MARKERS = ", ".join("'" + m.replace("'", "''") + "'" for m in C.MARKERS)
_STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def stripped(c: str) -> str:
    return _STRIP.format(c=c)


def unmarked(c: str) -> str:
    return f"CASE WHEN {stripped(c)} IN ({_MARKERS}) THEN NULL ELSE {c} END"


_REST = "order_ts, skewed, price"
_MARKED = f"SELECT o_orderkey, o_custkey, {unmarked('price_text')} AS price_text, {unmarked('priority_text')} AS priority_text, {_REST} FROM ({MESSY_SQL})"


@query("null_markers", _MARKED)
def _(spark, sf):
    return C.null_markers(messy_orders(spark, sf))


@query("marker_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({stripped(c)} IN ({_MARKERS})) AS markers FROM ({MESSY_SQL})"
    for c in ("price_text", "priority_text")))
def _(spark, sf):
    return C.marker_counts(messy_orders(spark, sf))


@query("standardize_names", "SELECT n_nationkey AS nation_key, n_name AS a_b, n_regionkey AS a_b_2 FROM nation")
def _(spark, sf):
    return C.standardize_names(table(spark, sf, "nation").toDF(" Nation--Key ", "A b", "(A)_b"))


# a timestamp as text in three spellings, with junk for one kind of event
_TS_TEXT = """CASE WHEN event_type = 'error' AND value < 10 THEN 'not a time' WHEN event_type = 'view' THEN strftime(ts, '%Y/%m/%d %H:%M:%S')
 WHEN event_type = 'click' THEN strftime(ts, '%m/%d/%Y') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END"""


def _event_texts(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", """CASE WHEN event_type = 'error' AND value < 10 THEN 'not a time'
 WHEN event_type = 'view' THEN date_format(ts, 'yyyy/MM/dd HH:mm:ss') WHEN event_type = 'click' THEN date_format(ts, 'MM/dd/yyyy')
 ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END AS ts_text""")


@query("infer_datetime", f"""SELECT event_id, coalesce(try_strptime(t, '%Y-%m-%d %H:%M:%S'), try_strptime(t, '%Y/%m/%d %H:%M:%S'),
 try_strptime(t, '%m/%d/%Y')) AS ts_text FROM (SELECT event_id, {_TS_TEXT} AS t FROM events)""")
def _(spark, sf):
    return C.infer_types(_event_texts(spark, sf))


_NUMBER = "try_cast(regexp_replace({c}, '[$€£¥,]', '', 'g') AS double)"
_TYPED = f"SELECT o_orderkey, o_custkey, {_NUMBER.format(c='price_text')} AS price_text, {stripped('priority_text')} AS priority_text, {_REST} FROM (SELECT DISTINCT * FROM ({_MARKED}))"


@query("infer_numeric", f"SELECT o_orderkey, price_text, priority_text FROM ({_TYPED})")
def _(spark, sf):
    marked = C.drop_duplicate_rows(C.null_markers(messy_orders(spark, sf)))
    return C.infer_types(marked).select("o_orderkey", "price_text", "priority_text")


@query("trim_strings", "SELECT c_custkey, c_name FROM customer")
def _(spark, sf):
    return C.trim_strings(table(spark, sf, "customer").selectExpr("c_custkey", r"concat('\t ', c_name, ' \n') AS c_name"))


_TWICE = "SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'A'"


@query("drop_duplicate_rows", f"SELECT DISTINCT * FROM ({_TWICE})")
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    return C.drop_duplicate_rows(lines.unionAll(lines.where("l_returnflag = 'A'")))


def filled(c: str, source: str) -> str:
    """The column with gaps filled by the rounded median or mean, depending on its skew."""
    return (f"coalesce({c}, (SELECT CASE WHEN abs(skewness({c})) > 1 THEN round_even(quantile_cont({c}, 0.5), 2) "
            f"ELSE round_even(avg({c}), 2) END FROM ({source})))")


@query("impute_numeric", f"SELECT o_orderkey, {filled('skewed', MESSY_SQL)} AS skewed, {filled('price', MESSY_SQL)} AS price FROM ({MESSY_SQL})")
def _(spark, sf):
    return C.impute_numeric(messy_orders(spark, sf).select("o_orderkey", "skewed", "price"))


_CARRIED = """coalesce(last_value(order_ts IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING),
 first_value(order_ts IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query("impute_datetime", f"SELECT o_orderkey, {_CARRIED} AS order_ts FROM (SELECT DISTINCT o_orderkey, order_ts FROM ({MESSY_SQL}))")
def _(spark, sf):
    return C.impute_datetime(messy_orders(spark, sf).select("o_orderkey", "order_ts").distinct(), ["o_orderkey"])


@query("impute_categorical", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END, 'Unknown') AS segment FROM customer")
def _(spark, sf):
    holes = table(spark, sf, "customer").selectExpr("c_custkey", "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS segment")
    return C.impute_categorical(holes)


@query("clean_table", f"""WITH t AS ({_TYPED}) SELECT o_orderkey, o_custkey, {filled('price_text', 'SELECT * FROM t')} AS price_text,
 coalesce(priority_text, 'Unknown') AS priority_text, {_CARRIED} AS order_ts, {filled('skewed', 'SELECT * FROM t')} AS skewed,
 {filled('price', 'SELECT * FROM t')} AS price FROM t""")
def _(spark, sf):
    return clean_table(messy_orders(spark, sf), ["o_orderkey"]).table


_GAPS = ("price_text", "priority_text", "order_ts", "skewed", "price")


_MISSING = " + ".join(f"(count(*) FILTER ({c} IS NULL))" for c in _GAPS)


_COMPLETENESS = f"""WITH t AS ({_TYPED}), m AS (SELECT {_MISSING} AS missing FROM t),
 k AS (SELECT count(*) FILTER ({stripped('price_text')} IN ({_MARKERS})) + count(*) FILTER ({stripped('priority_text')} IN ({_MARKERS})) AS markers,
  count(*) * 7 AS cells FROM ({MESSY_SQL}))
 SELECT round_even((1 - (missing + markers)::DOUBLE / cells) * 100, 1) AS data_completeness,
  round_even((1 - missing::DOUBLE / cells) * 100, 1) AS completeness_simple FROM m, k"""


def _report_sql() -> str:
    rows = [f"SELECT NULL AS \"column\", 'original_rows' AS metric, count(*)::VARCHAR AS value FROM ({MESSY_SQL})",
            "SELECT NULL, 'cleaned_rows', count(*)::VARCHAR FROM t",
            f"SELECT NULL, 'duplicates_removed', ((SELECT count(*) FROM ({MESSY_SQL})) - count(*))::VARCHAR FROM t"]
    rows += [f"SELECT '{c}', 'markers_replaced', (count(*) FILTER ({stripped(c)} IN ({_MARKERS})))::VARCHAR FROM ({MESSY_SQL})"
             for c in ("price_text", "priority_text")]
    rows += [f"SELECT '{c}', 'missing_before', (count(*) FILTER ({c} IS NULL))::VARCHAR FROM t" for c in _GAPS]
    rows += [f"SELECT '{c}', 'missing_rows', string_agg(i::VARCHAR, ', ' ORDER BY i) FILTER (k <= 10) || '...' FROM "
             f"(SELECT i, row_number() OVER (ORDER BY i) AS k FROM (SELECT {c}, row_number() OVER (ORDER BY o_orderkey) AS i FROM t) WHERE {c} IS NULL)"
             for c in _GAPS]
    rows += ["SELECT NULL, 'original_columns', '7'", "SELECT NULL, 'cleaned_columns', '7'", "SELECT 'price_text', 'converted_to', 'numeric'"]
    rows += [f"SELECT '{c}', 'action', 'filled ' || (count(*) - count({c})) || CASE WHEN abs(skewness({c})) > 1 "
             f"THEN ' with median ' || round_even(quantile_cont({c}::DOUBLE, 0.5), 2)::VARCHAR ELSE ' with mean ' || round_even(avg({c}), 2)::VARCHAR END FROM t"
             for c in ("price_text", "skewed", "price")]
    rows += [f"SELECT NULL, 'rows_removed', ((SELECT count(*) FROM ({MESSY_SQL})) - count(*))::VARCHAR FROM t"]
    rows += [f"SELECT NULL, '{name}', {value}::VARCHAR FROM ({_COMPLETENESS})"
             for name, value in (("data_completeness", "data_completeness"), ("completeness_simple", "completeness_simple"))]
    rows += ["SELECT 'order_ts', 'action', 'filled ' || (count(*) - count(order_ts)) || ' forward, then backward' FROM t",
             "SELECT 'priority_text', 'action', 'filled ' || (count(*) - count(priority_text)) || ' with ' || chr(39) || 'Unknown' || chr(39) FROM t"]
    return f"WITH t AS ({_TYPED}) " + " UNION ALL ".join(rows)


@query("data_completeness", _COMPLETENESS)
def _(spark, sf):
    done = clean_table(messy_orders(spark, sf), ["o_orderkey"])
    return spark.createDataFrame([(done.data_completeness, done.completeness_simple)],
                                 "data_completeness double, completeness_simple double")


@query("cleaning_report", _report_sql())
def _(spark, sf):
    return clean_table(messy_orders(spark, sf), ["o_orderkey"]).report
