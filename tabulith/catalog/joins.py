"""Join queries over whole tables; some keys on both sides are rewritten, so that rows without a partner exist."""

from tabulith.catalog import query, table
from tabulith.operators import joins as J

# the same text in both engines
ORDER_KEY = "CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 100000000 ELSE o_custkey END"
CUSTOMER_KEY = "CASE WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey END"
PART_KEY = "CASE WHEN p_size <= 10 THEN -p_partkey ELSE p_partkey END"
LINE_KEY = "CASE WHEN l_quantity > 45 THEN l_partkey + 10000000 ELSE l_partkey END"
_SOME = f"(SELECT * REPLACE ({CUSTOMER_KEY} AS c_custkey) FROM customer)"
_SOME_ORDERS = f"(SELECT * REPLACE ({ORDER_KEY} AS o_custkey) FROM orders)"


def rekeyed(spark, sf, name, column, key):
    """The whole table with ``column`` rewritten."""
    from pyspark.sql import functions as F
    return table(spark, sf, name).withColumn(column, F.expr(key))


def _some_customers(spark, sf):
    return rekeyed(spark, sf, "customer", "c_custkey", CUSTOMER_KEY)


def _some_orders(spark, sf):
    return rekeyed(spark, sf, "orders", "o_custkey", ORDER_KEY)


_SQL_TYPES = {"left": "LEFT", "right": "RIGHT", "inner": "INNER", "outer": "FULL"}


def _join_query(how: str):
    @query(f"smart_join_{how}", f"SELECT * FROM {_SOME_ORDERS} o {_SQL_TYPES[how]} JOIN {_SOME} c ON o_custkey = c_custkey")
    def _(spark, sf):
        return J.smart_join(_some_orders(spark, sf), _some_customers(spark, sf), "o_custkey", "c_custkey", how)


for _how in _SQL_TYPES:
    _join_query(_how)


_GAP_ORDERS = f"(SELECT * REPLACE (CASE WHEN o_orderkey % 500 = 0 THEN NULL ELSE {ORDER_KEY} END AS o_custkey) FROM orders)"
_GAP_CUSTOMERS = f"(SELECT * REPLACE (CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE {CUSTOMER_KEY} END AS c_custkey) FROM customer)"


def _null_match_query(how: str):
    @query(f"smart_join_null_keys_{how}",
           f"SELECT * FROM {_GAP_ORDERS} o {_SQL_TYPES[how]} JOIN {_GAP_CUSTOMERS} c ON o_custkey IS NOT DISTINCT FROM c_custkey")
    def _(spark, sf):
        orders = rekeyed(spark, sf, "orders", "o_custkey", f"CASE WHEN o_orderkey % 500 = 0 THEN NULL ELSE {ORDER_KEY} END")
        customers = rekeyed(spark, sf, "customer", "c_custkey", f"CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE {CUSTOMER_KEY} END")
        return J.smart_join(orders, customers, "o_custkey", "c_custkey", how, null_match=True)


for _how in ("left", "outer"):
    _null_match_query(_how)


@query("smart_join_text", """SELECT l.n_nationkey, l.n_name, l.n_regionkey, r.n_nationkey AS n_nationkey_joined, r.n_name AS n_name_joined,
 r.n_regionkey AS n_regionkey_joined FROM nation l LEFT JOIN nation r ON lower(l.n_name) = lower(r.n_name)""")
def _(spark, sf):
    nation = table(spark, sf, "nation")
    padded = nation.selectExpr("n_nationkey", "concat('  ', lower(n_name), ' ') AS n_name", "n_regionkey")
    out = J.smart_join(nation, padded, "n_name", "n_name", "left")
    return out.withColumn("n_name_joined", _plain(out["n_name_joined"]))


def _plain(c):
    from pyspark.sql import functions as F
    return F.upper(F.trim(c))


_STATS = """WITH l AS (SELECT count(*) AS left_rows FROM {a}), r AS (SELECT count(*) AS right_rows FROM {b}),
 j AS (SELECT count(*) AS merged_rows, count(*) FILTER ({k1} IS NOT NULL AND {k2} IS NOT NULL) AS left_matched,
  count(*) FILTER ({k2} IS NULL) AS left_unmatched, count(*) FILTER ({k1} IS NULL) AS right_unmatched
  FROM {a} x {how} JOIN {b} y ON {k1} = {k2})
 SELECT '{name}' AS join_type, left_rows, right_rows, merged_rows, left_matched, left_unmatched, right_rows - right_unmatched AS right_matched,
  right_unmatched, round_even(left_matched::DOUBLE / greatest(left_rows, 1) * 100, 1) AS match_rate_left,
  round_even((right_rows - right_unmatched)::DOUBLE / greatest(right_rows, 1) * 100, 1) AS match_rate_right, {new}::INT AS new_columns FROM l, r, j"""


def _stats_query(how: str):
    @query(f"join_stats_{how}", _STATS.format(a=_SOME_ORDERS, b=_SOME, k1="o_custkey", k2="c_custkey", how=_SQL_TYPES[how],
                                              name=how, new=5))
    def _(spark, sf):
        return J.join_stats(_some_orders(spark, sf), _some_customers(spark, sf), "o_custkey", "c_custkey", how)


for _how in _SQL_TYPES:
    _stats_query(_how)


def quality_sql(a: str, b: str, k1: str, k2: str) -> str:
    return f"""WITH q AS (SELECT (SELECT count(*) FROM {a}) AS l, (SELECT count(*) FROM {b}) AS r,
  (SELECT count(*) FROM {a} x JOIN {b} y ON {k1} = {k2}) AS p, (SELECT count(*) FROM {a} x WHERE {k1} IN (SELECT {k2} FROM {b})) AS lm,
  (SELECT count(*) FROM {b} y WHERE {k2} IN (SELECT {k1} FROM {a})) AS rm),
 s AS (SELECT round_even(p::DOUBLE / greatest(l, 1) * 100, 1) AS quality_score, round_even(lm::DOUBLE / greatest(l, 1) * 100, 1) AS distinct_match_rate_left,
  round_even(rm::DOUBLE / greatest(r, 1) * 100, 1) AS distinct_match_rate_right FROM q)
 SELECT *, CASE WHEN quality_score > 90 THEN 'Excellent Match' WHEN quality_score > 70 THEN 'Good Match'
  WHEN quality_score > 50 THEN 'Partial Match' ELSE 'Poor Match' END AS quality_label FROM s"""


@query("join_quality", quality_sql(_SOME_ORDERS, _SOME, "o_custkey", "c_custkey"))
def _(spark, sf):
    return J.join_quality(_some_orders(spark, sf), _some_customers(spark, sf), "o_custkey", "c_custkey")


@query("join_quality_one_to_many", quality_sql(_SOME, _SOME_ORDERS, "c_custkey", "o_custkey"))
def _(spark, sf):
    return J.join_quality(_some_customers(spark, sf), _some_orders(spark, sf), "c_custkey", "o_custkey")


@query("join_preview", f"""WITH a AS (SELECT DISTINCT {PART_KEY} AS k FROM part), b AS (SELECT DISTINCT {LINE_KEY} AS k FROM lineitem),
 s AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'matched' WHEN a.k IS NOT NULL THEN 'left_only'
   ELSE 'right_only' END AS status FROM a FULL JOIN b ON a.k = b.k),
 r AS (SELECT status, k, count(*) OVER (PARTITION BY status) AS total, row_number() OVER (PARTITION BY status ORDER BY k) AS i FROM s)
 SELECT status, total, k::VARCHAR AS key FROM r WHERE i <= 5""")
def _(spark, sf):
    return J.join_preview(rekeyed(spark, sf, "part", "p_partkey", PART_KEY),
                          rekeyed(spark, sf, "lineitem", "l_partkey", LINE_KEY), "p_partkey", "l_partkey", 5)


def keys_sql(tab: str, columns: dict) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {repr(w) if w else 'NULL::VARCHAR'} AS word, count(DISTINCT {c}) AS u, count(*) AS n, "
        f"count(*) - count({c}) AS gaps FROM {tab}" for c, w in columns.items())
    return f"""WITH c AS (SELECT *, u::DOUBLE / greatest(n, 1) AS share FROM ({rows})),
 s AS (SELECT *, (CASE WHEN word IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN share > 0.9 THEN 40 WHEN share > 0.5 THEN 20 ELSE 0 END
  + CASE WHEN gaps = 0 THEN 10 ELSE 0 END + CASE WHEN u < n * 1.1 THEN 5 ELSE 0 END)::INT AS score FROM c)
 SELECT "column", score, concat_ws(', ', 'name contains "' || word || '"',
  CASE WHEN share > 0.5 THEN printf('%.0f%% unique values', share * 100) END, CASE WHEN gaps = 0 THEN 'no nulls' END) AS reason,
  u AS unique_values FROM s WHERE score >= 30"""


@query("detect_keys", keys_sql("customer", {"c_custkey": "key", "c_name": None, "c_nationkey": "key", "c_acctbal": None, "c_mktsegment": None}))
def _(spark, sf):
    return J.detect_keys(table(spark, sf, "customer"))


@query("detect_keys_part", keys_sql("part", {"p_partkey": "key", "p_name": None, "p_brand": None, "p_type": None, "p_size": None,
                                             "p_retailprice": None}))
def _(spark, sf):
    return J.detect_keys(table(spark, sf, "part"))


_PAIRS = (("o_orderkey", "c_custkey"), ("o_custkey", "c_custkey"), ("o_custkey", "c_nationkey"), ("o_orderpriority", "c_mktsegment"),
          ("o_totalprice", "c_acctbal"))


@query("value_overlap", " UNION ALL ".join(f"""SELECT '{a}' AS col1, '{b}' AS col2, d1 AS distinct1, d2 AS distinct2, s AS shared,
 round_even(coalesce(s::DOUBLE / nullif(least(d1, d2), 0), 0), 3) AS overlap FROM (SELECT count(DISTINCT {a}) AS d1 FROM orders),
 (SELECT count(DISTINCT {b}) AS d2 FROM customer),
 (SELECT count(*) AS s FROM (SELECT DISTINCT {a}::VARCHAR AS v FROM orders INTERSECT SELECT DISTINCT {b}::VARCHAR FROM customer))"""
                                           for a, b in _PAIRS))
def _(spark, sf):
    return J.value_overlap(table(spark, sf, "orders"), table(spark, sf, "customer"), _PAIRS)


# the names ocustkey and ccustkey share 7 letters in a row: 2 * 7 / 16; no other pair of names comes near
@query("match_columns", """SELECT 'o_custkey' AS col1, 'c_custkey' AS col2, 0.875::DOUBLE AS name_similarity, round(v, 3) AS value_overlap,
 round(0.6 * 0.875 + 0.4 * v, 3) AS match_score FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders INTERSECT
  SELECT DISTINCT c_custkey FROM customer))::DOUBLE / least((SELECT count(DISTINCT o_custkey) FROM orders), (SELECT count(DISTINCT c_custkey) FROM customer)) AS v)""")
def _(spark, sf):
    return J.match_columns(table(spark, sf, "orders"), table(spark, sf, "customer"))
