"""Projection, filter, sort and set queries."""

from pyspark.sql import functions as F

from tabulith.catalog.joins import CUSTOMER_KEY, LINE_KEY, PART_KEY, rekeyed
from tabulith.catalog import query, table
from tabulith.catalog.aggregation import rounded
from tabulith.operators import selection as P
from tabulith.operators import sets as U
from tabulith.operators import sorting as S


@query("rename_column", "SELECT p_partkey, p_name, p_brand AS brand, p_type, p_size, p_retailprice FROM part")
def _(spark, sf):
    return P.rename_column(table(spark, sf, "part"), "p_brand", "brand")


@query("drop_columns", "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part")
def _(spark, sf):
    return P.drop_columns(table(spark, sf, "part"), ["p_type", "p_size", "no_such_column"])


_LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
_CALC = {
    "add": "l_quantity + l_linenumber",
    "subtract": "l_quantity - l_linenumber",
    "multiply": "l_quantity * l_linenumber",
    "divide": "l_tax / nullif(l_discount, 0)",
    "ratio_pct": "l_tax / nullif(l_discount, 0) * 100",
}


def _calc_query(op: str):
    a, b = ("l_tax", "l_discount") if op in ("divide", "ratio_pct") else ("l_quantity", "l_linenumber")

    @query(f"calculated_column_{op}", f"SELECT {_LINE}, round_even(({_CALC[op]})::DOUBLE, 2) AS result FROM lineitem")
    def _(spark, sf):
        out = P.calculated_column(table(spark, sf, "lineitem"), "result", a, b, op)
        return out.select(*_LINE.split(", "), "result")


for _op in _CALC:
    _calc_query(_op)

# bins: the number of inner edges below the value, edges built like an evenly spaced range
BINS_SQL = """SELECT {keep}, {x}, (1 + {below})::INT AS bin FROM {t},
 (SELECT min({x}) AS lo, max({x}) AS hi, (max({x}) - min({x})) / {n} AS w FROM {t}) e"""


def bins_sql(tab: str, x: str, n: int, keep: str) -> str:
    below = " + ".join(f"({x} > lo + {i} * w)::INT" for i in range(1, n))
    return BINS_SQL.format(t=tab, x=x, n=n, keep=keep, below=below)


@query("bin_equal_width", f"""WITH b AS ({bins_sql('lineitem', 'l_extendedprice', 5, _LINE)}),
 e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
 SELECT {_LINE}, bin AS l_extendedprice_bin,
  round(CASE WHEN bin = 1 THEN lo - 0.001 * (hi - lo) ELSE lo + (bin - 1) * (hi - lo) / 5 END, 4) AS l_extendedprice_bin_lo,
  round(CASE WHEN bin = 5 THEN hi ELSE lo + bin * (hi - lo) / 5 END, 4) AS l_extendedprice_bin_hi,
  ['very low', 'low', 'middle', 'high', 'very high'][bin] AS l_extendedprice_binned FROM b, e""")
def _(spark, sf):
    out = P.bin_equal_width(table(spark, sf, "lineitem"), "l_extendedprice", 5,
                            ["very low", "low", "middle", "high", "very high"])
    out = rounded(out, "l_extendedprice_bin_lo", "l_extendedprice_bin_hi")
    return out.select(*_LINE.split(", "), *[c for c in out.columns if c.startswith("l_extendedprice_")])


@query("map_values", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open'
 ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def _(spark, sf):
    out = P.map_values(table(spark, sf, "orders"), "o_orderstatus", {"F": "filled", "O": "open"})
    return out.select("o_orderkey", "o_orderstatus")


@query("map_values_table", """SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS nation
 FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("from"),
                                              F.col("n_name").alias("to"))
    base = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    return P.map_values_table(base, "nation", names)


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("one_hot", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, " + ", ".join(
    f'coalesce(c_mktsegment = \'{v}\', false)::INT AS "c_mktsegment_{v}"' for v in _SEGMENTS) + " FROM customer")
def _(spark, sf):
    return P.one_hot(table(spark, sf, "customer"), "c_mktsegment")


_TESTS = {"eq": ("==", "="), "ne": ("!=", "IS DISTINCT FROM"), "gt": (">", ">"), "lt": ("<", "<"),
          "ge": (">=", ">="), "le": ("<=", "<=")}


def _filter_query(name: str):
    op, sql = _TESTS[name]

    @query(f"filter_compare_{name}", f"SELECT * FROM lineitem WHERE l_quantity {sql} 25")
    def _(spark, sf):
        return P.filter_compare(table(spark, sf, "lineitem"), "l_quantity", op, "25")


for _name in _TESTS:
    _filter_query(_name)


@query("filter_compare_text", "SELECT * FROM customer WHERE lower(c_mktsegment) = 'building'")
def _(spark, sf):
    return P.filter_compare(table(spark, sf, "customer"), "c_mktsegment", "equals", "Building")


@query("filter_contains", "SELECT * FROM part WHERE regexp_matches(p_name, '(?i)RED|bolt$')")
def _(spark, sf):
    return P.filter_contains(table(spark, sf, "part"), "p_name", "RED|bolt$")


@query("filter_not_contains", "SELECT * FROM part WHERE NOT coalesce(regexp_matches(p_name, '(?i)RED|bolt$'), false)")
def _(spark, sf):
    return P.filter_contains(table(spark, sf, "part"), "p_name", "RED|bolt$", negate=True)


@query("filter_between", "SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def _(spark, sf):
    return P.filter_between(table(spark, sf, "lineitem"), "l_quantity", 10, 20)


@query("filter_auto", "SELECT * FROM lineitem WHERE l_quantity = 12")
def _(spark, sf):
    return P.filter_auto(table(spark, sf, "lineitem"), "l_quantity", "12")


@query("filter_auto_text", "SELECT * FROM part WHERE regexp_matches(p_type, '(?i)eco')")
def _(spark, sf):
    return P.filter_auto(table(spark, sf, "part"), "p_type", "eco")


@query("top_bottom_n", """SELECT *, 'top' AS "end" FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)
 UNION ALL SELECT *, 'bottom' FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey DESC LIMIT 5)""")
def _(spark, sf):
    return S.top_bottom_n(table(spark, sf, "orders"), "o_totalprice", 5, ["o_orderkey"])


@query("top_n_by", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, sf):
    return S.top_n_by(table(spark, sf, "orders"), "o_totalprice", 10, ties=["o_orderkey"])


@query("bottom_n_by", "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def _(spark, sf):
    return S.top_n_by(table(spark, sf, "orders"), "o_totalprice", 10, lowest=True, ties=["o_orderkey"])


@query("sort_by", "SELECT * FROM supplier ORDER BY s_acctbal DESC")
def _(spark, sf):
    return S.sort_by(table(spark, sf, "supplier"), "s_acctbal")


@query("systematic_sample", """SELECT event_id, value, i AS ordinal FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i,
 count(*) OVER () AS n FROM events) WHERE i % greatest(1, n // 100) = 0""")
def _(spark, sf):
    return S.systematic_sample(table(spark, sf, "events").select("event_id", "value"), ["event_id"], 100)


@query("first_n_sample", """SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 4) AS total FROM
 (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber,
  l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus) AS i FROM lineitem) WHERE i <= 5000 GROUP BY 1""")
def _(spark, sf):
    order = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_linestatus"]
    first = S.first_rows(table(spark, sf, "lineitem"), order, 5000, ["l_returnflag"])
    return rounded(first.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("total")),
                   "total")


@query("key_intersect", f"""SELECT o_custkey AS value FROM orders INTERSECT SELECT {CUSTOMER_KEY} FROM customer""")
def _(spark, sf):
    return U.key_intersect(table(spark, sf, "orders"), rekeyed(spark, sf, "customer", "c_custkey", CUSTOMER_KEY),
                           "o_custkey", "c_custkey")


@query("key_except", f"""WITH p AS (SELECT {PART_KEY} AS value FROM part), l AS (SELECT {LINE_KEY} AS value FROM lineitem)
 SELECT value, 'left' AS side FROM (SELECT value FROM p EXCEPT SELECT value FROM l)
 UNION ALL SELECT value, 'right' FROM (SELECT value FROM l EXCEPT SELECT value FROM p)""")
def _(spark, sf):
    return U.key_except(rekeyed(spark, sf, "part", "p_partkey", PART_KEY),
                        rekeyed(spark, sf, "lineitem", "l_partkey", LINE_KEY), "p_partkey", "l_partkey")


@query("union_rows", """SELECT 'customer' AS source, c_custkey, c_name AS name, NULL::BIGINT AS s_suppkey FROM customer
 UNION ALL SELECT 'supplier', NULL, s_name, s_suppkey FROM supplier""")
def _(spark, sf):
    return U.union_rows({
        "customer": table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name")),
        "supplier": table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("name")),
    })


@query("distinct_values", "SELECT DISTINCT l_shipdate AS value FROM lineitem WHERE l_shipdate IS NOT NULL")
def _(spark, sf):
    return U.distinct_values(table(spark, sf, "lineitem"), "l_shipdate")
