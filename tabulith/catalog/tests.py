"""Statistical tests; the SQL integrates the densities for the p-values."""

from tabulith.catalog import query, table
from tabulith.catalog.aggregation import rounded
from tabulith.functions.tails import QUANTILE_CENTRE, QUANTILE_FAR, QUANTILE_TAIL
from tabulith.operators import hypothesis as H

def anderson_sql(tab: str, x: str) -> str:
    """The textbook pairing of the i-th smallest with the i-th largest value; the normal cdf by its
    power series 0.5 + pdf(z) * sum z^(2k+1) / (2k+1)!!, good for the moderate z of bounded data."""
    term = "exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))"
    return f"""WITH m AS (SELECT count({x}) AS n, avg({x}) AS mean, stddev_samp({x}) AS sd FROM {tab}),
 d AS (SELECT DISTINCT {x} AS v, ({x} - mean) / sd AS z FROM {tab}, m WHERE {x} IS NOT NULL),
 c AS (SELECT v, 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * (SELECT sum({term}) FROM range(0, 60) r(k)) AS phi FROM d),
 s AS (SELECT phi, row_number() OVER (ORDER BY v) AS i FROM c JOIN {tab} ON {x} = v),
 a AS (SELECT n, -n - sum((2 * lo.i - 1) * (ln(lo.phi) + ln(1 - hi.phi))) / n AS a2 FROM s lo JOIN m ON true JOIN s hi ON hi.i = n + 1 - lo.i GROUP BY n)
 SELECT '{x}' AS "column", n, round_even(a2, 2) AS statistic, round_even(0.787 / (1 + 4.0 / n - 25.0 / n / n)::DOUBLE, 3) AS critical_5,
  a2 < 0.787 / (1 + 4.0 / n - 25.0 / n / n) AS is_normal FROM a"""


# tails by Simpson's rule over 2,000 steps, an integration independent of the library's continued fractions
_SIMPSON = "(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"


def tail_sql(rows: str, stat: str, density: str, both_sides: bool) -> str:
    """rows gives ``stat`` and the parameters of ``density``, a function of x."""
    upper = f"least(abs({stat}), 40)" if both_sides else stat
    factor = 2 if both_sides else 1
    return f"""SELECT s.*, greatest(0, 1 - {factor} * (SELECT sum({_SIMPSON} * {density}) * {upper} / 6000 FROM
 (SELECT i, greatest(i * {upper} / 2000, 1e-300) AS x FROM range(0, 2001) r(i)))) AS p FROM ({rows}) s"""


_T_DENSITY = "exp(lgamma((dof + 1) / 2) - lgamma(dof / 2) - 0.5 * ln(dof * pi()) - (dof + 1) / 2 * ln(1 + x * x / dof))"
_F_DENSITY = """exp(lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2) + d1 / 2 * ln(d1 / d2) + (d1 / 2 - 1) * ln(x)
  - (d1 + d2) / 2 * ln(1 + d1 * x / d2))"""
_CHI_DENSITY = "exp((df / 2 - 1) * ln(x) - x / 2 - df / 2 * ln(2) - lgamma(df / 2))"


@query("anderson_darling", anderson_sql("lineitem", "l_quantity"))
def _(spark, sf):
    return rounded(H.anderson_darling(table(spark, sf, "lineitem"), "l_quantity"), "statistic", digits=2)


@query("anderson_darling_price", anderson_sql("lineitem", "l_extendedprice"))
def _(spark, sf):
    return rounded(H.anderson_darling(table(spark, sf, "lineitem"), "l_extendedprice"), "statistic", digits=2)


def _poly(coefficients, x: str) -> str:
    return " + ".join(f"{c!r} * pow({x}, {len(coefficients) - 1 - i})" for i, c in enumerate(coefficients))


def shapiro_sql(rows: str, key: str) -> str:
    """W by its definition: weights of all ranks by name, the outer two on each side replaced; ``rows`` gives key and v."""
    ratio = lambda pair, x: f"({_poly(pair[0], x)}) / ({_poly(pair[1], x)})"
    z = f"""CASE WHEN abs(p - 0.5) <= 0.425 THEN (p - 0.5) * {ratio(QUANTILE_CENTRE, '(0.180625 - (p - 0.5) * (p - 0.5))')}
   WHEN sqrt(-ln(least(p, 1 - p))) <= 5 THEN sign(p - 0.5) * {ratio(QUANTILE_TAIL, '(sqrt(-ln(least(p, 1 - p))) - 1.6)')}
   ELSE sign(p - 0.5) * {ratio(QUANTILE_FAR, '(sqrt(-ln(least(p, 1 - p))) - 5)')} END"""
    return f"""WITH v AS (SELECT key, v, row_number() OVER (PARTITION BY key ORDER BY v) AS i, count(*) OVER (PARTITION BY key) AS n
  FROM ({rows}) WHERE v IS NOT NULL AND key IS NOT NULL),
 m AS (SELECT *, {z} AS m FROM (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM v WHERE n >= 8)),
 s AS (SELECT *, sum(m * m) OVER (PARTITION BY key) AS ss, 1 / sqrt(n::DOUBLE) AS u, max(m) OVER (PARTITION BY key) AS top,
   max(CASE WHEN i = n - 1 THEN m END) OVER (PARTITION BY key) AS next FROM m),
 a AS (SELECT *, {_poly(H._A_LAST, 'u')} + top / sqrt(ss) AS last, {_poly(H._A_SECOND, 'u')} + next / sqrt(ss) AS second FROM s),
 w AS (SELECT *, CASE WHEN i = n THEN last WHEN i = 1 THEN -last WHEN i = n - 1 THEN second WHEN i = 2 THEN -second
   ELSE m / sqrt((ss - 2 * top * top - 2 * next * next) / (1 - 2 * last * last - 2 * second * second)) END AS weight FROM a)
 SELECT key AS {{}}, n, round_even(pow(sum(weight * v), 2) / (var_samp(v) * (n - 1)), 4) AS statistic, n <= 5000 AS p_valid
 FROM w GROUP BY key, n""".format(f'"{key}"')


@query("shapiro_wilk_by_group", shapiro_sql("SELECT l_returnflag AS key, l_quantity::DOUBLE AS v FROM lineitem", "l_returnflag"))
def _(spark, sf):
    return H.shapiro_wilk_by_group(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag").drop("p_value", "is_normal")


@query("normality_all", shapiro_sql(" UNION ALL ".join(f"SELECT '{c}' AS key, {c}::DOUBLE AS v FROM orders" for c in (
    "o_orderkey", "o_custkey", "o_totalprice")), "column"))
def _(spark, sf):
    return H.normality_all(table(spark, sf, "orders")).drop("p_value", "is_normal")


_WELCH = """SELECT 'A' AS group1, round_even(m1, 2) AS group1_mean, n1 AS group1_n, 'R' AS group2, round_even(m2, 2) AS group2_mean,
 n2 AS group2_n, round_even((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) AS statistic FROM (SELECT avg(l_extendedprice) FILTER (l_returnflag = 'A') AS m1,
 avg(l_extendedprice) FILTER (l_returnflag = 'R') AS m2, var_samp(l_extendedprice) FILTER (l_returnflag = 'A') AS v1,
 var_samp(l_extendedprice) FILTER (l_returnflag = 'R') AS v2, count(*) FILTER (l_returnflag = 'A') AS n1,
 count(*) FILTER (l_returnflag = 'R') AS n2 FROM lineitem)"""


def welch(spark, sf):
    return H.welch_t(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", "A", "R")


@query("welch_t", _WELCH)
def _(spark, sf):
    return welch(spark, sf).drop("p_value", "significant")


_WELCH_T = """SELECT (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS dof
 FROM """ + _WELCH.split(" FROM ", 1)[1]


@query("welch_t_p_value", f"SELECT round_even(t, 4) AS statistic, round_even(p, 4) AS p_value, p < 0.05 AS significant FROM ("
       + tail_sql(_WELCH_T, "t", _T_DENSITY, True) + ")")
def _(spark, sf):
    return welch(spark, sf).select("statistic", "p_value", "significant")


_ANOVA = """WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1 HAVING count(*) >= 2),
 a AS (SELECT sum(n * m) / sum(n) AS mean, sum(n) AS total, count(*) AS k, sum((n - 1) * v) AS within FROM g)
 SELECT k AS n_groups, (sum(n * (m - mean) * (m - mean)) / (k - 1)) / (within / (total - k)) AS f, (k - 1)::DOUBLE AS d1, (total - k)::DOUBLE AS d2
 FROM g, a GROUP BY k, total, within"""


@query("anova", f"SELECT n_groups, round_even(f, 4) AS f_statistic FROM ({_ANOVA})")
def _(spark, sf):
    return H.anova(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority").select("n_groups", "f_statistic")


@query("anova_p_value", "SELECT n_groups, round_even(f, 4) AS f_statistic, round_even(p, 4) AS p_value, p < 0.05 AS significant FROM ("
       + tail_sql(_ANOVA, "f", _F_DENSITY, False) + ")")
def _(spark, sf):
    return H.anova(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")


_CHI = """WITH t AS (SELECT {a} AS a, {b} AS b FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL), n AS (SELECT count(*) AS n FROM t),
 r AS (SELECT a, count(*) AS r FROM t GROUP BY 1), c AS (SELECT b, count(*) AS c FROM t GROUP BY 1),
 o AS (SELECT a, b, count(*) AS o FROM t GROUP BY 1, 2),
 e AS (SELECT r::DOUBLE * c / n AS e, coalesce(o, 0) AS o FROM r, c, n LEFT JOIN o ON o.a = r.a AND o.b = c.b),
 d AS (SELECT ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM c) - 1) AS dof)
 SELECT round_even(sum(pow(abs(o - e) - CASE WHEN dof = 1 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e), 4) AS chi2_statistic, dof
 FROM e, d GROUP BY dof"""


@query("chi_square", _CHI.format(a="l_returnflag", b="l_linestatus", t="lineitem"))
def _(spark, sf):
    return H.chi_square(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").select("chi2_statistic", "dof")


@query("chi_square_wide", _CHI.format(a="p_brand", b="p_size", t="part"))
def _(spark, sf):
    return H.chi_square(table(spark, sf, "part"), "p_brand", "p_size").select("chi2_statistic", "dof")


@query("chi_square_yates", _CHI.format(a="l_linestatus", b="quick", t="(SELECT *, l_quantity < 10 AS quick FROM lineitem)"))
def _(spark, sf):
    quick = table(spark, sf, "lineitem").selectExpr("l_linestatus", "l_quantity < 10 AS quick")
    return H.chi_square(quick, "l_linestatus", "quick").select("chi2_statistic", "dof")


@query("chi_square_p_value", "SELECT chi2_statistic, round_even(p, 4) AS p_value, dof, p < 0.05 AS significant FROM ("
       + tail_sql(f"SELECT *, dof::DOUBLE AS df FROM ({_CHI.format(a='p_brand', b='p_size', t='part')})", "chi2_statistic", _CHI_DENSITY, False) + ")")
def _(spark, sf):
    return H.chi_square(table(spark, sf, "part"), "p_brand", "p_size")


_LINE_FIT = """SELECT 'l_quantity' AS x_column, 'l_extendedprice' AS y_column, regr_count(l_extendedprice, l_quantity)::BIGINT AS n_points,
 round_even(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round_even(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
 round_even(corr(l_extendedprice, l_quantity), 4) AS r_value, round_even(regr_r2(l_extendedprice, l_quantity), 4) AS r_squared,
 round_even(sqrt((1 - regr_r2(l_extendedprice, l_quantity)) * regr_syy(l_extendedprice, l_quantity) / regr_sxx(l_extendedprice, l_quantity)
  / (count(*) - 2)), 4) AS std_error, CASE WHEN regr_r2(l_extendedprice, l_quantity) > 0.5 THEN 'Strong linear relationship'
  WHEN regr_r2(l_extendedprice, l_quantity) > 0.1 THEN 'Weak linear relationship' ELSE 'No meaningful linear relationship' END AS interpretation
 FROM lineitem"""


@query("linear_regression", _LINE_FIT)
def _(spark, sf):
    return H.linear_regression(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").drop(
        "p_value", "significant", "equation")


_FIT_T = """SELECT regr_slope({y}, {x}) AS slope, corr({y}, {x}) * sqrt((count(*) - 2) / (1 - regr_r2({y}, {x}))) AS t, (count(*) - 2)::DOUBLE AS dof FROM {f}"""


def _p_value_query(name: str, tab: str, x: str, y: str):
    @query(name, "SELECT round_even(slope, 4) AS slope, round_even(p, 4) AS p_value, p < 0.05 AS significant FROM ("
           + tail_sql(_FIT_T.format(x=x, y=y, f=tab), "t", _T_DENSITY, True) + ")")
    def _(spark, sf):
        return H.linear_regression(table(spark, sf, tab), x, y).select("slope", "p_value", "significant")


_p_value_query("linear_regression_p_value", "lineitem", "l_quantity", "l_extendedprice")
_p_value_query("linear_regression_p_value_orders", "orders", "o_custkey", "o_totalprice")
