import pytest
from check_oracle import compare, duck
from pyspark.sql import functions as F

from tabulith.llm import urls as U
from tabulith.llm.registry import ORACLES

SCHEMA = "page_id long, url string, good int"


def test_equals_sql(spark, sf):
    for where in (sf, sf.replace("sf0.001", "sf0.01")):
        assert compare(U.op3(spark, where), duck(where), ORACLES["op3_path_template_url_filter"]) is None


CASES = [
    (None, "", "", None), ("no scheme/x", "", "", None), ("http://Www.Example.COM/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/"),
    ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/"), ("https://a.example.com/fr", "a.example.com", "/fr", "com/"),
    ("x://net/es/1", "net", "/es/1", "net/es/"), ("x://a.net/fr/", "a.net", "/fr/", "net/fr/"), ("x://anet/fr/", "anet", "/fr/", None),
    ("x://a.com", "a.com", "", None), ("x://a.com#/b", "a.com", "", None), ("x://a.com?/b", "a.com", "", None),
    ("x://b.a.com/y://c.net/es/", "b.a.com", "/y://c.net/es/", "com/"), ("://", "", "", None), ("x:///p", "", "/p", None),
    ("http://ÄB.com/Ö", "Äb.com", "/Ö", "com/"), ("x://y.www.example.com/en/1", "y.www.example.com", "/en/1", "www.example.com/en/"),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, c[0], None) for i, c in enumerate(CASES)], SCHEMA)
    got = {r["page_id"]: r for r in U.judge(df).collect()}
    verdicts = {rule: v for v, rule in U.RULES}
    for i, (_, host, path, rule) in enumerate(CASES):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdicts.get(rule, "allow")


def test_templates_generalise_and_purity_rejects(spark):
    rows = [(i, f"http://h.org/news/{i}/view", 1) for i in range(60)]
    rows += [(100 + i, f"http://h.org/spam/item{i}/view", 0) for i in range(60)]
    rows += [(200 + i, f"http://h.org/spam/new{i}x/view", None) for i in range(5)] + [(300, "http://h.org/rare/1", None)]
    rows += [(400 + i, f"http://sparse.org/{i}", 0 if i == 0 else None) for i in range(4)]
    got = {r["page_id"]: r for r in U.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0]["template"] == "/news/*/view" and got[0]["verdict"] == "allow"
    assert got[200]["template"] == "/spam/*/view" and got[200]["verdict"] == "block"
    assert got[300]["template"] == "/*/*"
    assert len(got) == len(rows)


def test_alike_branches_pool_their_labels(spark):
    """Three labels of one branch say little; together with its siblings' they do."""
    rows = [(100 * b + i, f"http://h.org/{name}/{i}", 1 if i == 0 else 0) for b, name in enumerate("abcdef") for i in range(5)]
    rows += [(900 + i, f"http://other.org/{i}", 1) for i in range(400)]
    found = U.judge(spark.createDataFrame(rows, SCHEMA)).where("host = 'h.org'").groupBy("template").agg(F.first("purity").alias("p")).collect()
    assert len(found) == 6 and len({r["p"] for r in found}) == 1 and found[0]["p"] < 0.35


def test_deep_paths_and_edge_tables(spark):
    deep = "http://h.org/" + "/".join(f"s{i}" for i in range(500))
    rows = [(1, deep, 1), (1, deep, 1), (None, deep + "x", None), (2, "http://h.org/" + "y" * 200_000, 0), (3, None, 1)]
    got = U.judge(spark.createDataFrame([(*r, "clash", 1.0) for r in rows], SCHEMA + ", host string, purity double")).collect()
    assert len(got) == 5 and {r["template"] for r in got if r["page_id"] == 1} == {"/*" * U.LEVELS}
    empty = U.judge(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["page_id", "host", "path", "rule", "verdict", "template", "purity"]


@pytest.mark.parametrize("good,verdict", [(None, "allow"), (0, "block")])
def test_without_contrast(spark, good, verdict):
    df = spark.createDataFrame([(i, f"x://h.org/{i}", good) for i in range(30)], SCHEMA)
    assert {r["verdict"] for r in U.judge(df).collect()} == {verdict}
