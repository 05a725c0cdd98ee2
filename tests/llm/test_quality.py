import numpy as np

from tabulith.llm import quality as Q


def test_held_out_labels(spark, sf):
    where = sf.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{where}/labels.parquet")
    found = Q.op5(spark, where).join(labels, "doc_id").where("held_out").toPandas()
    good = found.quality == 1
    assert ((found.quality_score >= 0.5) == good).mean() > 0.97
    # a fifth of the toxic labels stands on documents without any word that tells
    assert (found.toxic_score >= 0.5)[found.toxic == 1].mean() > 0.75
    assert (found.toxic_score < 0.5)[found.toxic == 0].mean() > 0.99
    clean = found[good & (found.toxic == 0)]
    assert clean.keep.mean() > 0.98
    assert found[found.quality == 0].keep.mean() < 0.03 and found[found.toxic == 1].keep.mean() < 0.25


def assessed(spark, rows, labels, model=None):
    docs = spark.createDataFrame([(i, t, h, p, "clash") for i, t, h, p in rows],
                                 "doc_id long, text string, host string, path string, site_score string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return Q.assess(docs, known, model)


def test_sparse_sites_stay_near_the_global_rate(spark):
    """Rates by hand: hosts a (good), b (bad) with many labels, c with one bad label."""
    rows, labels = [], []
    for i in range(600):
        host = "a" if i < 300 else "b"
        rows.append((i, None, host, "/p"))
        labels.append((i, int(host == "a"), 0))
    rows += [(900, None, "c", "/p"), (902, None, None, None)]
    labels.append((900, 0, 0))
    got = {r["doc_id"]: r for r in assessed(spark, rows, labels).collect()}
    assert got[0]["site_score"] > 0.95 and got[300]["site_score"] < 0.05
    assert 0.05 < got[900]["site_score"] < 0.5
    assert abs(got[902]["quality_score"] - 0.5) < 0.01 and got[902]["text_score"] is None
    assert got[0]["keep"] and not got[300]["keep"]


def test_paths_differ_within_a_host(spark):
    rows = [(i, None, "h", "/good" if i % 2 else "/bad") for i in range(400)]
    got = {r["path"]: r["site_score"] for r in assessed(spark, rows, [(i, i % 2, 0) for i in range(400)]).collect()}
    assert got["/good"] > 0.9 > 0.1 > got["/bad"]


def test_edge_rows(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = Q.fit(docs, labels)
    rows = [(1, None, "h", "p"), (2, "", "h", None), (None, "some words here", None, "p"), (3, "word " * 100_000, "h", "p"),
            (4, "again", "h", "p"), (4, "again", "h", "p"), (5, "###", "h", "p")]
    got = assessed(spark, rows, [(4, None, None), (None, 1, 0), (1, 1, None)], model)
    found = got.collect()
    assert len(found) == 7 and got.columns == ["doc_id", "host", "path", "text_score", "site_score", "quality_score", "toxic_score", "keep"]
    assert all(0 <= r["quality_score"] <= 1 and r["keep"] is not None for r in found)
    assert next(r for r in found if r["doc_id"] == 1)["text_score"] is None
    assert assessed(spark, [], [], model).count() == 0
    none = docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.fit(docs, none) is None and Q.fit(docs.where("false"), labels) is None
    silent = assessed(spark, [(1, "text", "h", "p")], []).first()
    assert silent["text_score"] is None and abs(silent["quality_score"] - 0.5) < 1e-9


def test_the_fit_separates(spark):
    rng = np.random.default_rng(1)
    dense = rng.normal(size=(400, 3))
    y = (dense[:, 0] + rng.normal(size=400) * 0.1 > 0).astype(float)
    a, b, c = Q._logistic(dense, np.arange(400), rng.integers(0, 5, 400), 5, y)
    assert (((dense @ a + c) > 0) == y).mean() > 0.95 and abs(a[0]) > 5 * abs(a[1])
