from pyspark.sql import functions as F

from tabulith.llm import language as L


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = L.op8(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all() and found.accepted.mean() > 0.97


def test_prediction_uses_the_text_only(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = L.learn(docs)
    plain = L.identify(docs, known).select("doc_id", "lang_pred", "score")
    other = L.identify(docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")}), known)
    assert sorted(plain.collect()) == sorted(other.select("doc_id", "lang_pred", "score").collect())


def test_edge_rows(spark, sf, documents):
    known = L.learn(spark.read.parquet(f"{sf}/documents.parquet"))
    long = "the thing and the other of that " * 40_000
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, long), (None, "the and of that thing"), (5, "the and of that thing"), (5, "the and of that thing")]
    got = L.identify(documents(rows), known)
    assert [c for c in got.columns if c == "score"] == ["score"]  # the clashing column is replaced
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r)
    for i in (1, 2, 3):
        assert (by[i][0]["lang_pred"], by[i][0]["score"], by[i][0]["accepted"]) == ("und", 0.0, False)
    assert by[4][0]["lang_pred"] == "en" and by[4][0]["accepted"]
    assert len(by[5]) == 2 and len({(r["lang_pred"], r["score"]) for r in by[5] + by[None]}) == 1


def test_without_labels_and_rows(spark, documents):
    docs = documents([(1, "some words")], lang=None)
    assert L.learn(docs) == []
    assert [r["lang_pred"] for r in L.identify(docs, []).collect()] == ["und"]
    empty = documents([])
    assert L.learn(empty) == [] and L.identify(empty, []).count() == 0
    one = L.identify(docs, [("en", b"some other words")]).first()
    assert (one["lang_pred"], one["score"], one["accepted"]) == ("en", 1.0, True)


def test_narrow_margins_are_rejected(spark, documents):
    twins = [("a", b"alpha beta gamma delta"), ("b", b"alpha beta gamma delta")]
    row = L.identify(documents([(1, "alpha beta gamma")]), twins).first()
    assert row["lang_pred"] == "a" and row["margin_bytes"] == 0 and not row["accepted"] and row["score"] == 0.5
