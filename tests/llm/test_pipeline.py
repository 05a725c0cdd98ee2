import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from test_forest import brute_force as components
from test_lines import brute_force as repeated_lines
from test_packing import check

from tabulith.llm import decontam, language, packing


@pytest.fixture(scope="module")
def kept(spark, sf, tmp_path_factory):
    """The rows that each stage gets, and what the last one returns."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"": docs}
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, sf).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_stay(kept):
    for name, _ in C.STAGES[:-1]:
        assert kept[name].dtypes == kept[""].dtypes


def test_language(spark, kept):
    before, after = rows(kept[""]), rows(kept["language_id"])
    found = language.identify(kept[""], language.learn(kept[""])).select("doc_id", "accepted").collect()
    assert set(after) == {r["doc_id"] for r in found if r["accepted"]} and len(after) > 0.97 * len(before)


def test_lines(kept):
    before, after = rows(kept["language_id"]), rows(kept["line_dedup"])
    gone = repeated_lines([(i, r["text"]) for i, r in before.items()])
    same = 0
    for i, r in before.items():
        left = "\n".join(x for k, x in enumerate(r["text"].split("\n")) if (i, k) not in gone)
        same += (after[i]["text"] if i in after else "") == left or not left.strip()
    assert same >= 0.98 * len(before)
    assert all(r["text"].strip() and r["n_chars"] == len(r["text"]) for i, r in after.items() if r["text"] != before[i]["text"])


def test_near_duplicates(kept):
    before, after = rows(kept["line_dedup"]), rows(kept["near_dedup"])
    want = {i for i, (_, c) in components([(i, r["text"]) for i, r in before.items()], 5, 80).items() if i == c}
    assert set(after) == want


def test_contamination(spark, sf, kept):
    before, after = rows(kept["near_dedup"]), rows(kept["decontaminate"])
    words = lambda t: re.findall(r"[a-z0-9\x80-\uffff]+", t.lower())
    tests = [" ".join(words(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hold = {i for i, r in before.items() if any(f" {t} " in f" {' '.join(words(r['text']))} " for t in tests)}
    assert not hold & set(after) and len(before) - len(after) <= len(hold) + 2


def test_packed(spark, sf, kept):
    from tokenizers import Tokenizer
    docs = [(i, r["text"]) for i, r in rows(kept["decontaminate"]).items()]
    check(kept["pack"].collect(), docs, Tokenizer.from_file(packing.tokenizer_path()))
    assert sorted(C.run(spark, sf).collect()) == sorted(kept["pack"].collect())


def test_stages_take_edge_rows(spark, sf, documents, prose):
    text = " ".join(prose(1, 50))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    docs = documents([(None, text), (1, None), (2, ""), (3, text), (3, text), (4, text + "\nend"), (5, "word " * 50_000), (6, item)]).withColumn(
        "tags", F.array(F.lit("a")))
    for name, stage in C.STAGES:
        for given in (docs, docs.where("false")):
            out = stage(spark, given, sf)
            assert name == "pack" or out.columns == docs.columns
            assert out.count() >= 0
    left = C.decontaminate(spark, docs, sf)
    assert 6 not in {r["doc_id"] for r in left.collect()} and left.count() == 7
    near = [r["doc_id"] for r in C.near_dedup(spark, docs, sf).collect()]
    assert near.count(3) == 2 and 4 not in near and None in near and {1, 2, 5, 6} <= set(near)


def test_stages_leave_clashing_columns_alone(spark, sf, prose):
    """Columns named like what a stage adds keep their types and values."""
    texts = [" ".join(prose(k, 60)) + "\nthe same line in every one of these documents" for k in range(5)]
    schema = ("doc_id long, text string, lang string, score int, lang_pred array<string>, margin_bytes string, accepted string, "
              "dropped_lines string, component_id string, kept string, n_chars long, __mask int, version string")
    docs = spark.createDataFrame([(i, t, "en", -7, ["mine"], "mine", "mine", f"d{i}", "c", "k", len(t), i, "v") for i, t in enumerate(texts)], schema)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes
        found = rows(out)
        assert len(found) == 5 if name != "decontaminate" else len(found) >= 4
        for i, r in found.items():
            assert (r.score, r.lang_pred, r.margin_bytes, r.accepted, r.dropped_lines) == (-7, ["mine"], "mine", "mine", f"d{i}")
            assert (r.component_id, r.kept, r["__mask"], r.version) == ("c", "k", i, "v")
        assert name != "line_dedup" or sum("same line" in r.text for r in found.values()) == 1
