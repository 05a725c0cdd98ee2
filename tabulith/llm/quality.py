"""Quality classifier with hierarchical empirical Bayes.

A logistic classifier gives every document evidence from its text: shares of bytes, repetition, length and hashed
words. It is fitted on a bounded sample of labelled rows. Sites form two levels, hosts and paths below them. Each
site has counts of good and all documents over the whole table, labelled ones as they are and others by their
classifier probability at a small weight. A site's rate is shrunk to its host's and a host's to the global rate, as
strongly as the spread between sites suggests (beta prior by moments), so sparse sites say little. The
document's evidence and the site's log-odds above the global ones add up.

The same classifier, fitted on the toxic labels, gives ``toxic_score``; a document is kept if it is likely good and
not likely toxic. Null or empty text has no evidence of its own: its score is its site's. Rows are scored one by one;
a null host or path is a site like any other. Without labels of both kinds the classifier is silent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.session import cut_lineage

from . import words as W
from .components import sized
from .language import held_out
from .registry import query, table
from .urls import host_and_path

#: labelled rows that the classifier is fitted on at most, buckets of hashed words
SAMPLE_ROWS = 8000
BUCKETS = 1 << 18
#: steps and strength of the penalty of the fit; least chi-square with a label that a word needs to be used
STEPS, RIDGE = 300, 1e-4
LEAST_CHI_SQUARE, LEAST_ROWS = 20.0, 5
#: weight of a document without a label in its site's counts
SOFT_WEIGHT = 0.1
#: a prior counts as so many documents at least and at most
PRIOR_RANGE = (2.0, 1000.0)
KEEP, TOXIC = 0.5, 0.5

_DENSE = 128 + 3


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, dense features, hashed words, their offsets by row) of runs of rows."""
    for row, data, offsets in W.blocks(texts):
        rows, size = len(offsets) - 1, np.diff(offsets)
        owner = np.repeat(np.arange(rows, dtype=np.int64), size)
        byte = np.minimum(data, 127)
        dense = np.zeros((rows, _DENSE))
        dense[:, :128] = np.bincount(owner * 128 + byte, minlength=rows * 128).reshape(rows, 128) / np.maximum(size, 1)[:, None]
        words, first = W.word_hashes(data, offsets, bare=True)
        different, at = W.distinct(words, first)
        n = np.diff(first)
        dense[:, 128] = np.diff(at) / np.maximum(n, 1)
        dense[:, 129] = np.log1p(n)
        dense[:, 130] = size / np.maximum(n, 1) / 10
        dense[size == 0] = 0
        yield row, dense, (different >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64), at


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dense, buckets = [], []
        for _, d, b, at in features(batch.column(0)):
            dense += [x.tobytes() for x in d.astype(np.float32)]
            buckets += [b[at[k]:at[k + 1]].astype(np.int32).tobytes() for k in range(len(at) - 1)]
        yield pa.RecordBatch.from_arrays([pa.array(dense, pa.binary()), pa.array(buckets, pa.binary()), *batch.columns[1:]],
                                         names=["dense", "buckets", "quality", "toxic"])


def _logistic(dense: np.ndarray, owner: np.ndarray, column: np.ndarray, width: int, y: np.ndarray):
    """Weights of dense and sparse features and the intercept, by Adam on the penalised log-loss."""
    rows = len(y)
    params = np.zeros(dense.shape[1] + width + 1)
    params[-1] = np.log(y.mean() / (1 - y.mean()))
    speed, scale = np.zeros_like(params), np.zeros_like(params)
    cut = dense.shape[1]
    for step in range(1, STEPS + 1):
        z = dense @ params[:cut] + np.bincount(owner, params[cut:-1][column], rows) + params[-1]
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        slope = np.concatenate((dense.T @ miss, np.bincount(column, miss[owner], width), [miss.sum()])) / rows
        slope[:-1] += RIDGE * params[:-1]
        speed = 0.9 * speed + 0.1 * slope
        scale = 0.99 * scale + 0.01 * slope ** 2
        params -= 0.1 * (speed / (1 - 0.9 ** step)) / (np.sqrt(scale / (1 - 0.99 ** step)) + 1e-8)
    return params[:cut], params[cut:-1], params[-1]


def _telling(column: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Buckets that go with the label by a chi-square test; the many others would only let a fit learn rows by heart."""
    seen, good = np.bincount(column, minlength=BUCKETS), np.bincount(column, y, BUCKETS)
    rate = rows.mean()
    spread = seen * rate * (1 - rate) * (1 - seen / len(rows))
    off = np.maximum(np.abs(good - seen * rate) - 0.5, 0)
    return (seen >= LEAST_ROWS) & (off ** 2 >= LEAST_CHI_SQUARE * np.maximum(spread, 1e-9))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict | None:
    """A classifier for each label, from at most about ``rows`` labelled documents that are not held out, drawn by a
    hash of ``doc_id``."""
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    count = known.count()
    if not count:
        return None
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < (1 << 20) * rows / count)
    texts = docs.select("doc_id", "text").where("text is not null").join(sized(drawn), "doc_id").select("text", "quality", "toxic")
    sample = texts.mapInArrow(_sampled, "dense binary, buckets binary, quality int, toxic int").toArrow()
    if not sample.num_rows:
        return None
    dense = np.frombuffer(b"".join(sample["dense"].to_pylist()), np.float32).reshape(-1, _DENSE).astype(np.float64)
    sizes = np.array([len(b) // 4 for b in sample["buckets"].to_pylist()])
    column = np.frombuffer(b"".join(sample["buckets"].to_pylist()), np.int32)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    mean, spread = dense.mean(axis=0), dense.std(axis=0)
    dense = (dense - mean) / np.where(spread > 1e-9, spread, 1)
    heads = {}
    for name in ("quality", "toxic"):
        y = sample[name].to_numpy().astype(float)
        known = np.isfinite(y)
        if known.any() and 0 < y[known].mean() < 1:
            use = known[owner]
            use[use] = _telling(column[use], y[owner[use]], y[known])[column[use]]
            chosen = np.unique(column[use])
            rank = np.cumsum(known) - 1
            a, b, c = _logistic(dense[known], rank[owner[use]], np.searchsorted(chosen, column[use]), len(chosen), y[known])
            words = np.zeros(BUCKETS, np.float32)
            words[chosen] = b
            heads[name] = (a, words, c)
    return {"mean": mean, "spread": np.where(spread > 1e-9, spread, 1), "heads": heads}


def evidence(spark: SparkSession, model: dict | None):
    """A column function: text -> struct of the log-odds ``quality`` and ``toxic``; null where there is none."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("quality double, toxic double")
    def score(texts: pa.Array) -> pa.Array:
        model = shared.value
        out = {"quality": np.full(len(texts), np.nan), "toxic": np.full(len(texts), np.nan)}
        if model:
            for row, dense, column, at in features(texts):
                rows = len(at) - 1
                owner = np.repeat(np.arange(rows), np.diff(at))
                scaled = (dense - model["mean"]) / model["spread"]
                for name, (a, b, c) in model["heads"].items():
                    z = scaled @ a + np.bincount(owner, b[column], rows) + c
                    out[name][row:row + rows] = np.where(np.diff(at) > 0, z, np.nan)
        return pa.StructArray.from_arrays([pa.array(v, pa.float64(), mask=np.isnan(v)) for v in out.values()], names=list(out))

    return score


def _strength(rates: DataFrame, rate: str, n: str):
    """Documents that the prior of these sites counts as, by the moments of their rates."""
    m, v, noise = rates.where(F.col(n) > 0).agg(
        F.avg(rate), F.var_pop(rate), F.avg(F.col(rate) * (1 - F.col(rate)) / F.col(n))).first()
    if m is None or not 0 < m < 1:
        return PRIOR_RANGE[1]
    between = max((v or 0.0) - (noise or 0.0), 1e-9)
    return min(PRIOR_RANGE[1], max(PRIOR_RANGE[0], m * (1 - m) / between - 1))


def _log_odds(p):
    return F.log(p / (1 - p))


def _sigmoid(z):
    return F.when(z.isNotNull(), 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0)))))


def assess(docs: DataFrame, labels: DataFrame, model: dict | None) -> DataFrame:
    """``doc_id, host, path, text_score, site_score, quality_score, toxic_score, keep`` of rows ``doc_id, text, host,
    path``. Held-out labels are not read."""
    spark = docs.sparkSession
    rows = cut_lineage(docs.select("doc_id", "host", "path", evidence(spark, model)(F.col("text")).alias("e")).select(
        "doc_id", "host", "path", F.col("e.quality").alias("z"), F.col("e.toxic").alias("toxic_z")))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        "doc_id").agg(F.max("quality").cast("double").alias("label"))
    p = F.coalesce("label", _sigmoid(F.col("z")))
    weight = F.when(F.col("label").isNotNull(), 1.0).when(F.col("z").isNotNull(), SOFT_WEIGHT).otherwise(0.0)
    counted = rows.join(known, "doc_id", "left").groupBy("host", "path").agg(
        F.sum(weight).alias("n"), F.sum(weight * F.coalesce(p, F.lit(0.0))).alias("g"))
    paths = cut_lineage(counted.withColumn("rate", F.col("g") / F.when(F.col("n") > 0, F.col("n"))))
    hosts = cut_lineage(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("g").alias("hg")).withColumn(
        "rate", F.col("hg") / F.when(F.col("hn") > 0, F.col("hn"))))
    n, g = hosts.agg(F.sum("hn"), F.sum("hg")).first()
    overall = min(0.999, max(0.001, g / n)) if n else 0.5
    strong = _strength(hosts, "rate", "hn")
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("hg") + strong * overall) / (F.col("hn") + strong)).alias("host_rate"))
    strong_path = _strength(paths, "rate", "n")
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select(
        F.col("host").alias("h"), F.col("path").alias("q"),
        ((F.col("g") + strong_path * F.col("host_rate")) / (F.col("n") + strong_path)).alias("site"))
    scored = rows.join(sized(sites, "h"), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    base = float(np.log(overall / (1 - overall)))
    total = F.coalesce("z", F.lit(base)) + _log_odds(F.col("site")) - F.lit(base)
    return scored.select(
        "doc_id", "host", "path", _sigmoid(F.col("z")).alias("text_score"), F.col("site").alias("site_score"),
        _sigmoid(total).alias("quality_score"), F.coalesce(_sigmoid(F.col("toxic_z")), F.lit(0.0)).alias("toxic_score")).withColumn(
        "keep", (F.col("quality_score") >= KEEP) & (F.col("toxic_score") < TOXIC))


def sited(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """``docs`` with host and path: of the page whose URL names the document, else its source and language."""
    host, path = host_and_path(F.col("url"))
    number = F.regexp_extract(path, "([0-9]+)", 1).try_cast("bigint")
    at = pages.select(number.alias("doc_id"), host.alias("h"), F.concat(F.lit("/"), F.regexp_extract(path, "^/([^/]*)/", 1)).alias("p"))
    at = at.where("doc_id is not null").groupBy("doc_id").agg(F.min("h").alias("h"), F.min("p").alias("p"))
    return docs.join(sized(at, "h"), "doc_id", "left").select(
        "doc_id", "text", F.coalesce("h", F.col("source")).alias("host"), F.coalesce("p", F.col("lang")).alias("path"))


@query("op5_hierarchical_bayes_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = assess(sited(docs.select("doc_id", "text", "source", "lang"), table(spark, sf_dir, "pages")), labels,
                   fit(docs, labels))
    return found.withColumn("held_out", held_out(F.col("doc_id")))
