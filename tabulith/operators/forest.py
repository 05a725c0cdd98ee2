"""Isolation forest (Liu, Ting and Zhou 2008): small trees fitted in parallel, rows scored in place."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tabulith.functions.columns import number
from tabulith.functions.kinds import numeric_columns, present, require_numeric
from tabulith.operators.moments import quantiles
from tabulith.session import cut_lineage, lookup, written_once

TREES = 100
SUBSAMPLE = 256
SEED = 42
MIN_ROWS = 10

_TREE = ("tree int, feature array<int>, threshold array<double>, lower array<int>, upper array<int>, "
         "path array<double>")


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, list]:
    """One tree as parallel lists; a leaf has feature -1 and carries its path length."""
    nodes: dict[str, list] = {"feature": [], "threshold": [], "lower": [], "upper": [], "path": []}

    def add(**values) -> int:
        for name, column in nodes.items():
            column.append(values.get(name, -1 if name != "path" else 0.0))
        return len(nodes["path"]) - 1

    stack = [(x, 0, None, "")]
    while stack:
        rows, depth, parent, side = stack.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(open_features) == 0:
            at = add(threshold=0.0, path=depth + average_path(len(rows)))
        else:
            f = int(rng.choice(open_features))
            cut = float(rng.uniform(low[f], high[f]))
            at = add(feature=f, threshold=cut)
            below = rows[:, f] <= cut
            stack.append((rows[below], depth + 1, at, "lower"))
            stack.append((rows[~below], depth + 1, at, "upper"))
        if parent is not None:
            nodes[side][parent] = at
    return nodes


def _pool(data: DataFrame, columns: Sequence[str], share: float, seed: int) -> DataFrame:
    """About ``share`` of the rows with an ``_id``, drawn by their contents, so the same rows come back however the
    table is laid out. Copies of a row are counted, and the row is drawn about ``share`` times as often."""
    slots = float(1 << 31)
    content = F.xxhash64(*columns)
    draw = F.pmod(F.xxhash64("_h", F.lit(seed)), F.lit(1 << 31)) / slots
    picked = lookup(data.select(content.alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
                    .withColumn("_times", F.floor(F.col("_n") * F.lit(share) + draw).cast("int")).where("_times > 0").drop("_n"))
    found = (data.select(*columns, content.alias("_h")).join(picked, "_h").groupBy("_h", "_times", *columns).agg(F.count(F.lit(1))))
    copies = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return copies.select(*columns, F.xxhash64("_h", "_copy").alias("_id"))


def fit_forest(data: DataFrame, columns: Sequence[str], n: int, trees: int = TREES,
               seed: int = SEED) -> tuple[list, int]:
    """The trees (at most ``trees`` x 511 nodes) and the subsample size.

    Rows are first thinned to a pool of some ten thousand; every tree then draws its rows from the
    pool by a hash, so only a few hundred rows per tree are shuffled.
    """
    size = min(SUBSAMPLE, n)
    seen = Observation()
    pool = cut_lineage(_pool(data, columns, min(1.0, 1.2 * trees * SUBSAMPLE / n), seed).observe(seen, F.count(F.lit(1)).alias("n")))
    wanted = min(1.0, 1.5 * size / max(seen.get["n"], 1))
    slots = 1 << 31
    draws = (pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
             .withColumn("_draw", F.pmod(F.xxhash64("_id", "tree", F.lit(seed)), F.lit(slots)))
             .where(F.col("_draw") < int(wanted * slots)))
    names = list(columns)
    limit = _height(size)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # about 1.5 x 256 rows of one tree
        picked = pdf.sort_values(["_draw", "_id"]).head(size)
        rng = np.random.default_rng([seed, int(key[0])])
        nodes = _grow(picked[names].to_numpy(dtype="float64"), rng, limit)
        return pd.DataFrame({"tree": [int(key[0])], **{k: [v] for k, v in nodes.items()}})

    # a few hundred rows per tree would be merged into one task; the trees should grow side by side
    spread = draws.repartition(min(trees, data.sparkSession.sparkContext.defaultParallelism), "tree")
    return spread.groupBy("tree").applyInPandas(fit, _TREE).orderBy("tree").collect(), size


def _height(size: int) -> int:
    return max(1, math.ceil(math.log2(max(size, 2))))


def _flat(tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree in which leaves lead to themselves, so that every row takes the same number of steps:
    feature, threshold, child (two slots per node, upper and lower) and path length."""
    feature = np.asarray(tree["feature"])
    leaf, me = feature < 0, np.arange(len(feature))
    child = np.stack([np.where(leaf, me, tree["upper"]), np.where(leaf, me, tree["lower"])], axis=1)
    return (np.where(leaf, 0, feature), np.where(leaf, np.inf, tree["threshold"]), child.ravel(),
            np.asarray(tree["path"]))


def _scorer(spark, forest: list, size: int):
    """A vectorized function from feature columns to the score (the lower, the more unusual)."""
    trees = spark.sparkContext.broadcast([_flat(t) for t in forest])
    scale, height = average_path(size) or 1.0, _height(size)

    @F.pandas_udf("double")
    def score(features: pd.DataFrame) -> pd.Series:
        x = features.to_numpy(dtype="float64")
        cells, start = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        depth = np.zeros(len(x))
        for feature, threshold, child, path in trees.value:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(height):
                is_low = cells.take(start + feature.take(at)) <= threshold.take(at)
                at = child.take(2 * at + is_low)
            depth += path.take(at)
        return pd.Series(-np.exp2(-depth / len(trees.value) / scale))

    return score


def isolation_forest(df: DataFrame, columns: Sequence[str] | None = None, contamination: float = 0.05,
                     seed: int = SEED) -> DataFrame:
    """Adds ``anomaly_score`` (negative = anomaly) and ``is_anomaly``; rows with a gap get no score.
    Empty below 10 complete rows.

    Splits are drawn between the smallest and largest value of a column, so scaling the columns
    first would not change a tree.
    """
    names = list(columns or numeric_columns(df))
    if not names:
        raise ValueError("the table has no numeric column")
    require_numeric(df, *names)
    cells = {c: f"_f{i}" for i, c in enumerate(names)}
    wide = df.withColumns({alias: number(c) for c, alias in cells.items()})
    complete = wide.transform(present, *cells.values())
    nothing = F.lit(None).cast("double")
    pieces = complete.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    n, busy = pieces.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if n < MIN_ROWS:
        return df.withColumns({"anomaly_score": nothing, "is_anomaly": F.lit(False)}).where(F.lit(False))
    forest, size = fit_forest(complete, list(cells.values()), n, seed=seed)
    score = _scorer(df.sparkSession, forest, size)
    # a table in too few pieces is spread over the cores
    cores = df.sparkSession.sparkContext.defaultParallelism
    if busy < cores:
        complete = complete.repartition(cores)
    found = complete.withColumn("_s", score(F.struct(*cells.values())))
    # a row goes through the trees once; the cut point is counted from the written scores
    found = written_once(found.select(*df.columns, "_s"), "scored")
    cut = quantiles(found, ["_s"], [contamination]).first()["q"][0]
    out = found.withColumn("anomaly_score", F.col("_s") - F.lit(cut)).withColumn(
        "is_anomaly", F.col("anomaly_score") < 0).select(*df.columns, "anomaly_score", "is_anomaly")
    gaps = wide.where(" OR ".join(f"{c} IS NULL" for c in cells.values())).select(
        *df.columns, nothing.alias("anomaly_score"), F.lit(False).alias("is_anomaly"))
    return out.unionByName(gaps)
