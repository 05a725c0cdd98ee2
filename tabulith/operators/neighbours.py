"""Local outlier factor (Breunig et al. 2000), exact, without comparing all pairs.

Equal points are counted together. A kd-tree in two levels sends every point to one leaf: the upper tree is cut on the
driver from a sample of constant size; an upper leaf that holds too many points gets a sub-tree, cut from a sample of its own points
in a task of its own and kept as a row of a table, and (leaf, sub-leaf) is the key from there on. The neighbours inside a leaf
bound the distance to the k-th neighbour, and only leaves that this ball touches are searched as well. Points of a large upper
leaf are placed, and leaves that many balls touch searched, in several tasks.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.functions.columns import number
from tabulith.functions.kinds import numeric_columns, require_numeric
from tabulith.operators.moments import quantiles
from tabulith.session import cut_lineage, lookup

LEAF_ROWS = 2_000
UPPER_LEAVES = 4_096         # of the tree that is broadcast, cut from 16 sampled points each
_SPLIT = 4                   # an upper leaf of more than so many times LEAF_ROWS gets a sub-tree
_SAMPLE_PER_LEAF = 16
_QUERIES_PER_TASK = 50_000
_MOST_TASKS = 10_000         # of one search; a task takes several leaves then
_BLOCK = 256

_NEAR = "id long, other long, dist double, weight long"
_EMPTY = pd.DataFrame({"id": np.empty(0, "int64"), "other": np.empty(0, "int64"), "dist": np.empty(0), "weight": np.empty(0, "int64")})


def _leaf_tree(sample: np.ndarray, leaves: int) -> dict[str, np.ndarray]:
    """Median splits along the widest side, stopped at ``leaves`` leaves. Plain arrays indexed by
    node: feature (-1 in a leaf), cut, the two children and the corners of the box."""
    dims = sample.shape[1]
    feature, cuts, child = [-1], [0.0], [(0, 0)]
    boxes = [(np.full(dims, -np.inf), np.full(dims, np.inf))]
    todo = [(0, sample, leaves)]
    while todo:
        at, rows, want = todo.pop()
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(dims)
        f = int(np.argmax(spread))
        if want <= 1 or len(rows) < 4 or spread[f] == 0:
            continue
        cut = float(np.median(rows[:, f]))
        if cut >= rows[:, f].max():  # most rows share the largest value
            cut = float(np.unique(rows[:, f])[-2])
        below = rows[:, f] <= cut
        feature[at], cuts[at], child[at] = f, cut, (len(feature), len(feature) + 1)
        lo, hi = boxes[at]
        for part, share, is_low in ((rows[below], want // 2, True), (rows[~below], want - want // 2, False)):
            corner_lo, corner_hi = lo.copy(), hi.copy()
            (corner_hi if is_low else corner_lo)[f] = cut
            todo.append((len(feature), part, share))
            feature.append(-1)
            cuts.append(0.0)
            child.append((0, 0))
            boxes.append((corner_lo, corner_hi))
    return {"feature": np.array(feature), "cut": np.array(cuts), "child": np.array(child),
            "lo": np.array([b[0] for b in boxes]), "hi": np.array([b[1] for b in boxes])}


def _leaf_of(tree: dict, x: np.ndarray) -> np.ndarray:
    feature, cut, child = tree["feature"], tree["cut"], tree["child"]
    at = np.zeros(len(x), dtype=np.int64)
    rows = np.arange(len(x))
    while len(rows):
        rows = rows[feature[at[rows]] >= 0]
        here = at[rows]
        above = x[rows, feature[here]] > cut[here]
        at[rows] = child[here, above.astype(np.int64)]
    return at


def _touched(tree: dict, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every leaf whose box comes within ``radius`` of the row's point."""
    feature, cut, child = tree["feature"], tree["cut"], tree["child"]
    wide = radius * (1 + 1e-9) + 1e-12  # so that rounding never loses a leaf
    rows, at = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    out_rows, out_leaves = [], []
    while len(rows):
        done = feature[at] < 0
        r, leaf = rows[done], at[done]
        outside = np.maximum(np.maximum(tree["lo"][leaf] - x[r], x[r] - tree["hi"][leaf]), 0.0)
        close = np.sqrt((outside ** 2).sum(axis=1)) <= wide[r]
        out_rows.append(r[close])
        out_leaves.append(leaf[close])
        rows, at = rows[~done], at[~done]
        side = x[rows, feature[at]] - cut[at]
        low, high = side <= wide[rows], side >= -wide[rows]
        rows, at = (np.concatenate([rows[low], rows[high]]),
                    np.concatenate([child[at[low], 0], child[at[high], 1]]))
    return np.concatenate(out_rows), np.concatenate(out_leaves)


def _nearest(query: np.ndarray, query_id: np.ndarray, points: np.ndarray, point_id: np.ndarray,
             weight: np.ndarray, k: int, bound: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """The k nearest other points of each query row, block by block; with ``bound`` only those
    that are no further away."""
    for start in range(0, len(query), _BLOCK):
        q, qid = query[start:start + _BLOCK], query_id[start:start + _BLOCK]
        dist = np.sqrt(((q[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
        dist[qid[:, None] == point_id[None, :]] = np.inf
        take = min(k, dist.shape[1])
        cols = np.argpartition(dist, take - 1, axis=1)[:, :take]
        found = np.take_along_axis(dist, cols, axis=1)
        keep = np.isfinite(found)
        if bound is not None:
            keep &= found <= bound[start:start + _BLOCK, None] * (1 + 1e-9) + 1e-12
        r, c = np.nonzero(keep)
        yield pd.DataFrame({"id": qid[r], "other": point_id[cols[r, c]], "dist": found[r, c],
                            "weight": weight[cols[r, c]]})


def _within(query: np.ndarray, query_id: np.ndarray, points: np.ndarray, point_id: np.ndarray, weight: np.ndarray, k: int,
            leaf_rows: int, bound: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """``_nearest`` in one leaf. A leaf of many points gets a tree of its own, so that the work does not grow with the
    square of its size; without ``bound`` the queries are the points themselves."""
    if len(points) <= 2 * leaf_rows:
        yield from _nearest(query, query_id, points, point_id, weight, k, bound)
        return
    tree = _leaf_tree(points, math.ceil(len(points) / leaf_rows))
    at = _leaf_of(tree, points)
    order = np.argsort(at, kind="stable")
    leaves, starts = np.unique(at[order], return_index=True)
    members = dict(zip(leaves.tolist(), np.split(order, starts[1:])))
    if bound is None:
        # neighbours in the own small leaf bound the search of the others
        bound = np.full(len(query), np.inf)
        place = np.argsort(query_id)
        for own in members.values():
            for found in _nearest(query[own], query_id[own], points[own], point_id[own], weight[own], k):
                far = found.groupby("id")["dist"].agg(["max", "count"])
                rows = place[np.searchsorted(query_id, far.index.to_numpy(), sorter=place)]
                bound[rows] = np.where(far["count"] >= k, far["max"], np.inf)
    rows, found = _touched(tree, query, bound)
    order = np.argsort(found, kind="stable")
    leaves, starts = np.unique(found[order], return_index=True)
    for leaf, group in zip(leaves.tolist(), np.split(rows[order], starts[1:])):
        own = members.get(leaf)
        if own is not None:
            yield from _nearest(query[group], query_id[group], points[own], point_id[own], weight[own], k, bound[group])


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64") if len(column) else np.zeros((0, dims))


def _dealt(rows: DataFrame, keys: Sequence[str], other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with a ``part``: the rows of a key are dealt over as many parts as its ``_QUERIES_PER_TASK`` rows fill, and the
    rows of ``other`` go to every part of their key. Keys without rows are left out."""
    loads = lookup(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / _QUERIES_PER_TASK).alias("tasks")))
    dealt = rows.join(loads, list(keys)).withColumn("part", F.pmod(F.xxhash64("id"), F.col("tasks"))).drop("tasks")
    copied = (other.join(loads, list(keys))
              .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1))).drop("tasks"))
    return dealt, copied


def _sub_trees(placed: DataFrame, full: DataFrame, dims: int, leaf_rows: int) -> DataFrame:
    """leaf, tree: a sub-tree for every upper leaf in ``full`` (leaf, n), each from a sample of its points, in parallel."""
    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = _leaf_tree(_matrix(pdf["vec"], dims), math.ceil(int(pdf["n"].iloc[0]) / leaf_rows))
        return pd.DataFrame({"leaf": [key[0]], "tree": [pickle.dumps(tree)]})

    share = min(1.0, _SAMPLE_PER_LEAF / leaf_rows)
    sample = placed.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return cut_lineage(sample.join(lookup(full), "leaf").select("leaf", "vec", "n").groupBy("leaf").applyInPandas(build, "leaf long, tree binary"))


def _with_sub_leaves(points: DataFrame, trees: DataFrame, dims: int) -> DataFrame:
    """(id, leaf, cell) of the points in upper leaves that have a sub-tree."""
    def place(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        sub = _leaf_of(pickle.loads(t["tree"].iloc[0]), _matrix(p["vec"], dims)) if len(p) else np.empty(0, np.int64)
        return pd.DataFrame({"id": p["id"], "cell": (p["leaf"].to_numpy() << 32) | sub})

    asked, trees = _dealt(points, ["leaf"], trees)
    key = ["leaf", "part"]
    return asked.groupBy(*key).cogroup(trees.groupBy(*key)).applyInPandas(place, "id long, cell long")


def _touched_sub_leaves(visits: DataFrame, trees: DataFrame, dims: int) -> DataFrame:
    """(id, vec, radius, cell) for every sub-leaf that a ball touches in an upper leaf that has a sub-tree."""
    def touch(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out = [q.iloc[:0].assign(cell=np.empty(0, np.int64))]
        tree = pickle.loads(t["tree"].iloc[0]) if len(q) else None
        for start in range(0, len(q), _BLOCK):
            block = q.iloc[start:start + _BLOCK]
            rows, sub = _touched(tree, _matrix(block["vec"], dims), block["radius"].to_numpy())
            out.append(block.iloc[rows].assign(cell=(block["leaf"].to_numpy()[rows] << 32) | sub))
        return pd.concat(out)[["id", "vec", "radius", "cell"]]

    asked, trees = _dealt(visits, ["leaf"], trees)
    key = ["leaf", "part"]
    return asked.groupBy(*key).cogroup(trees.groupBy(*key)).applyInPandas(touch, "id long, vec array<double>, radius double, cell long")


def _neighbour_candidates(points: DataFrame, dims: int, k: int, leaf_rows: int) -> DataFrame:
    """Per point at least its k nearest other points: id, other, dist, weight."""
    spark = points.sparkSession
    n = points.count()
    leaves = max(1, min(UPPER_LEAVES, math.ceil(n / leaf_rows)))
    share = min(1.0, _SAMPLE_PER_LEAF * leaves / n)
    sample = points.select("vec") if share >= 1.0 else points.select("vec").sample(share, seed=1)
    tree = spark.sparkContext.broadcast(_leaf_tree(_matrix(sample.toPandas()["vec"], dims), leaves))

    @F.pandas_udf("long")
    def leaf(vec: pd.Series) -> pd.Series:
        return pd.Series(_leaf_of(tree.value, _matrix(vec, dims)))

    placed = cut_lineage(points.withColumn("leaf", leaf("vec")))
    full = cut_lineage(placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _SPLIT * leaf_rows))
    deep = not full.isEmpty()
    plain = F.shiftleft("leaf", 32)
    if deep:
        trees = _sub_trees(placed, full, dims, leaf_rows)
        split = lookup(trees.select("leaf"))
        below = _with_sub_leaves(placed.join(split, "leaf", "left_semi"), trees, dims)
        placed = cut_lineage(placed.join(below, "id", "left").withColumn("cell", F.coalesce("cell", plain)).drop("leaf"))
    else:
        placed = placed.withColumn("cell", plain).drop("leaf")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = _matrix(pdf["vec"], dims), pdf["id"].to_numpy()
        return pd.concat([_EMPTY, *_within(x, ids, x, ids, pdf["m"].to_numpy(), k, leaf_rows)], ignore_index=True)

    # small in bytes but heavy to compute: a fixed number of tasks keeps leaves from being merged into a few; a task takes the
    # rows of a leaf of full size, so small leaves share one, and starting tasks does not outweigh their work
    tasks = min(_MOST_TASKS, math.ceil(n / max(leaf_rows, LEAF_ROWS)))
    own = placed.repartition(tasks, "cell").groupBy("cell").applyInPandas(inside, _NEAR)
    if leaves == 1 and not deep:
        return own
    own = cut_lineage(own)

    # a point with copies has them at distance 0, so they use up part of the k places
    ahead = W.partitionBy("id").orderBy("dist", "other").rowsBetween(W.unboundedPreceding, 0)
    reach = (own.withColumn("upto", F.sum("weight").over(ahead)).join(placed.select("id", "m"), "id")
             .where(F.col("upto") + F.col("m") - 1 >= k).groupBy("id").agg(F.min("dist").alias("reach")))
    searching = placed.join(reach, "id", "left")
    # copies alone fill all places: nothing further is needed
    radius = F.when(F.col("m") > k, 0.0).otherwise(F.coalesce("reach", F.lit(float("inf"))))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), _BLOCK):
                part = pdf.iloc[start:start + _BLOCK]
                rows, found = _touched(tree.value, _matrix(part["vec"], dims), part["radius"].to_numpy())
                yield part.iloc[rows].assign(leaf=found)[["id", "vec", "radius", "own", "leaf"]]

    touched = (searching.select("id", "vec", radius.alias("radius"), F.col("cell").alias("own")).where("radius > 0")
               .mapInPandas(visits, "id long, vec array<double>, radius double, own long, leaf long"))
    if deep:
        touched = cut_lineage(touched)
        below = _touched_sub_leaves(touched.join(split, "leaf", "left_semi").select("id", "vec", "radius", "leaf"), trees, dims)
        above = touched.join(split, "leaf", "left_anti").select("id", "vec", "radius", plain.alias("cell"))
        mine = placed.select("id", F.col("cell").alias("own"))
        queries = above.unionByName(below).join(mine, "id").where("cell <> own").drop("own")
    else:
        queries = touched.withColumn("cell", plain).where("cell <> own").select("id", "vec", "radius", "cell")
    asked, answering = _dealt(cut_lineage(queries), ["cell"], placed.select("id", "vec", "m", "cell"))

    def across(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if q.empty or p.empty:
            return pd.DataFrame({"id": [], "other": [], "dist": [], "weight": []})
        return pd.concat([_EMPTY, *_within(_matrix(q["vec"], dims), q["id"].to_numpy(), _matrix(p["vec"], dims), p["id"].to_numpy(),
                                           p["m"].to_numpy(), k, leaf_rows, q["radius"].to_numpy())], ignore_index=True)

    task = ["cell", "part"]
    asked, answering = asked.repartition(tasks, *task), answering.repartition(tasks, *task)
    other = asked.groupBy(*task).cogroup(answering.groupBy(*task)).applyInPandas(across, _NEAR)
    return own.unionByName(other)


def lof(df: DataFrame, columns: Sequence[str] | None = None, contamination: float = 0.05,
        n_neighbors: int = 20, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Adds ``lof_score`` (negative outlier factor) and ``is_anomaly`` (the lowest ``contamination``
    share); rows with a gap get no score. Empty when there are too few complete rows."""
    names = list(columns or numeric_columns(df))
    if not names:
        raise ValueError("the table has no numeric column")
    require_numeric(df, *names)
    nothing = F.lit(None).cast("double")
    whole = reduce(Column.__and__, [number(c).isNotNull() for c in names])
    complete = df.where(whole)
    scale = complete.agg(F.count(F.lit(1)), *[F.avg(number(c)) for c in names],
                         *[F.stddev_pop(number(c)) for c in names]).first()
    n, means, devs = scale[0], scale[1:1 + len(names)], scale[1 + len(names):]
    if n < max(n_neighbors + 1, 10):
        return df.withColumns({"lof_score": nothing, "is_anomaly": F.lit(False)}).where(F.lit(False))
    k = min(n_neighbors, n - 1)
    # adding 0.0 makes -0.0 and 0.0 the same point
    z = [(number(c) - F.lit(m)) / F.lit(d or 1.0) + F.lit(0.0) for c, m, d in zip(names, means, devs)]
    rows = df.withColumn("vec", F.when(whole, F.array(*z)))

    points = rows.where("vec IS NOT NULL").groupBy("vec").agg(F.count(F.lit(1)).alias("m"))
    points = cut_lineage(points.withColumn("id", F.monotonically_increasing_id()))
    near = _neighbour_candidates(points, len(names), k, leaf_rows)
    copies = points.where("m > 1").select("id", F.col("id").alias("other"), F.lit(0.0).alias("dist"),
                                          (F.col("m") - 1).alias("weight"))
    ahead = W.partitionBy("id").orderBy("dist", "other").rowsBetween(W.unboundedPreceding, -1)
    near = (near.unionByName(copies).withColumn("before", F.coalesce(F.sum("weight").over(ahead), F.lit(0)))
            .where(F.col("before") < k)
            .select("id", "other", "dist", F.least("weight", F.lit(k) - F.col("before")).alias("w")))
    near = cut_lineage(near)

    mean_of = lambda value: F.sum(F.col("w") * value) / F.sum("w")
    reach = near.groupBy("id").agg(F.max("dist").alias("kdist")).withColumnRenamed("id", "other")
    density = (near.join(reach, "other").groupBy("id")
               .agg((1.0 / (mean_of(F.greatest("dist", "kdist")) + 1e-10)).alias("lrd")))
    around = density.select(F.col("id").alias("other"), F.col("lrd").alias("other_lrd"))
    factors = (near.join(around, "other").groupBy("id").agg(mean_of(F.col("other_lrd")).alias("mean_lrd"))
               .join(density, "id").select("id", (-F.col("mean_lrd") / F.col("lrd")).alias("lof_score")))
    scores = cut_lineage(points.join(factors, "id").select("vec", "m", "lof_score"))
    cut = quantiles(scores, ["lof_score"], [contamination], weight="m").first()["q"][0]
    return (rows.join(scores.drop("m"), "vec", "left")
            .withColumn("is_anomaly", F.coalesce(F.col("lof_score") < F.lit(cut), F.lit(False)))
            .select(*df.columns, "lof_score", "is_anomaly"))
