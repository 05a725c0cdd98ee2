"""Exact top-k inner products with a pivot-distance index.

Vectors become integers, floor(scale * x). One more coordinate gives all of them the largest norm, so the largest
inner product with a query is the smallest distance to it. Each vector is keyed by its nearest pivot and the
distance to it, in rings around the pivot (annuli). A query first searches one block each of the ring that can hold the nearest
vectors and the next few; its k-th score there is a bound, and by the triangle inequality only rings closer than that bound are
searched afterwards, so the result is exact. Pivots are a bounded sample; every row is indexed.

Equal vectors are one entry with the k + 1 smallest ids: more cannot appear in a result. Vectors are kept in the
narrowest integers that hold all of them. Queries and rings are packed in blocks of bounded size. To its first ring a
query travels by a shuffle; then blocks of queries meet the blocks of rings that they have to visit in a Cartesian
product of partitions, which reads the blocks where they are written and writes no copies of them. No pairs of rows are made,
and the driver gets a number for each ring and the pivots only.

Rows with a null id, a null vector, or null or non-finite components take no part. Missing components of shorter
vectors count as 0. Rows that share an id are one row if their vectors are equal; a query is never its own answer.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tabulith.session import cut_lineage

from .registry import query, table

#: pivots grow with the square root of the rows up to a number that keeps the table of rings small
MAX_PIVOTS = 256
RINGS = 16
BLOCK_ROWS = 1024
BLOCK_QUERIES = 256
#: rings that give a query its bound
FIRST_RINGS = 8
#: results that a task keeps before it leaves out all but the best of each query
KEPT = 1 << 20
#: pairs of blocks for a task, tasks at most, and bytes of queries that a task holds
BLOCK_PAIRS, MOST_TASKS, HELD_BYTES = 256, 10_000, 16 << 20
#: slack for rounding of distances, as a part of the largest norm
SLACK = 1e-9


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating point where every partial sum is below 2**24 or 2**53."""
    most = x.shape[1] * float(abs(x).max()) * float(abs(y).max()) if x.size and y.size else 0.0
    kind = np.float32 if most < 2 ** 24 else np.float64 if most < 2 ** 53 else np.int64
    return x.astype(kind) @ y.astype(kind).T


def _usable(batch: pa.RecordBatch, scale: float) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The rows that take part: ids, sizes of the vectors, and all their components as integers."""
    ids, vectors = batch.columns
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    good = ids.is_valid().to_numpy(zero_copy_only=False) & vectors.is_valid().to_numpy(zero_copy_only=False)
    good[np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(flat)]] = False
    return ids.filter(pa.array(good)), sizes[good], np.floor(scale * flat[np.repeat(good, sizes)]).astype("<i8")


def _extent(scale: float):
    """The longest vector and the largest component of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, sizes, flat = _usable(batch, scale)
            if len(sizes):
                most = max(int(flat.max()), -int(flat.min())) if len(flat) else 0
                yield pa.RecordBatch.from_arrays([pa.array([int(sizes.max())], pa.int32()), pa.array([float(most)], pa.float64())], names=["width", "most"])
    return run


def _integers(scale: float, kind: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, flat = _usable(batch, scale)
            full = np.zeros((len(sizes), width), kind)
            full[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            norms = np.einsum("ij,ij->i", full.astype(np.float64), full.astype(np.float64))
            yield pa.RecordBatch.from_arrays([ids, pa.array([v.tobytes() for v in full], pa.binary()), pa.array(norms, pa.float64())],
                                             names=["vec_id", "vector", "norm"])
    return run


def _keyed(pivots: np.ndarray, largest: float, kind: str):
    """The nearest pivot and the distance to it, in the space where all norms are the largest."""
    norms = (pivots.astype(np.float64) ** 2).sum(axis=1)
    lift = np.sqrt(np.maximum(0, largest - norms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), kind, pivots.shape[1]).astype(np.float64)
                own = (x ** 2).sum(axis=1)
                up = np.sqrt(np.maximum(0, largest - own))
                squares = own[:, None] + norms - 2 * x @ pivots.T.astype(np.float64) + (up[:, None] - lift) ** 2
                near = squares.argmin(axis=1)
                distance = np.sqrt(np.maximum(0, squares[np.arange(len(x)), near]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(distance, pa.float64())],
                    names=["vector", "ids", "pivot", "distance"])
    return run


def _block(rows: pa.Table) -> pa.Table:
    rows = rows.combine_chunks()
    ids = rows.column("ids").to_pylist()
    return pa.table({
        "ring": rows.column("ring").slice(0, 1), "part": rows.column("part").slice(0, 1),
        "vectors": pa.array([b"".join(rows.column("vector").to_pylist())], pa.binary()),
        "ids": pa.array([ids], pa.list_(pa.list_(pa.int64())))})


def _query_block(rows: pa.Table) -> pa.Table:
    return pa.table({"ids": pa.array([rows.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                     "vectors": pa.array([b"".join(rows.column("vector").to_pylist())], pa.binary()),
                     "floors": pa.array([rows.column("floor").to_pylist()], pa.list_(pa.int64()))})


class _Rings:
    """Bounds of the distance between queries and what a ring holds. ``rings``: ring, pivot, least and largest distance to it."""

    def __init__(self, pivots: np.ndarray, largest: float, rings: list):
        self.pivots, self.largest = pivots.astype(np.float64), largest
        self.ring, self.pivot, self.low, self.high = (np.array(x) for x in zip(*rings))

    def bounds(self, y: np.ndarray, only: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query and ring (or one only): the distance is at least so large; that of the pivot."""
        rings = slice(None) if only is None else slice(only, only + 1)
        of, pivot = (self.pivots, self.pivot) if only is None else (self.pivots[self.pivot[rings]], np.zeros(1, int))
        to_pivot = np.sqrt(np.maximum(0, (y ** 2).sum(axis=1)[:, None] + self.largest - 2 * y @ of.T))[:, pivot]
        return np.maximum(0, np.maximum(to_pivot - self.high[rings], self.low[rings] - to_pivot)), to_pivot

    def reach(self, y: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """The largest distance at which something could still belong to a query's result."""
        return np.sqrt(np.maximum(0, (y ** 2).sum(axis=1) + self.largest - 2 * floors.astype(np.float64))) + SLACK * np.sqrt(self.largest)


def _first_visits(rings: _Rings, kind: str):
    """The first rings of each query: those of the smallest bounds, around the nearest pivots among equal ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors, floors in zip(*(batch.column(c).to_pylist() for c in ("ids", "vectors", "floors"))):
                x = np.frombuffer(vectors, kind).reshape(len(ids), -1)
                bound, to_pivot = rings.bounds(x.astype(np.float64))
                near = np.lexsort((to_pivot, bound), axis=1)[:, :FIRST_RINGS]
                out = []
                for r in np.unique(near):
                    k = np.flatnonzero((near == r).any(axis=1))
                    out.append((int(rings.ring[r]), [ids[i] for i in k], x[k].tobytes(), [floors[i] for i in k]))
                a, b, c, d = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int32()), pa.array(b, pa.list_(pa.int64())), pa.array(c, pa.binary()),
                     pa.array(d, pa.list_(pa.int64()))], names=["ring", "query_ids", "queries", "floors"])
    return run


def _marked(rings: _Rings, kind: str):
    """Blocks of queries with a byte for each ring that tells whether one of them has to visit it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for ids, vectors, floors in zip(*(batch.column(c) for c in ("ids", "vectors", "floors"))):
                y = np.frombuffer(vectors.as_buffer(), kind).reshape(len(ids), -1).astype(np.float64)
                visit = np.zeros(int(rings.ring.max()) + 1, np.uint8)
                visit[rings.ring] = (rings.bounds(y)[0] <= rings.reach(y, floors.values.to_numpy())[:, None]).any(axis=0)
                marks.append(visit.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("ids", "vectors", "floors")), pa.array(marks, pa.binary())],
                                             names=["query_ids", "queries", "floors", "visit"])
    return run


def _best(query: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each query, by score and then by ``vec``; those of a query stand together."""
    order = np.lexsort((vec, -score, query))
    first = np.concatenate(([True], query[order][1:] != query[order][:-1])) if len(order) else np.zeros(0, bool)
    begin = np.flatnonzero(first)[np.cumsum(first) - 1]
    return order[np.arange(len(order)) - begin < k]


def _merged(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best results of each query; equal ones are one."""
    rows = np.unique(np.stack([np.concatenate(c) for c in zip(*found)], axis=1), axis=0)
    query, vec, score = rows[_best(rows[:, 0], rows[:, 2], rows[:, 1], k)].T
    return query, vec, score


def _search(k: int, kind: str, width: int, rings: _Rings | None):
    """The best entries for each query, with all ids that could be in the result. ``rings`` leaves out queries of a block that need
    not visit the ring."""
    def block(ring, ids, vectors, query_ids, queries, floors) -> tuple[np.ndarray, ...] | None:
        x, floor = np.frombuffer(queries.as_buffer(), kind).reshape(-1, width), floors.values.to_numpy()
        some = np.arange(len(x))
        if rings is not None:
            y, r = x.astype(np.float64), int(np.searchsorted(rings.ring, ring.as_py()))
            some = np.flatnonzero(rings.bounds(y, r)[0][:, 0] <= rings.reach(y, floor))
        scores = _product(x[some], np.frombuffer(vectors.as_buffer(), kind).reshape(-1, width))
        edge = {"f4": 1 << 24, "f8": 1 << 53}.get(scores.dtype.str[1:], 1 << 62)  # all scores are within it
        hits = scores >= np.clip(floor[some], -edge, edge).astype(scores.dtype)[:, None]
        many = np.flatnonzero(hits.sum(axis=1) > 4 * k)
        if len(many):  # one more than k, as one of them may be the query
            hits[many] &= scores[many] >= np.partition(scores[many], scores.shape[1] - k - 1, axis=1)[:, -k - 1, None]
        q, at = np.nonzero(hits)
        if not len(q):
            return None
        score, held = scores[q, at].astype(np.int64), ids.values
        flat, begin = held.flatten().to_numpy(), np.concatenate(([0], np.cumsum(held.value_lengths().to_numpy())))
        few = _best(q, score, flat[begin[at]], k + 1)
        q, at, score = q[few], at[few], score[few]
        n = begin[at + 1] - begin[at]
        vec = flat[np.arange(n.sum()) + np.repeat(begin[at] - np.cumsum(n) + n, n)]
        q, score = np.repeat(q, n), np.repeat(score, n)
        query = query_ids.values.to_numpy()[some][q]
        other = vec != query
        few = np.flatnonzero(other)[_best(q[other], score[other], vec[other], k)]
        return query[few], vec[few], score[few]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("ring", "ids", "vectors", "query_ids", "queries", "floors"))):
                found = block(*row)
                if found is not None:
                    kept.append(found)
                    n += len(found[0])
                    if n > KEPT:
                        kept = [_merged(kept, k)]
                        n = len(kept[0][0])
                        if n > KEPT // 2:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept[0]], names=_FOUND)
                            kept, n = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _merged(kept, k)], names=_FOUND)
    return run


_FOUND = ["query_id", "vec_id", "score"]
_VISIT = "ring int, query_ids array<long>, queries binary, floors array<long>"
_MARKED = "query_ids array<long>, queries binary, floors array<long>, visit binary"
_LOWEST = -(1 << 62)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, key: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best other rows for every row where ``is_query`` (a condition on
    ``vec_id``) holds."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    given = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    width, most = given.mapInArrow(_extent(scale), "width int, most double").agg(F.max("width"), F.max("most")).first()
    if not width:
        return spark.createDataFrame([], schema)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    norms, number = Observation(), Observation()
    rows = cut_lineage(given.mapInArrow(_integers(scale, kind, width), "vec_id long, vector binary, norm double").observe(
        norms, F.max("norm").alias("largest")))
    largest = norms.get["largest"] or 1.0
    same = Window.partitionBy("vector").orderBy("vec_id")
    entries = cut_lineage(rows.select("vector", "vec_id").withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
                          .groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).observe(number, F.count("*").alias("n")))
    n_pivots = int(min(MAX_PIVOTS, max(4, number.get["n"] ** 0.5 / 16)))
    # a hash is all that each task sends of its candidates
    drawn = F.xxhash64("vector")
    hashes = [r[0] for r in entries.select(drawn.alias("h")).orderBy("h").limit(n_pivots).collect()]
    chosen = entries.where(drawn.isin(hashes)).select(drawn.alias("h"), "vector").collect()
    pivots = np.array([np.frombuffer(v, kind) for _, v in sorted((h, bytes(v)) for h, v in chosen)[:n_pivots]])
    keyed = cut_lineage(entries.select("vector", "ids").mapInArrow(
        _keyed(pivots, largest, kind), "vector binary, ids array<long>, pivot int, distance double"))
    limits = keyed.groupBy("pivot").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"))
    slot = F.least(F.lit(RINGS - 1), F.floor((F.col("distance") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)) * RINGS)).cast("int")
    ringed = keyed.join(F.broadcast(limits), "pivot").withColumn("ring", F.col("pivot") * RINGS + slot)
    rings = ringed.groupBy("ring", "pivot").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n"))
    known = sorted(tuple(r) for r in rings.collect())  # pivots times rings at most
    parts = F.broadcast(rings.select("ring", F.ceil(F.col("n") / BLOCK_ROWS).alias("parts")))
    queries = rows.where(is_query(F.col("vec_id"))).select("vec_id", "vector").distinct()
    n_queries = queries.count()
    n_blocks, n_held = max(1, -(-n_queries // BLOCK_QUERIES)), sum(-(-r[4] // BLOCK_ROWS) for r in known)
    bounds = _Rings(pivots, largest, [r[:4] for r in known])
    # bytes of all queries with their marks, parts of them, and parts of the blocks of rings
    size = n_queries * (np.dtype(kind).itemsize * width + 16) + n_blocks * MAX_PIVOTS * RINGS
    query_parts = min(n_blocks, -(-size // HELD_BYTES))
    ring_parts = min(n_held, max(1, min(MOST_TASKS, n_held * n_blocks // BLOCK_PAIRS) // query_parts))
    blocks = cut_lineage(ringed.join(parts, "ring").withColumn("part", F.pmod(F.xxhash64("vector"), F.col("parts")).cast("int"))
                         .select("ring", "part", "vector", "ids").groupBy("ring", "part")
                         .applyInArrow(_block, "ring int, part int, vectors binary, ids array<array<long>>").repartition(ring_parts))

    def packed(searched: DataFrame) -> DataFrame:
        return searched.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("b")).applyInArrow(
            _query_block, "ids array<long>, vectors binary, floors array<long>")

    def best(met: DataFrame, rings: _Rings | None) -> DataFrame:
        found = met.select("ring", "ids", "vectors", "query_ids", "queries", "floors").mapInArrow(
            _search(k, kind, width, rings), "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # the bound comes from one block of each first ring; visits are more than their input's size tells, so no broadcast
    visits = packed(queries.withColumn("floor", F.lit(_LOWEST))).mapInArrow(_first_visits(bounds, kind), _VISIT)
    opened = best(visits.hint("merge").join(blocks.where("part = 0"), "ring"), None)
    floors = opened.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    closer = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(_LOWEST)))
    marked = cut_lineage(packed(closer).mapInArrow(_marked(bounds, kind), _MARKED).repartition(query_parts))
    must = F.substring("visit", F.col("ring") + 1, F.lit(1)) == F.lit(b"\x01")
    return best(blocks.join(marked.hint("shuffle_replicate_nl"), must), bounds).select("query_id", "rank", "vec_id", "score")


_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""


@query("op6_pivot_distance_top_k", _SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda v: v % 50 == 0)
