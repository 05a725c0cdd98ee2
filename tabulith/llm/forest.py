"""Near-duplicate documents by an LSH forest.

Documents are sets of word shingles. A MinHash signature gives every document one label per tree, and each
tree is a sorted order of the labels. Neighbours in an order share the longest label prefixes, so a window
over it walks the tree: where documents are sparse it reaches down to the shortest allowed prefix, where they
are dense it stays among the deepest ones. Pairs in a window whose signatures agree enough are candidates, and
links are confirmed on the full sets. Direct neighbours are confirmed first; of the other candidates only those
between different components are left, so large groups of copies cost a few comparisons a document. Regions longer than
the window that are not one component then are compared by all pairs that share a rare shingle (``overlaps``), which is
exact: documents that share much text below the threshold do not hide their similar ones.

Documents with equal sets are one node from the start, so exact copies, however many, are never paired.

Null or word-free text is an empty set: it is linked with nothing. Rows that share a ``doc_id`` are one
document. A row without ``doc_id`` is linked with nothing, has no component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.session import cut_lineage

from . import words as W
from .components import components, sized
from .overlaps import prefix_links, undecided
from .registry import query, table

TREES = 10
DEPTH = 6
#: prefix that candidates share at least, following rows compared with each row of an order
MIN_PREFIX = 2
WINDOW = 16
#: share of equal signature values below which a pair is not confirmed; a pair at similarity 0.8 falls below
#: it once in about a million times
MIN_AGREEMENT = 0.55
#: rows of an order in one partition at least, so that a window spans two partitions at most
PARTITION_ROWS = 2000

_random = np.random.default_rng(20240229)
_FLIP = _random.integers(0, 1 << 32, TREES * DEPTH, np.uint64).astype(np.uint32)
_MULTIPLY = _random.integers(0, 1 << 32, TREES * DEPTH, np.uint64).astype(np.uint32) | np.uint32(1)


def _sets(texts: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, number of rows, distinct shingles, their offsets by row) of runs of rows."""
    for row, data, offsets in W.blocks(texts):
        values, first = W.distinct(*W.shingles(*W.word_hashes(data, offsets), shingle))
        yield row, len(offsets) - 1, values, first


def _signed(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, signatures = [], [], []
            for _, rows, values, first in _sets(batch.column(1), shingle):
                counts = np.diff(first)
                full = np.flatnonzero(counts)
                sizes.append(counts)
                key = np.zeros((rows, 2), np.uint64)
                marks = np.zeros((rows, TREES * DEPTH), np.uint16)
                if len(full):
                    at = first[full]
                    key[full, 0] = np.add.reduceat(W.mix(values ^ np.uint64(0x5BF03635)), at)
                    key[full, 1] = np.bitwise_xor.reduceat(values, at)
                    short = (values >> np.uint64(32)).astype(np.uint32)
                    for j in range(TREES * DEPTH):
                        low = np.minimum.reduceat((short ^ _FLIP[j]) * _MULTIPLY[j], at)
                        marks[full, j] = (low * np.uint32(0x9E3779B1)) >> np.uint32(16)
                keys += [k.tobytes() for k in key]
                signatures += [m.tobytes() for m in marks.astype(">u2")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(signatures, pa.binary())], names=["doc_id", "n_shingles", "set_key", "signature"])
    return run


def _candidates(tree: np.ndarray, size: np.ndarray, marks: np.ndarray, new: int, percent: int):
    """(i, j, distance) of candidate pairs among sorted rows, with j at or after row ``new``."""
    n, width = len(tree), marks.shape[1]
    own = marks[np.arange(n)[:, None], tree[:, None] * DEPTH + np.arange(MIN_PREFIX)]
    for step in range(1, min(WINDOW, n - 1) + 1):
        i = np.arange(max(0, new - step), n - step)
        i = i[(tree[i] == tree[i + step]) & (own[i] == own[i + step]).all(axis=1)]
        if not len(i):
            continue
        j = i + step
        low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        same = marks[i] == marks[j]
        fit = (100 * low >= percent * high) & (same.sum(axis=1) >= MIN_AGREEMENT * width)
        if step > 2:  # leave pairs that an earlier order has in one region to that order, or to the exact comparison of long regions
            heads = same.reshape(len(i), TREES, DEPTH)[:, :, :MIN_PREFIX].all(axis=2)
            fit &= heads.argmax(axis=1) == tree[i]
        yield i[fit], j[fit], step


_PAIRS = ("a long, b long, step int, edge int, place int, tree int, n long, doc long, signature binary")


def _columns(batch: pa.RecordBatch | pa.Table):
    marks = np.array([np.frombuffer(s, ">u2") for s in batch.column("signature").to_pylist()], np.uint16)
    return [batch.column(c).to_numpy() if isinstance(batch, pa.Table) else batch.column(c).to_numpy(zero_copy_only=False)
            for c in ("tree", "n", "doc")] + [marks.reshape(-1, TREES * DEPTH)]


def _found(doc: np.ndarray, pairs) -> pa.RecordBatch:
    parts = [(doc[i], doc[j], np.full(len(i), s, np.int32)) for i, j, s in pairs]
    a, b, s = (np.concatenate(x) if parts else np.empty(0, t) for x, t in zip(zip(*parts) if parts else ((),) * 3, (np.int64, np.int64, np.int32)))
    none = pa.nulls(len(a))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()), pa.array(s, pa.int32()),
         *(none.cast(t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
        names=["a", "b", "step", "edge", "place", "tree", "n", "doc", "signature"])


def _walk(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates inside a sorted partition, then its first and last rows for the borders."""
        part = TaskContext.get().partitionId()
        kept = head = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _columns(batch)
            if head is None or len(head[0]) < WINDOW:
                head = [np.concatenate(x)[:WINDOW] for x in zip(head, own)] if head else [x[:WINDOW] for x in own]
            rows = [np.concatenate(x) for x in zip(kept, own)] if kept else own
            yield _found(rows[2], _candidates(rows[0], rows[1], rows[3], len(kept[0]) if kept else 0, percent))
            kept = [x[-WINDOW:] for x in rows]
        for edge, rows in ((part - 1, head), (part, kept)):
            if rows is not None:
                tree, n, doc, marks = rows
                k = len(tree)
                none = pa.nulls(k)
                yield pa.RecordBatch.from_arrays(
                    [none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), pa.array([edge] * k, pa.int32()),
                     pa.array(np.arange(k) + (WINDOW if edge < part else 0), pa.int32()), pa.array(tree, pa.int32()),
                     pa.array(n, pa.int64()), pa.array(doc, pa.int64()),
                     pa.array([m.tobytes() for m in marks.astype(">u2")], pa.binary())],
                    names=["a", "b", "step", "edge", "place", "tree", "n", "doc", "signature"])
    return run


def _border(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        tree, n, doc, marks = _columns(rows)
        new = int((rows.column("place").to_numpy() < WINDOW).sum())
        pairs = [(i[k], j[k], s) for i, j, s in _candidates(tree, n, marks, new, percent) for k in [i < new]]
        return pa.Table.from_batches([_found(doc, pairs)]).select(["a", "b", "step"])
    return run


def candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """``a, b, step`` of rows ``doc, n, signature``: pairs worth confirming."""
    spark = nodes.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.count() * TREES // PARTITION_ROWS))
    label = F.substring("signature", F.col("tree") * F.lit(2 * DEPTH) + F.lit(1), F.lit(2 * DEPTH))
    order = (nodes.select("doc", "n", "signature", F.explode(F.lit(list(range(TREES)))).alias("tree"))
             .withColumn("label", label).repartitionByRange(parts, "tree", "label", "n", "doc")
             .sortWithinPartitions("tree", "label", "n", "doc").select("tree", "n", "doc", "signature"))
    found = cut_lineage(order.mapInArrow(_walk(percent), _PAIRS))
    borders = found.where("edge is not null").groupBy("edge").applyInArrow(_border(percent), "a long, b long, step int")
    return found.where("edge is null").select("a", "b", "step").union(borders).groupBy("a", "b").agg(
        F.min("step").alias("step"))


def crowded(nodes: DataFrame) -> DataFrame:
    """``key, id`` of the rows of regions that are longer than the window, so that it does not hold all their pairs."""
    head = F.substring("signature", F.col("tree") * F.lit(2 * DEPTH) + F.lit(1), F.lit(2 * MIN_PREFIX))
    rows = nodes.select(F.col("doc").alias("id"), "signature", F.explode(F.lit(list(range(TREES)))).alias("tree")).select(
        F.xxhash64("tree", head).alias("key"), "id")
    long_ = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > WINDOW + 1).select("key")
    return rows.join(sized(long_), "key")


def _set_items(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, rows, values, first in _sets(batch.column(1), shingle):
                items = pa.ListArray.from_arrays(pa.array(first - first[0], pa.int32()), pa.array(values[first[0]:first[-1]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(row, rows), items], names=["id", "items"])
    return run


def _set_bytes(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [values[first[k]:first[k + 1]].tobytes()
                   for _, rows, values, first in _sets(batch.column(1), shingle) for k in range(rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc", "items"])
    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    merged = np.concatenate((x, y))
                    merged.sort()
                    both = int((merged[1:] == merged[:-1]).sum())
                    keep[k] = 100 * both >= percent * (len(merged) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))
    return run


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets are similar enough. Only their texts are read and moved."""
    ids = sized(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = docs.join(ids, "doc_id", "left_semi").mapInArrow(_set_bytes(shingle), "doc long, items binary")
    right = pairs.select("a", "b").join(sets.withColumnsRenamed({"doc": "b", "items": "y"}), "b").select("a", "b", "y")
    both = right.join(sets.withColumnsRenamed({"doc": "a", "items": "x"}), "a").select("a", "b", "x", "y")
    return both.mapInArrow(_confirm(percent), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row, linked where the shingle sets of two documents
    have 100 * intersection >= ``percent`` * union."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = cut_lineage(docs.mapInArrow(
        _signed(shingle), "doc_id long, n_shingles long, set_key binary, signature binary"))
    nodes = cut_lineage(signed.where("n_shingles > 0 and doc_id is not null").groupBy(
        "set_key", F.col("n_shingles").alias("n"), "signature").agg(F.min("doc_id").alias("doc")))
    pairs = cut_lineage(candidates(nodes, percent))
    links = cut_lineage(confirmed(pairs.where("step = 1"), docs, shingle, percent).distinct())
    known = cut_lineage(components(links))
    rest = pairs.where("step > 1")
    for side in ("a", "b"):
        rest = rest.join(known.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
    rest = cut_lineage(rest.where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b"))
    more = confirmed(rest, docs, shingle, percent)
    whole = cut_lineage(components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)))
    open_ = undecided(crowded(nodes), whole)
    if not open_.isEmpty():
        sets = docs.join(sized(open_.select(F.col("id").alias("doc_id")).distinct()), "doc_id", "left_semi").mapInArrow(
            _set_items(shingle), "id long, items array<long>").where(F.size("items") > 0).distinct()
        last = cut_lineage(prefix_links(sets.join(sized(open_), "id").select("id", "part", "items"), percent,
                                        lambda pairs: confirmed(pairs, docs, shingle, percent)))
        if not last.isEmpty():
            whole = components(whole.select(F.col("node").alias("a"), F.col("component").alias("b")).union(last))
    members = nodes.select("set_key", "n", "doc").join(whole, F.col("doc") == F.col("node"), "left").select(
        "set_key", "n", F.coalesce("component", "doc").alias("found"))
    joined = signed.join(members, (signed.set_key == members.set_key) & (signed.n_shingles == members.n)
                         & signed.doc_id.isNotNull(), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


_SQL = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then []
    when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) end as s from words),
items as (select doc_id, unnest(s) as x from sets),
links as (
  select p.a, p.b from (select l.doc_id as a, r.doc_id as b, count(*) as n from items l join items r on l.x = r.x
    and l.doc_id < r.doc_id group by all) p join sets x on x.doc_id = p.a join sets y on y.doc_id = p.b
  where 100 * p.n >= 80 * (len(x.s) + len(y.s) - p.n)),
ways as (select a, b from links union select b, a from links),
reach as (select a as node, b as other from ways union select r.node, e.b from reach r join ways e on e.a = r.other)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, least(s.doc_id, coalesce(m.least, s.doc_id)) as component_id,
  s.doc_id = least(s.doc_id, coalesce(m.least, s.doc_id)) as kept
from sets s left join (select node, min(other) as least from reach group by node) m on m.node = s.doc_id
"""


@query("op2_lsh_forest_near_dedup", _SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
