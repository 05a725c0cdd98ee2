"""Connected components of a link table by alternating stars, in DataFrame joins and aggregates.

Every round links each node's larger neighbours, then its smaller ones, to the smallest node it knows. The
rounds end when nothing changes; then every node is linked to the smallest node of its component. No links
reach the driver, a node with very many links is pre-aggregated, and its join is split by the adaptive planner. Few links take
few tasks, however many partitions the session has: each task of each shuffle would leave files behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tabulith.session import cut_lineage

#: bytes of a table that may be broadcast, counted at 32 a row besides its wide column
BROADCAST_BYTES = 32 << 20
#: links for each task of a round, and tasks in any case
LINKS, TASKS = 10_000, 8


def sized(rows: DataFrame, wide: str | Column | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A table of ids, and of one ``wide`` text or binary column (or the number of bytes of what is wide), for a join:
    broadcast up to ``limit`` bytes, else left to a shuffle."""
    width = F.octet_length(wide) if isinstance(wide, str) else F.lit(0) if wide is None else wide
    size = F.lit(32) + F.coalesce(width, F.lit(0))
    seen = Observation()
    fixed = cut_lineage(rows.observe(seen, F.sum(size).alias("bytes")))
    return F.broadcast(fixed) if (seen.get["bytes"] or 0) <= limit else fixed


def _fixed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The links, written, with their number and a digest, gathered by the same job."""
    seen = Observation()
    fixed = cut_lineage(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("digest")))
    return fixed, (seen.get["n"], seen.get["digest"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` of every node that has a link to another one; ``component`` is the smallest node."""
    edges, state = _fixed(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while state[0]:
        tasks = max(TASKS, state[0] // LINKS)
        edges = edges.coalesce(tasks)
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        large = both.join(least, F.col("u") == F.col("n")).where("v > u").select(
            F.col("v").alias("u"), F.least("m", F.col("n")).alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("n")).select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges, now = _fixed(small.coalesce(tasks).distinct().coalesce(tasks))
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
