"""Joins with normalized keys, match statistics, key detection and column matching."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.functions.columns import half_even, strip
from tabulith.functions.kinds import is_numeric, is_text, require_columns
from tabulith.operators.profiling import distinct_counts, null_counts
from tabulith.operators.sorting import first_rows
from tabulith.session import cut_lineage

# Name parts that mark a key column; the first hit is reported.
KEY_WORDS = ("id", "key", "code", "number", "no", "num", "pk", "uuid", "ref", "reference", "index", "identifier")
JOIN_TYPES = ("left", "right", "inner", "outer")
MIN_NAME_SIMILARITY = 0.3
HOT_PERCENT = 5  # of a side's rows, from which a key is hot
PAIRS_PER_TASK = 2_000_000  # of rows whose missing keys match each other
PIECE_ROWS = 256  # of the smaller side, whose rows come again and again: a column file keeps their values in codes of a byte at most
_MOST_TASKS = 10_000
_BITS = 62  # columns per mask


def join_key(df: DataFrame, column: str) -> Column:
    """Text keys compare stripped and in lower case."""
    return F.lower(strip(F.col(column))) if is_text(df, column) else F.col(column)


def _check(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "left") -> None:
    require_columns(left, left_on)
    require_columns(right, right_on)
    if how not in JOIN_TYPES:
        raise ValueError(f"unknown join type {how!r}; use one of {JOIN_TYPES}")
    if is_text(left, left_on) != is_text(right, right_on):
        raise ValueError(f"cannot join text with another type: {left_on!r}, {right_on!r}")


def _has_hot_key(df: DataFrame, key: str) -> bool:
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    most, rows = counts.agg(F.max("n"), F.sum("n")).first()
    return bool(rows) and most * 100 > rows * HOT_PERCENT


def _missing_pairs(a: DataFrame, b: DataFrame, rows_a: int, rows_b: int) -> DataFrame:
    """All pairs of two sides' rows: a one-key join would make them in one task. Both sides are dealt once, into parts that every
    part of the other side is met with in a task of its own; nothing is broadcast or copied on disk. A task goes through a small piece of
    ``b`` for each row of its part of ``a``: written, ``a``'s columns are runs and ``b``'s repeat within a compressed page, where all of
    ``b`` in every task fills dictionaries and repeats too far apart to be compressed."""
    tasks = min(_MOST_TASKS, -(-rows_a * rows_b // PAIRS_PER_TASK))
    pieces = min(_MOST_TASKS, -(-rows_b // PIECE_ROWS))
    parts = max(1, min(rows_a, tasks // pieces))
    return a.repartition(parts).crossJoin(b.repartition(pieces).hint("shuffle_replicate_nl"))


def smart_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "left",
               null_match: bool = False, split_sides: bool | None = None) -> DataFrame:
    """Equi-join keeping both key columns; names the right side shares get ``_joined``.

    ``null_match`` lets missing keys match each other: where both sides have some, their pairs are made apart from the join
    of the other rows, in as many tasks as their number asks for. Hot keys are split by the adaptive skew
    join, which cannot split the optional side of an outer join. So joins that keep a side are built as an inner
    join and an anti join (``split_sides``), by default where one key has more than ``HOT_PERCENT`` of the optional side's
    rows, which a count of that side's keys tells. A plain join reads both sides once, so ``split_sides=False`` is cheaper
    where no key is known to be hot.
    """
    _check(left, right, left_on, right_on, how)
    a = left.withColumn("_lk", join_key(left, left_on))
    names = {c: f"{c}_joined" if c in left.columns else c for c in right.columns}
    b = right.select(*[F.col(c).alias(n) for c, n in names.items()], join_key(right, right_on).alias("_rk"))
    same = F.col("_lk") == F.col("_rk")
    columns = [*left.columns, *names.values()]
    if null_match:
        gaps_a, gaps_b = a.where(F.col("_lk").isNull()), b.where(F.col("_rk").isNull())
        rows_a, rows_b = gaps_a.count(), gaps_b.count()
        if rows_a and rows_b:
            # every row without a key has a partner, so no kind of join adds rows to these pairs
            pairs = (_missing_pairs(gaps_a, gaps_b, rows_a, rows_b) if rows_a >= rows_b else
                     _missing_pairs(gaps_b, gaps_a, rows_b, rows_a)).select(*columns)
            present = smart_join(left.where(join_key(left, left_on).isNotNull()), right.where(join_key(right, right_on).isNotNull()),
                                 left_on, right_on, how, split_sides=split_sides)
            return present.unionByName(pairs)

    def without(rows: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
        # only distinct keys of the other side matter
        return rows.join(other.select(other_key).distinct(), same, "left_anti")

    if how == "inner":
        return a.join(b, same, "inner").select(*columns)
    if split_sides is None:
        split_sides = (how != "right" and _has_hot_key(b, "_rk")) or (how != "left" and _has_hot_key(a, "_lk"))
    if split_sides:
        found = a.join(b, same, "inner").select(*columns)
        if how != "right":
            found = found.unionByName(without(a, "_lk", b, "_rk").drop("_lk"), allowMissingColumns=True)
        if how != "left":
            found = found.unionByName(without(b, "_rk", a, "_lk").drop("_rk"), allowMissingColumns=True)
        return found.select(*columns)
    return a.join(b, same, how).select(*columns)


def _key_counts(left: DataFrame, right: DataFrame, left_on: str, right_on: str, null_match: bool) -> DataFrame:
    """One row per key: n1 rows on the left, n2 on the right. Statistics follow from these counts,
    so the joined rows are never built for them."""
    a = left.select(join_key(left, left_on).alias("k1")).groupBy("k1").agg(F.count(F.lit(1)).alias("n1"))
    b = right.select(join_key(right, right_on).alias("k2")).groupBy("k2").agg(F.count(F.lit(1)).alias("n2"))
    same = F.col("k1").eqNullSafe(F.col("k2")) if null_match else F.col("k1") == F.col("k2")
    return a.join(b, same, "full").withColumns({"n1": F.coalesce("n1", F.lit(0)), "n2": F.coalesce("n2", F.lit(0))})


def _rate(part: Column, whole: Column) -> Column:
    return half_even(part / F.greatest(whole, F.lit(1)) * 100.0, 1)


def join_stats(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "left",
               null_match: bool = False) -> DataFrame:
    """Row counts and match rates of a join, in one row. ``left_matched`` counts joined rows, so a
    one-to-many join can exceed 100 %; rows on the right count as unmatched only when kept."""
    _check(left, right, left_on, right_on, how)
    n1, n2 = F.col("n1"), F.col("n2")
    sums = _key_counts(left, right, left_on, right_on, null_match).agg(
        F.coalesce(F.sum("n1"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("n2"), F.lit(0)).alias("right_rows"),
        F.coalesce(F.sum(n1 * n2), F.lit(0)).alias("left_matched"),
        F.coalesce(F.sum(F.when(n2 == 0, n1)), F.lit(0)).alias("_l"),
        F.coalesce(F.sum(F.when(n1 == 0, n2)), F.lit(0)).alias("_r"))
    only_left = F.col("_l") if how in ("left", "outer") else F.lit(0).cast("long")
    only_right = F.col("_r") if how in ("right", "outer") else F.lit(0).cast("long")
    merged = F.col("left_matched") + only_left + only_right
    right_matched = F.col("right_rows") - only_right
    return sums.select(
        F.lit(how).alias("join_type"), "left_rows", "right_rows", merged.alias("merged_rows"), "left_matched",
        only_left.alias("left_unmatched"), right_matched.alias("right_matched"), only_right.alias("right_unmatched"),
        _rate(F.col("left_matched"), F.col("left_rows")).alias("match_rate_left"),
        _rate(right_matched, F.col("right_rows")).alias("match_rate_right"),
        F.lit(len(right.columns)).alias("new_columns"))


def join_quality(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
                 null_match: bool = False) -> DataFrame:
    """Score and label from the joined rows, and the share of each side's rows that find a partner."""
    _check(left, right, left_on, right_on)
    n1, n2 = F.col("n1"), F.col("n2")
    sums = _key_counts(left, right, left_on, right_on, null_match).agg(
        F.coalesce(F.sum(n1 * n2), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum("n1"), F.lit(0)).alias("l"), F.coalesce(F.sum("n2"), F.lit(0)).alias("r"),
        F.coalesce(F.sum(F.when(n2 > 0, n1)), F.lit(0)).alias("lm"),
        F.coalesce(F.sum(F.when(n1 > 0, n2)), F.lit(0)).alias("rm"))
    score = _rate(F.col("pairs"), F.col("l"))
    label = (F.when(score > 90, "Excellent Match").when(score > 70, "Good Match")
             .when(score > 50, "Partial Match").otherwise("Poor Match"))
    return sums.select(score.alias("quality_score"), label.alias("quality_label"),
                       _rate(F.col("lm"), F.col("l")).alias("distinct_match_rate_left"),
                       _rate(F.col("rm"), F.col("r")).alias("distinct_match_rate_right"))


def join_preview(left: DataFrame, right: DataFrame, left_on: str, right_on: str, n: int = 5) -> DataFrame:
    """Distinct keys by where they occur: status, total, and the first ``n`` keys of each status."""
    _check(left, right, left_on, right_on)
    keys = _key_counts(left, right, left_on, right_on, True).select(
        F.coalesce("k1", "k2").alias("key"),
        F.when((F.col("n1") > 0) & (F.col("n2") > 0), "matched").when(F.col("n1") > 0, "left_only")
        .otherwise("right_only").alias("status")).where("key IS NOT NULL")
    totals = keys.groupBy("status").agg(F.count(F.lit(1)).alias("total"))
    sample = first_rows(keys, ["key"], n, ["status"])
    return sample.join(F.broadcast(totals), "status").select("status", "total", F.col("key").cast("string").alias("key"))


def _plain_name(name: str) -> str:
    return name.lower().replace("_", "").replace(" ", "")


def detect_keys(df: DataFrame, approx: bool = False) -> DataFrame:
    """Likely key columns with score, reason and number of distinct values, best first."""
    hits = []
    for c in df.columns:
        word = next((w for w in KEY_WORDS if w in _plain_name(c)), None)
        hits.append(F.when(F.col("column") == c, F.lit(word)))
    share = F.col("unique") / F.greatest(F.col("rows"), F.lit(1))
    part = F.when(share > 0.5, F.format_string("%.0f%% unique values", share * 100))
    score = (F.when(F.col("word").isNotNull(), 30).otherwise(0)
             + F.when(share > 0.9, 40).when(share > 0.5, 20).otherwise(0)
             + F.when(F.col("missing") == 0, 10).otherwise(0)
             + F.when(F.col("unique") < F.col("rows") * 1.1, 5).otherwise(0))
    return (null_counts(df).join(distinct_counts(df, df.columns, approx), "column")
            .withColumn("word", F.coalesce(*hits)).withColumn("score", score).where("score >= 30")
            .select("column", "score", F.concat_ws(
                ", ", F.when(F.col("word").isNotNull(), F.concat(F.lit('name contains "'), "word", F.lit('"'))), part,
                F.when(F.col("missing") == 0, "no nulls")).alias("reason"),
                F.col("unique").alias("unique_values"))
            .orderBy(F.col("score").desc(), "column"))


def _as_text(df: DataFrame, column: str) -> Column:
    """Comparable text: whole numbers look the same whatever their type."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.try_cast("bigint").cast("string")).otherwise(c.cast("string"))
    if is_numeric(df, column):
        return c.cast("bigint").cast("string") if not isinstance(df.schema[column].dataType, T.DecimalType) else c.cast("string")
    return F.lower(strip(c.cast("string")))


def _marked_values(df: DataFrame, columns: Sequence[str], side: int) -> DataFrame:
    """Melted cells as text; ``_i`` is the position of the column on its side."""
    wide = df.select(*[_as_text(df, c).alias(str(i)) for i, c in enumerate(columns)])
    long = wide.unpivot([], wide.columns, "_i", "value").where("value IS NOT NULL")
    return long.select("value", F.lit(side).alias("_side"), F.col("_i").cast("int").alias("_i"))


def value_overlap(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Shared distinct values / the smaller number of distinct values, for all wanted column pairs
    at once: col1, col2, distinct1, distinct2, shared, overlap.

    One grouping by value marks, as bits, the columns of either side that hold it; the bits are
    combined before the shuffle, so repeated values cost nothing. Counting equal bit patterns then
    leaves a small table from which pairs and margins follow.
    """
    if pairs is None:
        pairs = [(a, b) for a in left.columns for b in right.columns]
    names = [list(dict.fromkeys(p[side] for p in pairs)) for side in (0, 1)]
    cells = _marked_values(left, names[0], 0).unionAll(_marked_values(right, names[1], 1))
    words = [(side, k) for side in (0, 1) for k in range(-(-len(names[side]) // _BITS))]
    masks = [F.expr(f"coalesce(bit_or(CASE WHEN _side = {side} AND _i div {_BITS} = {k} "
                    f"THEN shiftleft(1L, _i % {_BITS}) END), 0L)").alias(f"m{side}_{k}") for side, k in words]
    patterns = (cells.groupBy("value").agg(*masks)
                .groupBy(*[f"m{side}_{k}" for side, k in words]).agg(F.count(F.lit(1)).alias("k")))

    def holders(side: int) -> Column:
        """The columns of a side in the pattern, and null for "any column"."""
        found = [F.when(F.col(f"m{side}_{i // _BITS}").bitwiseAND(F.lit(1 << i % _BITS)) != 0, F.lit(c))
                 for i, c in enumerate(names[side])]
        return F.concat(F.array_compact(F.array(*found)), F.array(F.lit(None).cast("string")))

    counts = (patterns.select(F.explode(holders(0)).alias("a"), holders(1).alias("bs"), "k")
              .select("a", F.explode("bs").alias("b"), "k").groupBy("a", "b").agg(F.sum("k").alias("k")))
    counts = cut_lineage(counts)  # at most one row per pair of columns and per column
    wanted = left.sparkSession.createDataFrame(list(pairs), "col1 string, col2 string")
    shared = counts.where("a IS NOT NULL AND b IS NOT NULL").toDF("col1", "col2", "shared")
    d1 = counts.where("a IS NOT NULL AND b IS NULL").select(F.col("a").alias("col1"), F.col("k").alias("distinct1"))
    d2 = counts.where("a IS NULL AND b IS NOT NULL").select(F.col("b").alias("col2"), F.col("k").alias("distinct2"))
    out = (wanted.join(F.broadcast(shared), ["col1", "col2"], "left").join(F.broadcast(d1), "col1", "left")
           .join(F.broadcast(d2), "col2", "left").fillna(0, ["shared", "distinct1", "distinct2"]))
    smaller = F.least("distinct1", "distinct2")
    return out.select("col1", "col2", "distinct1", "distinct2", "shared",
                      F.coalesce(half_even(F.col("shared") / F.nullif(smaller, F.lit(0)), 3), F.lit(0.0)).alias("overlap"))


def name_similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio of the plain names."""
    return SequenceMatcher(None, _plain_name(a), _plain_name(b)).ratio()


def match_columns(left: DataFrame, right: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Best one-to-one matches by name and values: col1, col2, name_similarity, value_overlap,
    match_score. Names are schema; only values go through Spark, for the pairs worth a look."""
    similar = {(a, b): name_similarity(a, b) for a in left.columns for b in right.columns}
    near = {p: s for p, s in similar.items() if s >= MIN_NAME_SIMILARITY}
    compare = [p for p, s in near.items()
               if s > 0.5 or left.schema[p[0]].dataType == right.schema[p[1]].dataType]
    overlap = {}
    if compare:
        overlap = {(r["col1"], r["col2"]): r["overlap"] for r in value_overlap(left, right, compare).collect()}
    scored = [(a, b, s, overlap.get((a, b), 0.0)) for (a, b), s in near.items()]
    scored = [(a, b, s, v, 0.6 * s + 0.4 * v) for a, b, s, v in scored]
    good = [m for m in scored if m[4] > threshold or m[2] > 0.8 or m[3] > 0.7]
    good.sort(key=lambda m: (-round(m[4], 3), m[0], m[1]))
    chosen, used1, used2 = [], set(), set()
    for a, b, s, v, score in good:
        if a not in used1 and b not in used2:
            used1.add(a)
            used2.add(b)
            chosen.append((a, b, round(s, 3), round(v, 3), round(score, 3)))
    return left.sparkSession.createDataFrame(
        chosen, "col1 string, col2 string, name_similarity double, value_overlap double, match_score double")
