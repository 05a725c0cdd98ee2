"""Exact candidates for similar sets in crowded groups, by prefixes of rare items, in DataFrame functions.

Items are ordered from rare to frequent. Two sets whose common part must be ``o`` items large have their first common
item among the first ``size - o + 1`` of each, so only these are joined: what all members of a crowded group share comes
last in their orders and is not joined, and no pair that is similar enough is missed. Of what meets, pairs are left out whose
sketches, the parities of the items in each of ``64 * WORDS`` slots, differ in more slots than two such sets have items of only one.

In groups of up to ``GROUP`` sets no items are joined or shuffled: all pairs are compared by sketches of all their items (``group_pairs``).

Where many sets share an item, each is compared first with one of them alone, drawn anew for every item. What is confirmed of that makes
parts one, so that a set that is similar to all members of a large part is not met with each of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.session import cut_lineage

from .components import components, sized

#: words of 64 bits of a sketch
WORDS = 12
#: pairs that are met at once, without making parts one first: in proportion to the rows of the prefixes, and in any case
ALL_PAIRS, FEW = 8, 10_000_000
#: members of a key of which all pairs of sketches are compared
GROUP = 256


def _open(members: DataFrame, groups: DataFrame) -> DataFrame:
    parts = cut_lineage(members.join(groups.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("part")))
    open_ = parts.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("members")).where("lo <> hi")
    return parts.join(sized(open_.select("key", "members")), "key")


def undecided(members: DataFrame, groups: DataFrame) -> DataFrame:
    """``id, part`` of the members (``key, id``) of keys that are not within one component of ``groups`` yet."""
    return cut_lineage(_open(members, groups).select("id", "part").distinct())


def undecided_keys(members: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same, apart: ``key, id, part`` of keys with up to ``GROUP`` members, and ``id, part`` of those with more."""
    open_ = cut_lineage(_open(members, groups))
    few = F.col("members") <= GROUP
    return open_.where(few).select("key", "id", "part"), open_.where(~few).select("id", "part").distinct()


def _parities() -> Column:
    """The sketch of a group's rows of ``item``."""
    slot = F.pmod(F.xxhash64("item"), F.lit(64 * WORDS)).cast("int")
    return F.array(*(F.bit_xor(F.when(F.floor(slot / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), slot % 64)).otherwise(
        F.lit(0).cast("long"))) for w in range(WORDS)))


def sketched(sets: DataFrame) -> DataFrame:
    """``id, n, sketch`` of rows ``id, items``: their number and a sketch of all of them."""
    rows = sets.select("id", F.size("items").alias("n"), F.explode("items").alias("item")).groupBy("id", "n").agg(_parities().alias("sketch"))
    return sized(rows, F.lit(8 * WORDS))


def _near(percent: int) -> Column:
    """Whether rows ``x`` and ``y`` of ``sketched`` can be of sets with that similarity."""
    differ = sum((F.bit_count(F.col("sketch_x")[w].bitwiseXOR(F.col("sketch_y")[w])) for w in range(WORDS)), F.lit(0))
    return (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent) & (
        differ * (100 + percent) <= (F.col("n_x") + F.col("n_y")) * (100 - percent))


def near_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that can have that similarity, by their sketches."""
    x, y = (sketches.toDF(id_, f"n_{k}", f"sketch_{k}") for id_, k in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").where(_near(percent)).select("a", "b")


def group_pairs(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a < b`` of ids in different parts that share a key, among them all whose Jaccard similarity is at least ``percent``, of
    members ``key, id, part``."""
    rows = members.join(sketches, "id")
    x, y = (rows.select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "part", "n", "sketch"))) for k in "xy")
    return _pairs(x.join(y, (x["key"] == y["key"]) & (x["id_x"] < y["id_y"]) & (x["part_x"] != y["part_y"]) & _near(percent)))


def _heads(sets: DataFrame, percent: int) -> DataFrame:
    """``id, part, n, alone, sketch, at, item``: the prefixes of the sets, without the items of one set only."""
    # what is exploded and shuffled is two numbers an item
    fixed = cut_lineage(sets.select(F.xxhash64("id", "items").alias("row"), "id", "part", F.size("items").alias("n"), "items"))
    items = fixed.select("row", F.explode("items").alias("item"))
    counts = cut_lineage(items.groupBy("item").agg(F.count("*").alias("rows")).where("rows > 1"))
    # items of one set only are its rarest, and make no pair: their number is enough
    found = items.join(counts, "item").groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("rows", "item"))).alias("found"), _parities().alias("sketch"))
    shared = fixed.select("row", "id", "part", "n").distinct().join(found, "row")
    probe = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    alone = F.col("n") - F.size("found")
    heads = shared.where(probe > alone).select("id", "part", "n", "sketch", alone.alias("alone"), F.posexplode(F.slice("found", 1, probe - alone)).alias("i", "head"))
    return cut_lineage(heads.select(
        "id", "part", "n", "alone", "sketch", (F.col("alone") + F.col("i") + 1).alias("at"), F.col("head.item").alias("item")))


def _side(heads: DataFrame, k: str) -> DataFrame:
    return heads.select("item", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "part", "n", "at", "alone", "sketch")))


def _alike(percent: int) -> Column:
    """Whether two rows of a join on an item, of different parts, can be of sets with that similarity by sizes and sketches."""
    low, high = F.least("n_x", "n_y"), F.greatest("n_x", "n_y")
    # items of one set only that two sets with that common part may have, by the sizes alone
    spare = F.col("n_x") + F.col("n_y") - 2 * F.ceil((F.col("n_x") + F.col("n_y")) * percent / (100 + percent))
    differ = sum((F.bit_count(F.col("sketch_x")[w].bitwiseXOR(F.col("sketch_y")[w])) for w in range(WORDS)), F.col("alone_x") + F.col("alone_y"))
    return (F.col("part_x") != F.col("part_y")) & (F.col("id_x") != F.col("id_y")) & (low * 100 >= high * percent) & (differ <= spare)


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def _all_pairs(heads: DataFrame, percent: int) -> DataFrame:
    # the smaller set of a pair needs a common part of more than ``percent`` of itself, so a shorter prefix
    short = heads.where((F.col("n") - F.col("at") + 1) * (100 + percent) >= F.col("n") * 2 * percent)
    x, y = _side(short, "x"), _side(heads, "y")
    reach = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) + 1
    return _pairs(x.join(y, (x["item"] == y["item"]) & _alike(percent)
                         & ((F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("id_x") < F.col("id_y"))))
                         & (reach * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent)))


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a < b`` of ids in different parts, among them all whose Jaccard similarity is at least ``percent``, of rows
    ``id, part, items``; ``items`` are distinct."""
    return _all_pairs(_heads(sets, percent), percent)


def _drawn_pairs(heads: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a < b`` of every set and one set of each of its items, which a hash of both draws: a row of ``heads`` makes one at most."""
    draw = F.xxhash64("id", "item")
    drawn = heads.groupBy("item").agg(F.count("*").alias("sets"), F.min(draw).alias("draw")).where("sets > 3").select("item", "draw")
    one = heads.join(drawn, "item").where(draw == F.col("draw")).dropDuplicates(["item"])
    x, y = _side(one, "x"), _side(heads, "y")
    return _pairs(x.join(y, (x["item"] == y["item"]) & _alike(percent)))


def prefix_links(sets: DataFrame, percent: int, confirm: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs ``a, b`` that ``confirm`` keeps, of rows as for ``prefix_pairs``: they connect all parts that are connected by similar pairs,
    but are not all of these."""
    heads = _heads(sets, percent)
    met = heads.groupBy("item", "part").agg(F.count("*").cast("double").alias("n")).groupBy("item").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own")).agg(
        F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.sum("n")).first()
    if (met[0] or 0) <= max(ALL_PAIRS * (met[1] or 0), FEW):
        return confirm(cut_lineage(_all_pairs(heads, percent)))
    first = cut_lineage(confirm(cut_lineage(_drawn_pairs(heads, percent))))
    own = sized(heads.select("id", "part").distinct())
    links = first.join(own.toDF("a", "u"), "a").join(own.toDF("b", "v"), "b").select("u", "v")
    now = sized(components(links, "u", "v").toDF("part", "component"))
    merged = heads.join(now, "part", "left").withColumn("part", F.coalesce("component", "part")).select(heads.columns)
    return first.union(confirm(cut_lineage(_all_pairs(merged, percent))))
