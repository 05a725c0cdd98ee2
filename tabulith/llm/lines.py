"""Fuzzy line deduplication by MinHash, with DataFrame functions only.

Lines are compared in lower case without outer white space, as sets of character shingles. One aggregate over all
shingles of all lines gives every distinct line and its signature of ``HASHES`` minima; equal lines meet there, so a
line that fills a third of the corpus is one row. Bands of four minima, or of four maxima, each propose candidates: all
pairs of buckets with two or three lines, and in larger buckets a star to the smallest and one to the largest line.
Candidates are confirmed by the exact Jaccard similarity of their shingle sets. The lines of larger buckets that the stars
do not make one component are compared again: by sketches of all pairs of a bucket, or, where a bucket is crowded, by all pairs
that share a rare shingle. Both are exact (``overlaps``).
Connected lines are one component, of which the first occurrence (by ``doc_id``, then line) stays; all others are dropped.

Minima alone miss a pair at similarity 0.8 in about one case of 20 and at 0.9 in one of 250, and maxima again; a pair that
both miss stays apart, about one of 400 at 0.8. Blank lines are never dropped. Null text has no lines. Rows without a ``doc_id``
keep all lines and take no part; repeated rows are one document.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.session import cut_lineage

from .components import components, sized
from .overlaps import group_pairs, near_pairs, prefix_links, sketched, undecided_keys
from .registry import query, table

SHINGLE, PERCENT = 8, 80
HASHES = 8
#: any different numbers: a hash after a flip of bits is a hash function of its own
_FLIPS = tuple(j * 0x12345679 & 0x7FFFFFFF for j in range(HASHES))
#: the 14 sets of four minima of which no two share three (the planes of the affine geometry of eight points): any five
#: equal minima contain one
BANDS = tuple(band for band in combinations(range(HASHES), 4) if band[0] ^ band[1] ^ band[2] ^ band[3] == 0)


def _form(line: Column) -> Column:
    return F.lower(F.trim(line))


def occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, version, line_no, line, h, h2``: all lines that are not blank; ``version`` tells rows with the same
    ``doc_id`` and different texts apart."""
    rows = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    lines = rows.where(F.trim("raw") != "").withColumn("line", _form(F.col("raw")))
    return lines.select("doc_id", "version", "line_no", "line", F.xxhash64("line").alias("h"),
                        F.xxhash64("line", F.lit("second")).alias("h2"))


def signatures(lines: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``id, h, h2, n, m0.., x0..`` of every distinct line: the number of occurrences, the minima and the maxima. An ``id`` is a small
    number, which costs a shuffle less than a hash; it holds for rows that are kept."""
    # two bytes a character, so a shingle is cut out without walking the line
    wide = lines.select("h", "h2", F.encode("line", "UTF-16BE").alias("wide"))
    last = F.greatest(F.lit(0), (F.octet_length("wide") / 2).cast("int") - shingle)
    cut = F.col("wide").substr(F.col("i") * 2 + 1, F.lit(2 * shingle))
    shingles = wide.select("h", "h2", "wide", F.explode(F.sequence(F.lit(0), last)).alias("i")).select(
        "h", "h2", "i", F.hash(cut).alias("s"))
    mixed = [F.hash(F.col("s").bitwiseXOR(F.lit(c))) for c in _FLIPS]
    return shingles.groupBy("h", "h2").agg(
        F.count(F.when(F.col("i") == 0, 1)).alias("n"), *(F.min(x).alias(f"m{j}") for j, x in enumerate(mixed)),
        *(F.max(x).alias(f"x{j}") for j, x in enumerate(mixed))).withColumn("id", F.monotonically_increasing_id())


def _banded(known: DataFrame) -> DataFrame:
    keys = [F.xxhash64(F.lit(f"{end}{k}"), *(F.col(f"{end}{j}") for j in band)) for end in "mx" for k, band in enumerate(BANDS)]
    # 48 bits tell bands apart well enough: what meets by chance is not confirmed
    return known.select("id", F.explode(F.array(*(k.bitwiseAND(F.lit(-1 << 16)) for k in keys))).alias("band"))


def proposed(known: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Pairs ``a < b`` of distinct lines that share a band, and the members ``key, id`` of buckets of which these are not
    all pairs, if there are any."""
    # nearly all bands are of one line, so counting them before the shuffle would only make its rows longer
    buckets = cut_lineage(_banded(known).repartition("band").groupBy("band").agg(
        F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor("id").alias("x"), F.count("*").alias("n")).where("n > 1"))
    third = F.col("lo").bitwiseXOR(F.col("hi")).bitwiseXOR(F.col("x"))
    ends = buckets.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    three = buckets.where("n = 3").select("lo", third.alias("mid"), "hi")
    pairs = ends.union(three.select("lo", "mid")).union(three.select("mid", "hi"))
    large = buckets.where("n > 3").select("band", "lo", "hi")
    members = None
    if not large.isEmpty():
        members = cut_lineage(_banded(known).join(sized(large), "band"))
        pairs = pairs.union(members.select("lo", "id")).union(members.select("id", "hi"))
        members = members.select(F.col("band").alias("key"), "id")
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), members


def candidates(known: DataFrame) -> DataFrame:
    """The first pairs to confirm."""
    return proposed(known)[0]


def _shingles(line: Column, shingle: int) -> Column:
    """Hashes of the distinct shingles; a shorter line is its only one."""
    found = F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{shingle}}}))"), F.lit(1))
    hashes = F.array_distinct(F.transform(found, lambda s: F.xxhash64(s)))
    return F.when(F.length(line) < shingle, F.array(F.xxhash64(line))).otherwise(hashes)


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs whose exact Jaccard similarity is at least ``percent``, by the lines ``id, line``."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    # a generator's input is computed once a row; a projection's would be again for each use
    sets = both.select("a", "b", F.explode(F.array(F.struct(
        _shingles(F.col("x"), shingle).alias("x"), _shingles(F.col("y"), shingle).alias("y")))).alias("s"))
    common = sets.select("a", "b", F.explode(F.array(F.struct(
        F.size(F.array_intersect("s.x", "s.y")).alias("n"), (F.size("s.x") + F.size("s.y")).alias("m")))).alias("c")).select("a", "b", "c.*")
    return common.where(F.col("n") * 100 >= (F.col("m") - F.col("n")) * percent).select("a", "b")


def linked(lines: DataFrame, known: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``node, component`` of the ``id`` of distinct lines that are similar to others."""
    pairs, members = proposed(known)
    pairs = cut_lineage(pairs)
    # every line compared is in one of these pairs; it is looked up once
    ids = known.select("id", "h", "h2").join(sized(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "id")
    texts = cut_lineage(lines.select("h", "h2", "line").join(sized(ids), ["h", "h2"]).select("id", "line").distinct())
    similar = lambda pairs: confirmed(pairs, texts, shingle, percent)
    # as above: an array exploded is computed once
    sets = lambda rows: rows.select(
        *(c for c in rows.columns if c != "line"), F.explode(F.array(_shingles(F.col("line"), shingle))).alias("items"))
    sketches = sketched(sets(texts))
    groups = components(similar(cut_lineage(near_pairs(pairs, sketches, percent))))
    if members is None:
        return groups
    groups = cut_lineage(groups)
    few, many = undecided_keys(members, groups)
    links = cut_lineage(similar(cut_lineage(group_pairs(few, sketches, percent))))
    if not many.isEmpty():
        links = links.union(cut_lineage(prefix_links(sets(texts.join(sized(many), "id")), percent, similar)))
    if links.isEmpty():
        return groups
    return components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def line_classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, version, line_no, class, dropped`` of every occurrence of a line that occurs again, as it is or nearly;
    ``class`` is shared by all of them."""
    lines = occurrences(docs)
    known = cut_lineage(signatures(lines, shingle))
    groups = linked(lines, known, shingle, percent).withColumnRenamed("node", "id")
    again = known.select("id", "h", "h2", "n").join(sized(groups), "id", "left").where("n > 1 or component is not null").select(
        "h", "h2", F.coalesce("component", "id").alias("class"))
    found = cut_lineage(lines.join(sized(again), ["h", "h2"]).select("doc_id", "version", "line_no", "class"))
    # the smallest document first, by a plain minimum; then the first line in it
    smallest = sized(found.groupBy("class").agg(F.min("doc_id").alias("doc_id")))
    first = found.join(smallest, ["class", "doc_id"]).groupBy("class").agg(
        F.min(F.struct("doc_id", "version", "line_no")).alias("first"))
    here = F.struct("doc_id", "version", "line_no")
    return found.join(sized(first), "class").select(
        "doc_id", "version", "line_no", "class", (here != F.col("first")).alias("dropped"))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with ``text`` without its dropped lines, and ``dropped_lines``, their numbers from 0."""
    drops = line_classes(docs, shingle, percent).where("dropped").groupBy("doc_id", "version").agg(
        F.array_sort(F.collect_set("line_no")).alias("lines")).select(
        F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("lines").alias("__lines"))
    kept = [c for c in docs.columns if c.lower() not in ("dropped_lines", "__id", "__version", "__lines")]
    rows = docs.select(*kept).join(sized(drops, F.size("__lines") * 4), (F.col("doc_id") == F.col("__id"))
                                   & (F.xxhash64("text") == F.col("__version")), "left")
    # '1' at the places of dropped lines; two linear passes, however many lines there are
    gap = F.transform("__lines", lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.coalesce(F.get("__lines", i - 1), F.lit(-1)) - 1), F.lit("1")))
    mask = F.array_join(gap, "").cast("binary")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: F.col("__mask").substr(i + 1, F.lit(1)) != F.lit(b"1")), "\n")
    text = F.when(F.col("__mask").isNull(), F.col("text")).otherwise(left)
    return rows.withColumn("__mask", mask).select(
        *(text.alias(c) if c == "text" else F.col(c) for c in kept),
        F.coalesce("__lines", F.array().cast("array<int>")).alias("dropped_lines"))


@query("op4_fuzzy_line_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    blank = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return found.select("doc_id", F.coalesce(blank, F.lit(0)).alias("kept_lines"), "dropped_lines", F.md5("text").alias("kept_md5"))
