"""Benchmark decontamination with spaced seeds.

A seed hashes the words at the set positions of a fixed mask and ignores the others, so a copied passage still
shares seeds where words were replaced. Seeds of the corpus are joined with seeds of the test items; around
every hit the two texts are compared word by word along the hit's diagonal. The longest stretch that begins and ends
with equal words and has ``IDENTITY`` percent of them is an overlap if it has ``MIN_WORDS`` words, or as many as the item
where that is shorter. Words are runs of letters and digits, lower-cased; punctuation does not count.

The corpus is read once: a task keeps the stretches of text around positions whose seed is a test seed, told by a bit
table and the sorted test seeds. They only save work: beyond ``TABLE_SEEDS`` seeds, where they would no longer be
small, all positions are joined.

Null or word-free texts and items overlap with nothing. Repeated items are separate items, repeated rows give
repeated overlaps only once per ``doc_id`` and ``item_id``. Rows without an id are not compared.
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
from .registry import query, table

#: 1: the word counts. Together they find any 13 words of which at most two are replaced, wherever these are.
MASKS = ("111001011", "10110110001", "10000111011")
#: for items that have fewer words than that; where an item is shorter still, the whole of it is a seed
SHORT_MASK = "111111"
MIN_WORDS = 13
IDENTITY = 80
#: test seeds that tasks look up by themselves: at 8 bytes and 64 to 128 bits a seed, 96 MB at most
TABLE_SEEDS = 1 << 22


def _mask_seeds(words: np.ndarray, offsets: np.ndarray, number: int, total: int) -> np.ndarray:
    """Seeds of one mask at all starts; ``number`` keeps masks apart."""
    n = max(0, total - int(offsets[-1]))
    out = np.full(n, (number * 0x9E3779B97F4A7C15) & ((1 << 64) - 1), np.uint64)
    for o in offsets:
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[o:o + n]
    return W.mix(out)


def _offsets(masks: tuple[str, ...]) -> list[np.ndarray]:
    return [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == ord("1")) for m in masks]


def _seeds(words: np.ndarray, first: np.ndarray, masks: list[np.ndarray]):
    """For every mask (starts, seeds) of the starts where the mask stays inside the row."""
    last = np.repeat(first[1:], np.diff(first))
    for number, offsets in enumerate(masks):
        seeds = _mask_seeds(words, offsets, number, len(words))
        inside = np.arange(len(seeds)) + offsets[-1] < last[:len(seeds)]
        yield np.flatnonzero(inside), seeds[inside]


def _short(words: np.ndarray) -> bytes:
    """Half of each word's hash, enough to compare two texts."""
    return (words >> np.uint64(32)).astype("<u4").tobytes()


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, sizes = [], []
        for _, data, offsets in W.blocks(batch.column(1)):
            words, first = W.word_hashes(data, offsets, bare=True)
            out += [words[first[k]:first[k + 1]].tobytes() for k in range(len(offsets) - 1)]
            sizes += np.diff(first).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(sizes, pa.int32())],
                                         names=["item_id", "item", "item_words"])


def _item_seeds(masks: tuple[str, ...]):
    offsets = _offsets(masks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seeds, at = [], [], []
            for item, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = np.frombuffer(data, np.uint64)
                for starts, found in _seeds(words, np.array([0, len(words)]), offsets):
                    ids.append(np.full(len(starts), item, np.int64))
                    seeds.append(found.view(np.int64))
                    at.append(starts.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x) if x else [], t) for x, t in ((seeds, pa.int64()), (ids, pa.int64()), (at, pa.int32()))],
                names=["seed", "item_id", "item_at"])
    return run


def _stretches(masks: tuple[str, ...], margin: int, tables, shift: int):
    """Runs of words around possible hits, with the hits' places in the run and seeds."""
    offsets = _offsets(masks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, ordered = (None, None) if tables is None else tables.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows = []
            for row, data, edges in W.blocks(batch.column(1)):
                words, first = W.word_hashes(data, edges, bare=True)
                starts, seeds = [], []
                for s, x in _seeds(words, first, offsets):
                    if bits is not None:
                        slot = x >> np.uint64(shift)
                        maybe = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        s, x = s[maybe], x[maybe]
                        real = ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x
                        s, x = s[real], x[real]
                    starts.append(s)
                    seeds.append(x)
                starts, seeds = np.concatenate(starts), np.concatenate(seeds)
                if not len(starts):
                    continue
                order = np.argsort(starts, kind="stable")
                starts, seeds = starts[order], seeds[order]
                owner = np.searchsorted(first, starts, "right") - 1
                cut = np.flatnonzero((np.diff(owner) != 0) | (np.diff(starts) > 2 * margin)) + 1
                for lo, hi in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(starts)]))):
                    k = owner[lo]
                    begin, end = max(first[k], starts[lo] - margin), min(first[k + 1], starts[hi - 1] + margin)
                    rows.append((int(ids[row + k]), int(begin - first[k]), _short(words[begin:end]),
                                 (starts[lo:hi] - begin).tolist(), seeds[lo:hi].view(np.int64).tolist()))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()),
                                                          pa.list_(pa.int64())))],
                names=["doc_id", "doc_at", "stretch", "places", "seeds"])
    return run


def _best(equal: np.ndarray, identity: int) -> tuple[int, int]:
    """The longest stretch that begins and ends with equal words and has the required share of them: start and end."""
    at = np.flatnonzero(equal)
    if not len(at):
        return 0, 0
    gains = np.concatenate(([0], np.cumsum(np.where(equal, 100 - identity, -identity))))
    low = np.minimum.accumulate(gains[at])
    starts = at[np.searchsorted(-low, -gains[at + 1])]  # the first start that an end can have
    longest = int((at - starts).argmax())
    return int(starts[longest]), int(at[longest]) + 1


def _verify(min_words: int, identity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, at, stretch, item, diagonal, test in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = np.frombuffer(stretch, "<u4"), np.frombuffer(_short(np.frombuffer(test, np.uint64)), "<u4")
                lo, hi = max(0, -diagonal), min(len(y), len(x) - diagonal)
                if hi <= lo:
                    continue
                equal = x[lo + diagonal:hi + diagonal] == y[lo:hi]
                begin, end = _best(equal, identity)
                if end - begin >= min(min_words, len(y)):
                    rows.append((doc, item, at + diagonal + lo + begin, lo + begin, end - begin, int(equal[begin:end].sum())))
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             names=["doc_id", "item_id", "doc_word", "item_word", "words", "equal_words"])
    return run


def overlaps(docs: DataFrame, tests: DataFrame, masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS,
             identity: int = IDENTITY) -> DataFrame:
    """``doc_id, item_id, doc_word, item_word, words, equal_words``: the longest overlap of each document with each
    item it overlaps, places counted in words from 0. ``docs``: doc_id, text; ``tests``: item_id, text."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    items = cut_lineage(tests.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        "item_id is not null and text is not null").mapInArrow(_items, "item_id long, item binary, item_words int"))
    longest = max(len(m) for m in masks)
    sizes = items.agg(F.max("item_words"), F.min("item_words"), F.collect_set(
        F.when(F.col("item_words") < len(SHORT_MASK), F.col("item_words")))).first()
    if sizes[1] is not None and sizes[1] < min_words:
        masks = (*masks, SHORT_MASK, *("1" * n for n in sorted(sizes[2]) if n))
    seeds = cut_lineage(items.mapInArrow(_item_seeds(masks), "seed long, item_id long, item_at int"))
    margin = max(longest, sizes[0] or 0)
    count = seeds.count()
    tables, shift = None, 0
    if count <= TABLE_SEEDS:
        size = max(22, (64 * count).bit_length())
        shift = 64 - size
        marks = np.zeros(1 << (size - 3), np.uint8)
        ordered = np.sort(np.append(seeds.select("seed").distinct().toArrow().column(0).to_numpy().view(np.uint64), np.uint64(0)))
        slot = ordered >> np.uint64(shift)
        np.bitwise_or.at(marks, slot >> np.uint64(3), np.left_shift(1, slot & np.uint64(7)).astype(np.uint8))
        tables = spark.sparkContext.broadcast((marks, ordered))
    found = cut_lineage(texts.mapInArrow(
        _stretches(masks, margin, tables, shift),
        "doc_id long, doc_at int, stretch binary, places array<int>, seeds array<long>"))
    hits = found.select("doc_id", "doc_at", F.explode(F.arrays_zip("places", "seeds")).alias("hit")).select(
        "doc_id", "doc_at", F.col("hit.places").alias("place"), F.col("hit.seeds").alias("seed"))
    lines = hits.join(sized(seeds), "seed").select("doc_id", "doc_at", "item_id",
                                                   (F.col("place") - F.col("item_at")).alias("diagonal")).distinct()
    pairs = lines.join(found.select("doc_id", "doc_at", "stretch").dropDuplicates(["doc_id", "doc_at", "stretch"]),
                       ["doc_id", "doc_at"]).join(sized(items.select("item_id", "item"), "item"), "item_id")
    good = pairs.select("doc_id", "doc_at", "stretch", "item_id", "diagonal", "item").mapInArrow(
        _verify(min_words, identity),
        "doc_id long, item_id long, doc_word long, item_word long, words long, equal_words long")
    best = F.max(F.struct("equal_words", (-F.col("doc_word")).alias("o"), (-F.col("item_word")).alias("i"), "words")).alias("m")
    return good.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("m.o")).alias("doc_word"), (-F.col("m.i")).alias("item_word"), "m.words",
        "m.equal_words")


def clean(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that overlap with no test item."""
    found = overlaps(docs, tests, **options).select("doc_id").distinct()
    return docs.join(sized(found), "doc_id", "left_anti").select(docs.columns)


@query("op1_spaced_seed_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
