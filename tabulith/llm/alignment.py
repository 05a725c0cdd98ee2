"""Alignment of two tokenizers' tokens, as Arrow tables inside tasks and counts merged by Spark.

Each text is encoded by two tokenizers. Lists of ids are flattened with their parent indices; cumulative sums of the
tokens' byte lengths, begun anew for every document, give each token's document-end key (document, byte where it ends). An Acero
hash join of both sides' keys finds the ends that both tokenizers share: these cut a document into groups. Tokens of one
group are linked: per group and side equal ids are counted first, the counts joined by group, and ``Table.group_by``
sums them per document and pair, then counts the documents of every pair. Spark merges these partial counts over
the corpus, marks the pairs that are the most frequent of their first id, and joins them back to the documents.

Texts are cut into segments that both tokenizers treat alone (in front of a space or line end that follows a character other than white space,
where no token of the second reaches over it), so a worker encodes every distinct segment once and keeps the ids.

A text that is null, empty, or that either side's tokens do not spell byte for byte has no tokens: its counts are 0 and
its digest is ''. Strings of special tokens are plain text. Rows are aligned one by one: repeated or null ``doc_id`` are
documents of their own. An empty table gives no row and no pair. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.session import lookup, written_once

from . import words as W
from .registry import query, table

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: bytes of text aligned at once, segments that a worker keeps before it starts anew, pairs counted before they are sent
BLOCK_BYTES = 1 << 19
CACHE_SEGMENTS = 400_000
HELD_PAIRS = 500_000
_JOINED, _CALL = 256, 16  # segments encoded in one text, and texts in one call

_MARK = "▁"  # a space in pieces of the second tokenizer
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_CLOSED = frozenset(b for b in range(0x80) if not _WHITE[b])


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """Bytes of the characters that stand for them in a byte-level vocabulary: printable Latin-1 stands for itself,
    the others are numbered from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of segments by both tokenizers, kept for the life of a Python worker."""

    def __init__(self, first: str, second: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for every core already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        char = _byte_of_char()
        a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            a_bytes[i] = bytes(char[c] for c in token) if all(c in char for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.bytes = (a_bytes, b_bytes)
        self.spell = tuple(pa.array(v, pa.large_binary()) for v in self.bytes)
        self.sizes = tuple(np.array([len(x) for x in v], np.int64) for v in self.bytes)
        # ids as text, each followed by every mark that can come after it
        self.shown = pa.array([f"{i}{mark}" for v, end in zip(self.bytes, "|;") for mark in (",", end, "") for i in range(len(v))],
                              pa.large_string())
        # white space in front of which no piece goes on: a segment may begin there
        normal = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        inner = {c for p in normal for x, c in zip(p, p[1:]) if x != c}
        self.cut = np.zeros(256, bool)
        self.cut[0x20] = _MARK not in inner
        self.cut[0x0A] = not any("\n" in p for p in normal)
        self.begins = frozenset(np.flatnonzero(self.cut).tolist())
        self.lone = self.b.piece_to_id(_MARK)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.counts = ([np.empty(0, np.int64) for _ in (0, 1)] for _ in (0, 1))
        self.ids = [np.empty(0, np.int32) for _ in (0, 1)]
        self.right = np.empty(0, bool)

    def _tokens(self, side: int, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with white space. The second tokenizer puts a space in front of what it is given: in
        place of a text's own, or taken away again."""
        if side == 0:
            return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        out = []
        for s, ids in zip(texts, self.b.encode([s[1:] if s[0] == " " else s for s in texts], num_threads=1)):
            if s == " ":
                ids = [self.lone]  # an empty text gets no space
            elif s[0] != " ":
                ids = ids[1:] if ids and ids[0] == self.lone else []
            out.append(ids)
        return out

    def _encoded(self, side: int, plain: list[bytes]) -> np.ndarray:
        """Keep the ids of segments; tells which segments they spell. Many are encoded in one text, which is cut again where
        the lengths of its tokens add up to those of the segments."""
        lengths = np.fromiter(map(len, plain), np.int64, len(plain))
        starts, counts = np.zeros(len(plain), np.int64), np.full(len(plain), -1)
        right = np.ones(len(plain), bool)
        flat, at = [self.ids[side]], len(self.ids[side])
        # a segment that ends in white space, or like a row's first has none in front, might join with its neighbours
        fit = [k for k, p in enumerate(plain) if p[0] in self.begins and p[-1] in _CLOSED]
        groups = [np.array(fit[i:i + _JOINED]) for i in range(0, len(fit), _JOINED)]
        for i in range(0, len(groups), _CALL):
            texts = [b"".join([plain[k] for k in g]) for g in groups[i:i + _CALL]]
            for group, text, found in zip(groups[i:i + _CALL], texts, self._tokens(side, [t.decode() for t in texts])):
                found = np.array(found, np.int32)
                ends = np.cumsum(self.sizes[side][found])
                bounds = np.cumsum(lengths[group])
                upto = np.searchsorted(ends, bounds) + 1
                if upto[-1] == len(ends) and (ends[upto - 1] == bounds).all() and self._spelled(side, found) == text:
                    counts[group] = np.diff(upto, prepend=0)
                    starts[group] = at + upto - counts[group]
                    flat.append(found)
                    at += len(found)
        rest = np.flatnonzero(counts < 0).tolist()
        for i in range(0, len(rest), _JOINED):
            some = rest[i:i + _JOINED]
            for k, found in zip(some, self._tokens(side, [plain[k].decode() for k in some])):
                found = np.array(found, np.int32)
                right[k] = self._spelled(side, found) == plain[k]
                starts[k], counts[k] = at, len(found)
                flat.append(found)
                at += len(found)
        self.ids[side] = np.concatenate(flat)
        self.starts[side] = np.concatenate((self.starts[side], starts))
        self.counts[side] = np.concatenate((self.counts[side], counts))
        return right

    def _spelled(self, side: int, ids: np.ndarray) -> bytes:
        spelled = self.spell[side].take(pa.array(ids))
        return (spelled.buffers()[2] or b"")[:int(self.sizes[side][ids].sum())].to_pybytes() if len(ids) else b""

    def _learn(self, plain: list[bytes]) -> None:
        right = self._encoded(0, plain) & self._encoded(1, plain)
        self.right = np.concatenate((self.right, right))
        self.known.update(zip(plain, range(len(self.known), len(self.known) + len(plain))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[pa.ListArray], np.ndarray]:
        """Both sides' lists of ids of the rows, and which rows both spell rightly. Every row begins with a space."""
        starts, owner = self._segments(data, offsets)
        strings = pa.Array.from_buffers(pa.binary(), len(starts), [
            None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        distinct = strings.dictionary_encode()
        names = distinct.dictionary.to_pylist()
        if len(self.known) + len(names) > CACHE_SEGMENTS:
            self._forget()
        missing = [s for s in names if s not in self.known]
        if missing:
            self._learn(missing)
        slot = np.array([self.known[s] for s in names], np.int64)[distinct.indices.to_numpy()]
        right = np.ones(len(offsets) - 1, bool)
        right[owner[~self.right[slot]]] = False
        lists = []
        for side in (0, 1):
            sizes = self.counts[side][slot]
            total = np.concatenate(([0], np.cumsum(sizes)))
            flat = self.ids[side][np.repeat(self.starts[side][slot] - total[:-1], sizes) + np.arange(total[-1])]
            bounds = total[np.searchsorted(owner, np.arange(len(offsets)))]
            lists.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat)))
        return lists, right

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        # what a character before a cut ends with: ASCII but white space, or letters of ranges without white space
        lead = (data >= 0xC3) & (data <= 0xDF), (data >= 0xE4) & (data <= 0xEF), data >= 0xF0
        solid = (data < 0x80) & ~_WHITE[data]
        for width, mask in zip((1, 2, 3), lead):
            solid[width:] |= mask[:-width] if width < n else mask[:0]
        begins = np.zeros(n, bool)
        begins[1:] = self.cut[data[1:]] & solid[:-1]
        begins[offsets[:-1]] = True
        starts = np.flatnonzero(begins)
        return starts, np.searchsorted(offsets, starts, "right") - 1


def encoder(first: str, second: str) -> Encoder:
    """One for all tasks of a Python worker: kept beside its modules, as a task's functions are unpickled anew."""
    held = sys.modules.setdefault("_alignment_encoders", ModuleType("_alignment_encoders")).__dict__
    if (first, second) not in held:
        held[first, second] = Encoder(first, second)
    return held[first, second]


def _end_keys(ids: pa.Array, parents: pa.Array, sizes: np.ndarray, rows: int) -> pa.Array:
    """(row, byte) where each token ends, as one number: cumulative sums of lengths, begun anew for every row."""
    row = parents.to_numpy()
    ends = np.cumsum(sizes[ids.to_numpy()])
    first = np.searchsorted(row, np.arange(rows))
    base = np.concatenate(([0], ends))[first]
    return pa.array((row << 36) | (ends - base[row]), pa.int64())


def _counted(groups: np.ndarray, ids: np.ndarray, width: int, name: str) -> pa.Table:
    """How often each id stands in each group."""
    keys = pa.table({"k": groups * width + ids}).group_by("k", use_threads=False).aggregate([([], "count_all")])
    key = keys["k"].to_numpy()
    return pa.table({"group": key // width, name: key % width, f"n_{name}": keys["count_all"]})


def aligned(lists: list[pa.ListArray], right: np.ndarray, enc: Encoder) -> dict:
    """Counts, digests and links of rows from both sides' ids."""
    rows = len(right)
    lists = [pc.if_else(pa.array(right), x, pa.scalar([], x.type)) for x in lists]
    ids = [pc.list_flatten(x) for x in lists]
    parents = [pc.list_parent_indices(x).cast(pa.int64()) for x in lists]
    keys = [_end_keys(i, p, s, rows) for i, p, s in zip(ids, parents, enc.sizes)]
    shared = pa.table({"key": keys[0]}).join(pa.table({"key": keys[1]}), "key", join_type="inner", use_threads=False)
    # every group is named by the key of its end
    ends = np.sort(shared["key"].to_numpy())
    group = [np.searchsorted(ends, k.to_numpy()) for k in keys]
    raw = [i.to_numpy() for i in ids]
    owner = ends >> 36
    tokens = [np.bincount(g, minlength=len(ends)) for g in group]
    # tokens stand by group, first side before second; what follows each token in the digest's text
    n_a, n_b = len(raw[0]), len(raw[1])
    before = [np.concatenate(([0], np.cumsum(t)))[:-1] for t in tokens]
    spot_a = np.arange(n_a) + before[1][group[0]]
    spot_b = np.arange(n_b) + (before[0] + tokens[0])[group[1]]
    last_a = np.diff(group[0], append=-1) != 0
    last_b = np.diff(group[1], append=-1) != 0
    row_end = np.diff(parents[1].to_numpy(), append=-1) != 0
    shown = np.empty(n_a + n_b, np.int64)
    width = [len(v) for v in enc.bytes]
    shown[spot_a] = raw[0] + width[0] * last_a
    shown[spot_b] = 3 * width[0] + raw[1] + width[1] * (last_b.astype(np.int64) + row_end)
    text = enc.shown.take(pa.array(shown))
    edges = np.frombuffer(text.buffers()[1], np.int64)[:len(shown) + 1]
    sizes = [np.bincount(p.to_numpy(), minlength=rows) for p in parents]
    bounds = edges[np.concatenate(([0], np.cumsum(sizes[0] + sizes[1])))] if len(shown) else np.zeros(rows + 1, np.int64)
    spelled = memoryview(text.buffers()[2]) if len(shown) else memoryview(b"")
    digests = [hashlib.sha256(spelled[lo:hi]).hexdigest() if lo < hi else "" for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    links = _counted(group[0], raw[0], width[0], "a").join(_counted(group[1], raw[1], width[1], "b"), "group", use_threads=False)
    code = links["a"].to_numpy() * width[1] + links["b"].to_numpy()
    times = links["n_a"].to_numpy() * links["n_b"].to_numpy()
    held = pa.table({"row": owner[links["group"].to_numpy()], "pair": code, "times": times}).group_by(
        ["row", "pair"], use_threads=False).aggregate([("times", "sum")]).sort_by([("row", "ascending"), ("pair", "ascending")])
    row = held["row"].to_numpy()
    return {"n_a": sizes[0], "n_b": sizes[1], "n_groups": np.bincount(owner, minlength=rows),
            "n_links": np.bincount(row, held["times_sum"].to_numpy(), rows).astype(np.int64), "digests": digests,
            "pair": held["pair"].combine_chunks(), "times": held["times_sum"].combine_chunks(),
            "offsets": np.searchsorted(row, np.arange(rows + 1))}


def _documents(counts: pa.Table) -> pa.Table:
    """Partial counts of pairs, merged."""
    out = counts.group_by("pair", use_threads=False).aggregate([("docs", "sum")])
    return out.rename_columns({"docs_sum": "docs"})


_ROW = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs array<long>, times array<long>, docs array<long>")


def _aligner(first: str, second: str):
    def spaced(texts: pa.Array) -> pa.Array:
        texts = texts.fill_null("")
        return pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise("", texts, " "))

    def record(n: int, columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.nulls(n, c) for c in columns], names=_NAMES)

    def partial(counts: pa.Table) -> pa.RecordBatch:
        lists = [pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), counts[c].combine_chunks().cast(pa.int64()))
                 for c in ("pair", "docs")]
        return record(1, [*[pa.int64()] * 6, pa.string(), lists[0], pa.list_(pa.int64()), lists[1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(first, second)
        part, done = TaskContext.get().partitionId(), 0
        counts = pa.table({"pair": pa.array([], pa.int64()), "docs": pa.array([], pa.int64())})
        for batch in batches:
            for at, data, offsets in W.blocks(spaced(batch.column(1)), BLOCK_BYTES):
                n = len(offsets) - 1
                found = aligned(*enc.encode(data, offsets), enc) if len(data) else _NOTHING(n)
                mine = pa.table({"pair": found["pair"]}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
                counts = _documents(pa.concat_tables([counts, mine.rename_columns({"count_all": "docs"})]))
                if len(counts) > HELD_PAIRS:
                    yield partial(counts)
                    counts = counts.slice(0, 0)
                bounds = pa.array(found["offsets"], pa.int32())
                yield record(n, [
                    pa.array((part << 40) + done + np.arange(n), pa.int64()), batch.column(0).slice(at, n),
                    *[pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(found["digests"], pa.string()),
                    pa.ListArray.from_arrays(bounds, found["pair"].cast(pa.int64())),
                    pa.ListArray.from_arrays(bounds, found["times"].cast(pa.int64())), pa.list_(pa.int64())])
                done += n
        if len(counts):
            yield partial(counts)
    return run


_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _NOTHING(rows: int) -> dict:
    zeros, none = np.zeros(rows, np.int64), pa.array([], pa.int64())
    return {"n_a": zeros, "n_b": zeros, "n_groups": zeros, "n_links": zeros, "digests": [""] * rows,
            "pair": none, "times": none, "offsets": np.zeros(rows + 1, np.int64)}


class Alignment:
    """Documents aligned by two tokenizers.

    ``rows``: one row per document with its counts, digest, and its distinct pairs with how often each is linked;
    ``pairs``: ``pair, docs, best`` over the corpus. A pair is first id * ``width`` + second id.
    """

    def __init__(self, docs: DataFrame, first: str | None = None, second: str | None = None, key: str = "doc_id", text: str = "text"):
        first, second = first or vocabulary_path(BYTE_LEVEL), second or vocabulary_path(PIECES)
        self.width = len(encoder(first, second).bytes[1])
        found = written_once(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
                             .mapInArrow(_aligner(first, second), _ROW), "aligned")
        self.rows = found.where("row IS NOT NULL").drop("docs")
        partial = found.where("row IS NULL").select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), "docs")))
        counts = partial.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.expr(f"pair div {self.width}"))
        most = counts.groupBy("a").agg(F.max("docs").alias("most"))
        self.pairs = counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))

    def table(self) -> DataFrame:
        """The corpus's pairs as ids: ``a, b, docs, best``."""
        return self.pairs.select(F.expr(f"pair div {self.width}").alias("a"), (F.col("pair") % self.width).alias("b"), "docs", "best")

    def documents(self) -> DataFrame:
        """Each document's counts, with its links weighted by the corpus: ``n_best`` and ``count_sum``."""
        held = self.rows.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), "times")))
        sums = held.join(lookup(self.pairs), "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("docs")).alias("sum"))
        none = F.lit(0).cast("long")
        return self.rows.drop("pairs", "times").join(sums, "row", "left").select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("best", none).alias("n_best"),
            F.coalesce("sum", none).alias("count_sum"), "groups_sha256")


@query("op11_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Alignment(table(spark, sf_dir, "documents")).documents()
