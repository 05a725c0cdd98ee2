"""Packing along a space-filling curve.

Every document's token ids become a hashed vector, projected to four dimensions and numbered along a Hilbert
curve. Documents are range-sorted by that number, laid end to end, and the line of ids is cut every
``length`` ids, so sequences hold neighbours along the curve and only the last one can need padding; a
remainder is cut at powers of two, which need none. Offsets come from one row per partition.

Tokens come from a public tokenizer file. It drops white space and keeps letters apart from marks, so a text is cut into
pieces at ASCII white space and between ASCII letters and marks, where a piece's ids don't depend on its neighbours. The
ids of pieces seen before are kept by hash in each Python worker, and arrays of ids are put together from them. Texts that
spell out a special token go through the tokenizer as a whole.

Null or empty text is a document of the end id alone. Rows are packed one by one: repeated ``doc_id`` or null
ids are rows of their own. An empty table gives no sequence.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulith.session import cut_lineage

from . import words as W
from .registry import query, table

LENGTH = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
DIMENSIONS, BITS = 4, 8
#: pieces that a worker keeps (some 30 bytes each) before it starts anew, bytes of text tokenized at once
CACHE_ENTRIES = 2_000_000
BLOCK_BYTES = 1 << 19

_random = np.random.default_rng(7)
_BUCKETS = 256
_PROJECTION = _random.standard_normal((_BUCKETS, DIMENSIONS))
_GRID = np.array([NormalDist().inv_cdf(i / (1 << BITS)) for i in range(1, 1 << BITS)])
_SPECIAL = b"<|"
_JOINED, _CALL = 256, 16  # words put together, and groups of them encoded in one call


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Ids of whole texts, from the ids of their pieces."""

    def __init__(self, path: str, end_id: int | None = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for every core already
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # lower-case ASCII words need no normalizing, and only white space between them
        self.plain = Tokenizer(self.whole.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        size = self.whole.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.end = np.array([] if end_id is None else [end_id], self.kind)
        self.last = np.zeros(size, bool)  # ids that end a word
        suffix = getattr(self.whole.model, "end_of_word_suffix", None)
        if suffix:
            self.last[[i for token, i in self.whole.get_vocab().items() if token.endswith(suffix)]] = True
        self.joins = bool(suffix)
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.first, self.ids = np.zeros(1, np.int64), np.empty(0, self.kind)

    def _encoded(self, pieces: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(pieces)
        words = [k for k, p in enumerate(pieces) if self.joins and p.isascii() and p.isalpha()]
        groups = [words[i:i + _JOINED] for i in range(0, len(words), _JOINED)]
        for i in range(0, len(groups), _CALL):  # the tokenizer's results are large
            some = groups[i:i + _CALL]
            texts = [" ".join([pieces[k].lower() for k in g]) for g in some]
            for group, found in zip(some, self.plain.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(found.ids, self.kind)
                ends = np.flatnonzero(self.last[ids]) + 1
                for k, lo, hi in zip(group, np.concatenate(([0], ends[:-1])).tolist(), ends.tolist()):
                    out[k] = ids[lo:hi]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, found in zip(rest, self.whole.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False)):
            out[k] = np.array(found.ids, self.kind)
        return out

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        new = self._encoded(pieces)
        slots = len(self.first) - 1 + np.arange(len(new))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum([len(x) for x in new])))
        self.ids = np.concatenate((self.ids, *new))
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.slots = np.insert(self.hashes, place, hashes), np.insert(self.slots, place, slots)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each with the end id, and their offsets by row."""
        starts, ends, at = W.pieces(data, offsets)
        hashes, where, back = np.unique(W.mix(W.span_hashes(data, starts, ends)), return_index=True, return_inverse=True)
        known = self._find(hashes)
        missing = np.flatnonzero(known < 0)
        if len(self.hashes) + len(missing) > CACHE_ENTRIES:
            self._forget()
            missing = np.arange(len(hashes))
        if len(missing):
            self._learn(hashes[missing], [data[starts[w]:ends[w]].tobytes().decode() for w in where[missing]])
            known = self._find(hashes)
        slot = known[back]
        sizes = self.first[slot + 1] - self.first[slot]
        total = np.concatenate(([0], np.cumsum(sizes)))
        own = self.ids[np.repeat(self.first[slot] - total[:-1], sizes) + np.arange(total[-1])]
        if not len(self.end):
            return own, total[at]
        out_at = total[at] + np.arange(len(at))
        out = np.empty(total[-1] + len(at) - 1, self.kind)
        is_end = np.zeros(len(out), bool)
        is_end[out_at[1:] - 1] = True
        out[is_end], out[~is_end] = self.end[0], own
        return out, out_at

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slots of pieces, -1 where unknown."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, self.slots[place], -1)

    def encode_text(self, text: str) -> np.ndarray:
        return np.concatenate((np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind), self.end))


_encoders: dict[tuple, PieceEncoder] = {}


def _encoder(path: str, end_id: int | None) -> PieceEncoder:
    """One for all tasks of a Python worker."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = PieceEncoder(path, end_id)
    return _encoders[path, end_id]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points along a Hilbert curve, by Skilling's transposed form."""
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    step = np.uint64(1 << (bits - 1))
    while step > 1:
        low = step - np.uint64(1)
        for i in range(dims):
            high = (x[i] & step) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        step >>= np.uint64(1)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    step = np.uint64(1 << (bits - 1))
    while step > 1:
        turn ^= np.where((x[-1] & step) != 0, step - np.uint64(1), np.uint64(0))
        step >>= np.uint64(1)
    x ^= turn
    place = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return place.view(np.int64)


def curve_keys(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hilbert places of documents from their token ids."""
    rows = len(first) - 1
    owner = np.repeat(np.arange(rows), np.diff(first))
    mixed = ids.astype(np.uint32) * np.uint32(0x9E3779B1)
    bucket, sign = mixed >> np.uint32(24), np.where(mixed & np.uint32(1 << 12), 1.0, -1.0)
    vector = np.bincount(owner * _BUCKETS + bucket, sign, rows * _BUCKETS).reshape(rows, _BUCKETS)
    norm = np.sqrt((vector ** 2).sum(axis=1, keepdims=True))
    return hilbert(np.searchsorted(_GRID, vector / np.maximum(norm, 1e-9) @ _PROJECTION), BITS)


def _tokenized(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, pack = _encoder(path, end_id), zstandard.ZstdCompressor(level=1).compress
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, data, offsets in W.blocks(batch.column(1), BLOCK_BYTES):
                ids, first = encoder.encode(data, offsets)
                spelled = np.flatnonzero((data[:-1] == _SPECIAL[0]) & (data[1:] == _SPECIAL[1]))
                rows = np.split(ids, first[1:-1])
                for k in set((np.searchsorted(offsets, spelled, "right") - 1).tolist()):
                    rows[k] = encoder.encode_text(data[offsets[k]:offsets[k + 1]].tobytes().decode())
                if len(spelled):
                    ids, first = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(x) for x in rows])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((part << 40) + row + np.arange(len(rows)), pa.int64()), batch.column(0).slice(at, len(rows)),
                     pa.array(curve_keys(ids, first), pa.int64()), pa.array(np.diff(first), pa.int64()),
                     pa.array([pack(x) for x in rows], pa.binary())], names=["row", "doc_id", "curve", "tokens", "ids"])
                row += len(rows)
    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids before each row inside its partition."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        sizes = batch.column(1).to_numpy(zero_copy_only=False)
        before = total + np.cumsum(sizes) - sizes
        total += int(sizes.sum())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(sizes), pa.int32()), pa.array(before, pa.int64()),
                                          batch.column(1)], names=["row", "part", "before", "tokens"])


def _pieces(length: int, total: int, wide: bool):
    full = total // length * length
    rest = total - full
    # sequences of the remainder: its powers of two, the largest first
    cuts = np.cumsum([0] + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]) + full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for doc, begin, size, packed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "begin", "tokens", "ids"))):
                ids = np.frombuffer(unpack(packed), "<u4" if wide else "<u2")
                end = begin + size
                edges = np.arange(begin // length + 1, min(end - 1, full) // length + 1) * length
                edges = np.concatenate(([begin], edges[(edges > begin) & (edges < end)], cuts[(cuts > max(begin, full)) & (cuts < end)], [end]))
                for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    if lo < full:
                        sequence, offset = divmod(lo, length)
                    else:
                        k = int(np.searchsorted(cuts, lo, "right")) - 1
                        sequence, offset = full // length + k, lo - int(cuts[k])
                    out.append((doc, lo - begin, hi - lo, zlib.crc32(ids[lo - begin:hi - begin].astype("<u4").tobytes()), size,
                                sequence, offset))
            columns = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_PIECE)
    return run


_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, end_id: int | None = END_ID,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path()
    wide = PieceEncoder(path).kind.itemsize == 4
    tokens = cut_lineage(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        _tokenized(path, end_id), "row long, doc_id long, curve long, tokens long, ids binary").where("tokens > 0"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = cut_lineage(tokens.select("row", "curve", "tokens").repartitionByRange(parts, "curve", "row").sortWithinPartitions(
        "curve", "row").select("row", "tokens").mapInArrow(_running, "row long, part int, before long, tokens long"))
    sums = line.groupBy("part").agg(F.sum("tokens").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    starts = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    places = line.join(F.broadcast(starts), "part").select("row", (F.col("base") + F.col("before")).alias("begin"))
    return tokens.drop("curve").join(places, "row").select("doc_id", "begin", "tokens", "ids").mapInArrow(
        _pieces(length, total, wide), ", ".join(f"{c} long" for c in _PIECE))


@query("op7_hilbert_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
