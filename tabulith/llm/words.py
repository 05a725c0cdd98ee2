"""Word hashes straight from Arrow string buffers, without a Python object per word.

A word is a run of bytes that are not ASCII white space (0x20, 0x09-0x0D); A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes of text hashed at once: small enough for the CPU cache, whatever the Arrow batch holds
BLOCK_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
#: separators of ``bare`` words: all ASCII but letters and digits
_NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_powers: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into the bytes) of runs of rows; one long row may exceed ``limit``."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row]:offsets[last]], offsets[row:last + 1] - offsets[row]
        row = last


def spans(data: np.ndarray, offsets: np.ndarray, bare: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the number of the first word at or after it.

    ``bare``: words are runs of letters, digits and non-ASCII bytes, so punctuation doesn't count.
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid = ~(_NOT_ALNUM if bare else _SPACE)[data]
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and word offsets of the rows."""
    starts, ends, first = spans(data, offsets, bare)
    return mix(span_hashes(data, starts, ends)), first


_LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
#: ASCII that is no letter, white space or apostrophe
_MARK = _NOT_ALNUM & ~_SPACE | np.array([48 <= i < 58 for i in range(256)])
_MARK[39] = False


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``spans``, with words also cut where an ASCII letter and another ASCII mark but the apostrophe meet."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid, letter, mark = ~_SPACE[data], _LETTER[data], _MARK[data]
    cut = edge[1:n] | ~solid[:-1] | ~solid[1:] | letter[:-1] & mark[1:] | mark[:-1] & letter[1:] if n else edge[:0]
    starts = np.flatnonzero(solid & np.concatenate((np.ones(min(n, 1), bool), cut)))
    ends = np.flatnonzero(solid & np.concatenate((cut, np.ones(min(n, 1), bool)))) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data] * _table("up", _BASE, n), out=sums[1:])
    down = _table("down", pow(_BASE, -1, 1 << 64), n + 1)
    return (sums[ends] - sums[starts]) * down[starts]


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a row, and shingle offsets of the rows.

    A row with fewer words, but at least one, has a single shingle of all its words.
    """
    counts = np.diff(first)
    total = len(words)
    runs = np.maximum(total - size + 1, 0)
    rolled = np.zeros(runs, np.uint64)
    for i in range(size):
        rolled *= np.uint64(0xD6E8FEB86659FD93)
        rolled += words[i:i + runs]
    rolled = mix(rolled)
    per_row = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_first = np.concatenate(([0], np.cumsum(per_row)))
    out = np.empty(out_first[-1], np.uint64)
    at = np.repeat(first[:-1] - out_first[:-1], per_row) + np.arange(out_first[-1])
    whole = np.repeat(counts >= size, per_row)
    out[whole] = rolled[at[whole]]
    for row in np.flatnonzero((counts > 0) & (counts < size)):
        value = np.uint64(counts[row])
        for w in words[first[row]:first[row + 1]]:
            value = mix(np.array([value ^ w], np.uint64))[0]
        out[out_first[row]] = value
    return out, out_first


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row."""
    parts, sizes = [], np.zeros(len(first), np.int64)
    for row in range(len(first) - 1):
        own = np.sort(values[first[row]:first[row + 1]])
        if len(own) > 1:
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        parts.append(own)
        sizes[row + 1] = len(own)
    return (np.concatenate(parts) if parts else values[:0]), np.cumsum(sizes)
