import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulith.llm import words as W

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB cÉ\t\n\x0b.,é", max_size=30)), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for t in texts]
    got = []
    for row, data, offsets in W.blocks(pa.array(texts, pa.string()), limit=8):
        hashes, first = W.word_hashes(data, offsets)
        got += [hashes[first[k]:first[k + 1]].tolist() for k in range(len(offsets) - 1)]
    assert [len(w) for w in got] == [len(w) for w in want]
    known = {}
    for a, b in zip((x for w in want for x in w), (x for w in got for x in w)):
        assert known.setdefault(a, b) == b
    assert len(set(known.values())) == len(known)


def test_shingles_and_distinct():
    _, data, offsets = next(W.blocks(pa.array(["a b c d e", "a b", "", "b a", "c a b c d e a b c d"])))
    values, first = W.shingles(*W.word_hashes(data, offsets), 4)
    assert np.diff(first).tolist() == [2, 1, 0, 1, 7]
    rows = [set(values[first[k]:first[k + 1]].tolist()) for k in range(5)]
    assert rows[0] < rows[4] and not rows[1] & rows[3]
    assert np.diff(W.distinct(values, first)[1]).tolist() == [2, 1, 0, 1, 6]


def test_bare_words_ignore_punctuation():
    _, data, offsets = next(W.blocks(pa.array(["Ab, c!", "ab c"])))
    hashes, first = W.word_hashes(data, offsets, bare=True)
    assert hashes[:2].tolist() == hashes[2:].tolist()


def test_sliced_and_large_arrays():
    plain = pa.array(["x", "a b", None, "c"])
    for array in (plain.slice(1), plain.cast(pa.large_string()).slice(1)):
        _, data, offsets = next(W.blocks(array))
        assert np.diff(W.word_hashes(data, offsets)[1]).tolist() == [2, 0, 1]
    assert not list(W.blocks(pa.array([], pa.string())))
