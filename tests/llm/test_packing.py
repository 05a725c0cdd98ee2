import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulith.llm import packing as P

ENCODER = P.PieceEncoder(P.tokenizer_path())


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.tokenizer_path())


def check(pieces, docs, tokenizer, length=4096):
    """Every id in exactly one piece, pieces gapless in their sequence, padding only in what is no power of two."""
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in docs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert zlib.crc32(own[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for parts, whole in [*((p, len(ids[d])) for d, p in by_doc.items()), *((p, None) for p in by_sequence.values())]:
        end = 0
        for start, n in sorted(parts):
            assert start == end and n > 0
            end += n
        assert end == whole if whole is not None else end <= length and end & (end - 1) == 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_round_trip(spark, sf, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(P.op7(spark, sf).collect(), docs, tokenizer)


TEXTS = [None, "", " \t\n", "Hello, WORLD... it's 42% don't!!", "ÀÉ ß ﬁ İ ǅ 日本語 x", "a\u00a0b\u2003c\u0085d\x0be\x0cf\x1cg", "e\u0301 \u0301x n\u0303.",
         "<|endoftext|> <|startoftext|>x", "one.two,three.", "can't've 'S 'm'm", "it's, x's! '...a 'll", "<|ENDOFTEXT|>", "😀👍🏽 !!.. ,.", "word " * 30_000, "x" * 3000]


def test_edge_texts(spark, documents, tokenizer):
    rows = list(enumerate(TEXTS))
    check(P.pack(documents(rows)).collect(), rows, tokenizer)
    assert P.pack(documents([])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aBz s't.,!?1 \t\n\x0b\x1c\u00a0éÉ\u0301\u0338=<|>ß…’²日", max_size=25), min_size=1, max_size=5))
def test_pieces_give_the_ids_of_whole_texts(tokenizer, texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ids, first = ENCODER.encode(data, np.concatenate(([0], np.cumsum([len(x) for x in raw]))))
    for k, text in enumerate(texts):
        assert ids[first[k]:first[k + 1]].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_repeated_and_nameless_rows(documents):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (None, None)]
    got = P.pack(documents(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in got if r["start"] == 0) == [(0, 1), (0, 2), (1, 3), (1, 3)]
    assert sum(r["length"] for r in got) == 9 == sum(r["doc_tokens"] for r in got if r["start"] == 0)


def test_pieces_are_cut_at_short_lengths(documents, tokenizer):
    rows = [(i, "word and other words, " * (i % 7)) for i in range(60)]
    check(P.pack(documents(rows), length=16).collect(), rows, tokenizer, 16)


def test_the_cache_starts_anew(monkeypatch, tokenizer):
    monkeypatch.setattr(P, "CACHE_ENTRIES", 3)
    encoder = P.PieceEncoder(P.tokenizer_path())
    for text in ("alpha beta gamma delta", "alpha zeta eta", "theta iota alpha. kappa, lambda"):
        want = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        data = np.frombuffer(text.encode(), np.uint8)
        assert encoder.encode(data, np.array([0, len(data)]))[0].tolist() == want


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        n = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(n)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = P.hilbert(grid, bits)
        assert sorted(place) == list(range(n ** dims))
        assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_alike_documents_are_neighbours():
    rng = np.random.default_rng(0)
    topics = rng.integers(0, 49_000, (2, 50))
    docs = [rng.choice(topics[i % 2], 200) for i in range(40)]
    keys = P.curve_keys(np.concatenate(docs), np.arange(41) * 200)
    kinds = np.argsort(keys, kind="stable") % 2
    assert (np.diff(kinds) != 0).sum() < 12  # about 20 in a random order
