import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.llm import alignment
from tabulith.llm.alignment import Alignment, encoder, vocabulary_path

PATHS = vocabulary_path(alignment.BYTE_LEVEL), vocabulary_path(alignment.PIECES)

TEXTS = [
    "The quick brown fox jumps over the lazy dog. The dog sleeps!", "the the the the", None, "", " ", "  two  spaces ", "a\n\n b\r\n\tc ;\r\n",
    "naïve café déjà vu, l'été à Zürich – “quoted” 12345 67.89", "日本語のテキスト と　全角 空白", "emoji 👩‍👩‍👧 end", "<|endoftext|> <s> </s> <0x0A> [INST]",
    "piece mark \u2581 inside", "nul \x00 byte", "no-break\u00a0\u00a0 x\u00a0  y", "x " * 300, "line\nline\nline \n  last\n", "It's we'll I'd",
    "\u2003em space\u2028 \u2029 line", "wordwithoutanyspace" * 40, "\n", "a", "\ta\tb",
]


def tokens(text):
    """Both sides' ids of a whole text, without any cache; None if they don't spell it."""
    enc = encoder(*PATHS)
    if not text:
        return None
    ids = enc.a.encode(" " + text, add_special_tokens=False).ids, enc.b.encode(text)
    spelled = [b"".join(enc.bytes[k][i] for i in side) for k, side in enumerate(ids)]
    return ids if spelled == [(" " + text).encode()] * 2 else None


def by_hand(texts):
    enc = encoder(*PATHS)
    groups = []
    for text in texts:
        found, out = tokens(text), []
        if found:
            ends = [np.cumsum([len(enc.bytes[k][i]) for i in side]).tolist() for k, side in enumerate(found)]
            shared = sorted(set(ends[0]) & set(ends[1]))
            out = [([], []) for _ in shared]
            for k in (0, 1):
                for i, e in zip(found[k], ends[k]):
                    out[bisect.bisect_left(shared, e)][k].append(i)
        groups.append(out)
    linked = [Counter((a, b) for x, y in g for a in x for b in y) for g in groups]
    docs = Counter(p for c in linked for p in c)
    most = Counter()
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    rows = []
    for g, c in zip(groups, linked):
        text = ";".join("|".join(",".join(map(str, side)) for side in pair) for pair in g)
        rows.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()),
                     sum(n for p, n in c.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in c.items()),
                     hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return rows, {(a, b): (n, n == most[a]) for (a, b), n in docs.items()}


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_links_as_by_hand(documents, prose):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(prose(k, rng.randint(1, 60))).capitalize() + rng.choice([".", "\n", " !", ""]) for k in range(60)]
    texts += [texts[0]] * 7
    found = Alignment(documents(list(enumerate(texts))).repartition(5))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in found.documents().collect()}
    want, pairs = by_hand(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert {(r.a, r.b): (r.docs, r.best) for r in found.table().collect()} == pairs
    # the cases: texts that are not spelled, and links in groups of several tokens
    assert want[2] == want[3] == (0, 0, 0, 0, 0, 0, "") and want[TEXTS.index("piece mark \u2581 inside")][0] == 0
    assert any(w[3] > max(w[0], w[1]) for w in want)


def test_small_blocks_and_caches_change_nothing(documents, prose, monkeypatch):
    texts = [" ".join(prose(k % 9, 40)) + " <x>\n" * (k % 3) for k in range(50)]
    enc = encoder(*PATHS)
    data = [(" " + t).encode() for t in texts]
    whole = np.frombuffer(b"".join(data), np.uint8)
    offsets = np.cumsum([0, *map(len, data)])
    want = alignment.aligned(*enc.encode(whole, offsets), enc)
    monkeypatch.setattr(alignment, "CACHE_SEGMENTS", 30)
    again = alignment.Encoder(*PATHS)
    for k in range(len(texts)):
        one = alignment.aligned(*again.encode(np.frombuffer(data[k], np.uint8), np.array([0, len(data[k])])), again)
        assert one["digests"][0] == want["digests"][k] and one["n_links"][0] == want["n_links"][k]


@pytest.mark.parametrize("seed", range(3))
def test_segments_as_whole_texts(seed):
    """Ids of segments put together are the ids of the whole text."""
    rng, enc = random.Random(seed), encoder(*PATHS)
    marks = list("ab \n\t\r.,'_-") + ["\u00a0", "\u2003", "\u2028", "\u3000", "\u2581", "\x1c", "\u0085", "é", "ß", "日", "😀",
                                      " ", "  ", "\n", "'s", " don't", "12", ";\r"]
    for _ in range(400):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(1, 40)))
        data = (" " + text).encode()
        lists, right = enc.encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        want = tokens(text)
        assert right[0] == (want is not None), repr(text)
        if want:
            assert [x[0].as_py() for x in lists] == [list(w) for w in want], repr(text)


def test_odd_tables(documents, spark):
    empty = Alignment(documents([]).limit(0))
    assert empty.documents().collect() == [] and empty.table().collect() == []
    nothing = Alignment(documents([(1, None), (None, ""), (None, "")]))
    assert sorted((r.doc_id is None, r.n_a, r.groups_sha256) for r in nothing.documents().collect()) == [(False, 0, "")] + [(True, 0, "")] * 2
    rows = documents([(1, "same text"), (1, "same text"), (None, "same text")]).withColumns(
        {"pair": F.lit("x"), "pairs": F.lit(1), "row": F.lit(2.0), "docs": F.lit("d")})
    assert {(r.n_best, r.count_sum) for r in Alignment(rows).documents().collect()} == {(2, 6)}


def test_long_text(documents):
    text = "long words and more " * 20_000
    got = Alignment(documents([(1, text), (2, "short")])).documents().where("doc_id = 1").first()
    want, _ = by_hand([text, "short"])
    assert tuple(got[c] for c in COLUMNS) == want[0]
