import random

import numpy as np
import pytest

from tabulith.llm import decontam as D


def items(spark, rows):
    return spark.createDataFrame([(i, t, 3) for i, t in rows], "item_id long, text string, doc_id long")


def brute_force(doc, item):
    """The most equal words on any diagonal in a stretch that qualifies, or None."""
    best = None
    for shift in range(-len(item) + 1, len(doc)):
        pairs = [(doc[shift + k] == item[k]) for k in range(len(item)) if 0 <= shift + k < len(doc)]
        for a in range(len(pairs)):
            same = 0
            for b in range(a, len(pairs)):
                same += pairs[b]
                n = b - a + 1
                if pairs[a] and pairs[b] and n >= min(D.MIN_WORDS, len(item)) and 100 * same >= 80 * n:
                    best = max(best or 0, same)
    return best


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, documents, prose, seed):
    rng = random.Random(seed)
    tests = [(i, prose(500 + 40 * seed + i, n)) for i, n in enumerate((3, 9, 14, 30, 45))]
    docs = []
    for i in range(30):
        words = prose(1000 * seed + i, rng.randint(0, 80))
        if i % 2:
            _, item = rng.choice(tests)
            copy = [w if rng.random() > 0.07 else "swapped" for w in item]
            at = rng.randint(0, len(words))
            words = words[:at] + copy + words[at:]
        docs.append((i, words))
    got = {(r["doc_id"], r["item_id"]) for r in D.overlaps(
        documents([(i, " ".join(w)) for i, w in docs]), items(spark, [(i, " ".join(t)) for i, t in tests])).collect()}
    want = {(i, j) for i, w in docs for j, t in tests if brute_force(w, t)}
    sure = {(i, j) for i, w in docs for j, t in tests if (brute_force(w, t) or 0) >= 0.9 * len(t) and len(t) > 2}
    assert got <= want and sure - got == set()


def test_any_two_substitutions_in_thirteen_words(spark, documents, prose):
    item = prose(4, 13)
    docs = [(a * 100 + b, " ".join(["x"] + [w if k not in (a, b) else "other" for k, w in enumerate(item)] + ["y"]))
            for a in range(1, 12) for b in range(a, 12)]
    found = D.overlaps(documents(docs), items(spark, [(1, " ".join(item))])).collect()
    assert {r["doc_id"] for r in found} == {i for i, _ in docs}


def test_all_single_substitutions_are_found(spark, documents, prose):
    item = prose(1, 20)
    docs = [(k, " ".join(["before"] * 3 + item[:k] + ["other"] + item[k + 1:] + ["after"])) for k in range(20)]
    found = D.overlaps(documents(docs), items(spark, [(1, " ".join(item))])).collect()
    assert {r["doc_id"] for r in found} == set(range(20))
    middle = next(r for r in found if r["doc_id"] == 9)
    assert (middle["doc_word"], middle["item_word"], middle["words"], middle["equal_words"]) == (3, 0, 20, 19)


def test_punctuation_and_case_do_not_matter(spark, documents, prose):
    item = prose(2, 15)
    text = ", ".join(w.upper() for w in item) + "!"
    assert D.overlaps(documents([(1, text)]), items(spark, [(1, " ".join(item))])).count() == 1


def test_the_join_without_tables_gives_the_same(spark, documents, prose, monkeypatch):
    tests = items(spark, [(i, " ".join(prose(50 + i, 25))) for i in range(4)])
    docs = documents([(i, " ".join(prose(i, 20) + prose(50 + i % 5, 25) + prose(90 + i, 20))) for i in range(20)])
    want = sorted(D.overlaps(docs, tests).collect())
    monkeypatch.setattr(D, "TABLE_SEEDS", 0)
    assert sorted(D.overlaps(docs, tests).collect()) == want and len(want) == 16


def test_edge_rows(spark, documents, prose):
    item = " ".join(prose(3, 16))
    rows = [(None, item), (1, None), (2, ""), (3, "?!"), (4, item), (4, item), (5, item + " " + item), (6, ("word " * 100_000) + item), (7, "a b")]
    tests = items(spark, [(1, item), (2, item), (None, item), (3, None), (4, ""), (5, "a b")])
    docs = documents(rows)
    got = sorted((r["doc_id"], r["item_id"]) for r in D.overlaps(docs, tests).collect())
    assert got == [(4, 1), (4, 2), (5, 1), (5, 2), (6, 1), (6, 2), (7, 5)]
    left = D.clean(docs, tests)
    assert left.columns == docs.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3]
    assert D.overlaps(documents([]), tests).count() == 0 and D.overlaps(docs, items(spark, [])).count() == 0


def test_best_stretch():
    equal = np.array([0, 1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 0, 0, 1], bool)
    assert D._best(equal, 80) == (1, 11)
    assert D._best(np.array([0, 0], bool), 80) == (0, 0)
    assert D._best(np.array([1] * 10 + [0] + [1] * 3, bool), 80) == (0, 14)
    assert D._best(np.array([1] * 11 + [0] * 2, bool), 80) == (0, 11)
