import random
import re

import pytest
from check_oracle import compare, duck
from pyspark.sql import functions as F

from tabulith.llm import components as C
from tabulith.llm import forest as D
from tabulith.llm.registry import ORACLES


def brute_force(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = set() if not w else {tuple(w)} if len(w) < size else {tuple(w[k:k + size]) for k in range(len(w) - size + 1)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def planted(prose, seed):
    rng = random.Random(seed)
    rows = []
    for base in range(40):
        words = prose(base, rng.randint(1, 150))
        if base % 4 == 0:  # many unrelated documents share a passage
            words = prose(999, 60) + words
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = [rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in words]
            rows.append((len(rows) * 3, " ".join(copy)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, documents, prose, seed):
    rows = planted(prose, seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in D.near_duplicates(documents(rows), 4, 80).collect()}
    assert got == brute_force(rows, 4, 80)


def test_a_large_group_over_many_partitions(spark, documents, prose, monkeypatch):
    """Copies that all differ: windows cover a small part of the group, borders cut it."""
    monkeypatch.setattr(D, "PARTITION_ROWS", 100)
    rng = random.Random(5)
    words = prose(1, 120)
    rows = []
    for i in range(600):
        copy = list(words)
        copy[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(10_000 + i, " ".join(prose(100 + i, 80))) for i in range(50)]
    found = D.near_duplicates(documents(rows).repartition(7), 4, 80).collect()
    assert {r["component_id"] for r in found if r["doc_id"] < 10_000} == {0}
    assert all(r["kept"] for r in found if r["doc_id"] >= 10_000)


def test_edge_rows(documents):
    text = "one two three four five six"
    rows = [(None, text), (1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A\tB"), (6, "b a"), (7, text), (7, text), (8, text),
            (9, "long " * 200_000), (10, "long " * 300_000)]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_shingles"], r["component_id"], r["kept"])
                 for r in D.near_duplicates(documents(rows), 4, 80).collect())
    assert got == [((False, 1), 0, 1, True), ((False, 2), 0, 2, True), ((False, 3), 0, 3, True), ((False, 4), 1, 4, True),
                   ((False, 5), 1, 4, False), ((False, 6), 1, 6, True), ((False, 7), 3, 7, True), ((False, 7), 3, 7, True),
                   ((False, 8), 3, 7, False), ((False, 9), 1, 9, True), ((False, 10), 1, 9, False), ((True, 0), 3, None, True)]
    assert D.near_duplicates(documents([])).count() == 0


def test_equals_sql(spark, sf):
    assert compare(D.op2(spark, sf), duck(sf), ORACLES["op2_lsh_forest_near_dedup"]) is None


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + rng.randint(1, 400)) for _ in range(500)] + [(5000, 5000)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(c == 1000 for n, c in got.items() if n >= 1000)
    assert 5000 not in got
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_broadcast_only_up_to_the_limit(spark):
    rows = spark.createDataFrame([("x" * 100,)], "s string")
    small, large = C.sized(rows, "s"), C.sized(rows, "s", limit=100)
    assert "broadcast" in small._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in large._jdf.queryExecution().logical().toString().lower()
    assert C.sized(rows.select(F.lit(1).alias("a"))).count() == 1


def test_similar_documents_in_a_long_region(spark, documents, prose):
    """Documents of one template that are not similar to each other, and a near copy of each: windows reach few of a region."""
    rng = random.Random(3)
    template, rows = prose(1, 120), []
    for k in range(1000):
        words = template + [f"own{k}_{i}" for i in range(20)]
        rows.append((k, " ".join(words)))
        for at in rng.sample(range(4, 116), 3):
            words[at] = f"new{k}_{at}"
        rows.append((5000 + (k * 7919) % 1000, " ".join(words)))
    of = {5000 + (k * 7919) % 1000: k for k in range(1000)}
    got = {r["doc_id"]: r["component_id"] for r in D.near_duplicates(documents(rows), 4, 80).collect()}
    assert got == {i: of.get(i, i) for i in got} and len(got) == 2000
