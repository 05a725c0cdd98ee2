import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabulith.llm import lines as L


def shingles(line, size=L.SHINGLE):
    return {line} if len(line) < size else {line[i:i + size] for i in range(len(line) - size + 1)}


def brute_force(rows, size=L.SHINGLE):
    """Dropped (doc_id, line) by all pairs of distinct lines, and the similarity of each linked pair."""
    places = defaultdict(list)
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if i is not None and line.strip(" "):
                places[line.strip(" ").lower()].append((i, k))
    forms = list(places)
    sets, by = [shingles(f, size) for f in forms], defaultdict(set)
    for n, s in enumerate(sets):
        for x in s:
            by[x].add(n)
    root = list(range(len(forms)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for n, s in enumerate(sets):
        for m in {m for x in s for m in by[x] if m < n}:
            both = len(s & sets[m])
            if 100 * both >= L.PERCENT * (len(s) + len(sets[m]) - both):
                root[find(n)] = find(m)
    groups = defaultdict(list)
    for n, f in enumerate(forms):
        groups[find(n)] += places[f]
    return {p for g in groups.values() for p in set(g) - {min(g)}}


def dropped(df):
    return {(r["doc_id"], k) for r in df.collect() for k in r["dropped_lines"]}


def test_near_all_of_brute_force_is_found(spark, sf):
    where = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{where}/documents.parquet")
    want = brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = dropped(L.deduplicated(docs))
    assert len(got & want) > 0.99 * len(want) and len(got - want) < 0.01 * len(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_lines(spark, documents, prose, seed):
    rng = random.Random(seed)
    bases = [" ".join(prose(seed * 100 + k, rng.randint(4, 30))) for k in range(40)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(bases)
            at = rng.randrange(len(line))
            text.append(rng.choice([line, line.upper() + " ", line[:at] + "x" + line[at + 1:], " ".join(prose(rng.random(), 9))]))
        rows.append((i, "\n".join(text)))
    want, got = brute_force(rows), dropped(L.deduplicated(documents(rows)))
    assert len(got & want) >= 0.97 * len(want) and got <= want | {p for p in got if p in want}


def test_plan_is_native(spark, documents):
    plan = L.deduplicated(documents([(1, "a line of some words"), (2, "a line of some words")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_text_without_dropped_lines(spark, documents):
    rows = [(1, "First line here\n\nsecond LINE here\nfirst line here "), (2, "second line here\nthird line\n\n"), (3, "third line\nThird Line")]
    got = {r["doc_id"]: (r["text"], r["dropped_lines"]) for r in L.deduplicated(documents(rows)).collect()}
    assert got == {1: ("First line here\n\nsecond LINE here", [3]), 2: ("third line\n\n", [0]), 3: ("", [0, 1])}


def test_edge_rows(spark, documents):
    rows = [(None, "same line\nsame line"), (1, None), (2, ""), (3, " \n\t"), (4, "same line"), (5, "same line"), (6, "b\nb\na"), (7, "a"),
            (8, "other line one"), (8, "other line two, of another row"), (9, "x\n" * 30_000 + "y"), (10, "long " * 100_000), (10, "long " * 100_000)]
    found = L.deduplicated(documents(rows).withColumn("dropped_lines", F.lit(1)))
    got = sorted(((r["doc_id"] or 0, r["text"] if r["text"] is None or len(r["text"]) < 50 else len(r["text"])) for r in found.collect()), key=repr)
    assert got == sorted([(0, "same line\nsame line"), (1, None), (2, ""), (3, " \n\t"), (4, "same line"), (5, ""), (6, "b\na"), (7, ""),
                          (8, "other line one"), (8, "other line two, of another row"), (9, "x\n\ny"[:1] + "\n" + "y"), (10, 500_000), (10, 500_000)], key=repr)
    assert L.deduplicated(documents([])).count() == 0


def test_a_large_bucket_makes_few_pairs(spark, documents, prose):
    """Lines that all differ in one character: stars, not all pairs."""
    line = " ".join(prose(7, 40))
    rows = [(i, f"{line[:i]}{chr(0x4E00 + i)}{line[i + 1:]}") for i in range(120)]
    known = L.signatures(L.occurrences(documents(rows))).cache()
    pairs = L.candidates(known)
    assert pairs.count() <= 2 * 120 * len(L.BANDS)
    assert dropped(L.deduplicated(documents(rows))) == {(i, 0) for i in range(1, 120)}


def test_any_five_equal_minima_share_a_band():
    from itertools import combinations
    assert len(L.BANDS) == 14
    assert all(any(set(band) <= set(five) for band in L.BANDS) for five in combinations(range(L.HASHES), 5))


def test_similar_lines_in_a_crowded_bucket(spark, documents, prose):
    """Lines of one template that are not similar to each other, and a near copy of each: the ends of a bucket are similar to few."""
    rng = random.Random(5)
    template, rows = " ".join(prose(1, 60)), []
    for k in range(400):
        line = template + " " + " ".join(prose(1000 + k, 14))
        at = rng.randrange(len(line))
        rows += [(2 * k, line), (2 * k + 1, line[:at] + "#" + line[at + 1:])]
    want, got = brute_force(rows), dropped(L.deduplicated(documents(rows)))
    assert len(want) < 800 and got == want


def test_sets_that_are_alike_make_few_pairs(spark):
    """Sets of a group are alike, but only copies with few changes are similar enough."""
    from tabulith.llm import overlaps as O
    rng = random.Random(3)
    new = lambda n: [rng.getrandbits(62) for _ in range(n)]
    sets, frame = {}, new(300)
    variants = [new(40) for _ in range(12)]
    for k in range(200):
        sets[2 * k] = set(frame) | {x for v in rng.sample(variants, 4) for x in v}
        own = list(sets[2 * k])
        sets[2 * k + 1] = set(own[:rng.randint(len(own) - 40, len(own) - 20)]) | set(new(8))
    sets |= {1000: {1}, 1001: {1, 2}, 1002: {1}}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    rows = [(i, i, list(s)) for i, s in sets.items()]
    got = {(r["a"], r["b"]) for r in O.prefix_pairs(spark.createDataFrame(rows, "id long, part long, items array<long>"), 80).collect()}
    assert want <= got and len(got) < 5 * len(want) and (1000, 1002) in got


def test_sets_similar_to_a_whole_part_are_not_met_with_each_of_its_members(spark, monkeypatch):
    from tabulith.llm import components as C
    from tabulith.llm import overlaps as O

    monkeypatch.setattr(O, "FEW", 0)
    rng = random.Random(7)
    base = list(range(100))
    # every set has six of the base's items replaced by some that others have as well
    sets = {i: frozenset(rng.sample(base, 94) + rng.sample(range(1000, 1040), 6)) for i in range(340)}
    rows = [(i, 0 if i < 300 else i, list(s)) for i, s in sets.items()]
    seen = []

    def confirm(pairs):
        found = [(r["a"], r["b"]) for r in pairs.collect()]
        seen.extend(found)
        similar = [(a, b) for a, b in found if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        return spark.createDataFrame(similar, "a long, b long")
    links = O.prefix_links(spark.createDataFrame(rows, "id long, part long, items array<long>"), 80, confirm)
    edges = [(r["a"], r["b"]) for r in links.collect()] + [(0, i) for i in range(300)]
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    every = [(a, b) for a in sets for b in sets if a < b and rows[a][1] != rows[b][1]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(every + [(0, i) for i in range(300)], "a long, b long")).collect()}
    assert got == want and len(every) > 4000 and len(seen) < len(every) / 4


@pytest.mark.parametrize("group", [256, 2])
def test_buckets_of_some_members_are_compared_without_their_items(spark, documents, prose, monkeypatch, group):
    """Only buckets of more than ``GROUP`` lines are compared by joined items; what is dropped is the same."""
    from tabulith.llm import overlaps as O

    calls, by_items = [], L.prefix_links
    monkeypatch.setattr(O, "GROUP", group)
    monkeypatch.setattr(L, "prefix_links", lambda *a: calls.append(1) or by_items(*a))
    template, rows = " ".join(prose(1, 60)), []
    for k in range(40):
        line = template + " " + " ".join(prose(1000 + k, 14))
        rows += [(2 * k, line), (2 * k + 1, line[:40 + k] + "#" + line[41 + k:])]
    want, got = brute_force(rows), dropped(L.deduplicated(documents(rows)))
    assert len(want) < 80 and got == want and bool(calls) == (group == 2)


def test_pairs_of_sketches_miss_none(spark):
    from tabulith.llm import overlaps as O
    rng = random.Random(11)
    base = [rng.getrandbits(62) for _ in range(60)]
    sets = {i: set(rng.sample(base, rng.randint(44, 60))) | {rng.getrandbits(62) for _ in range(rng.randint(0, 6))} for i in range(60)}
    sketches = O.sketched(spark.createDataFrame([(i, list(s)) for i, s in sets.items()], "id long, items array<long>"))
    members = spark.createDataFrame([(i % 2, i, i % 7) for i in sets], "key long, id long, part long")
    similar = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    want = {(a, b) for a in sets for b in sets if a < b and (b - a) % 2 == 0 and a % 7 != b % 7 and similar(a, b)}
    got = {(r["a"], r["b"]) for r in O.group_pairs(members, sketches, 80).collect()}
    every = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a long, b long")
    near = {(r["a"], r["b"]) for r in O.near_pairs(every, sketches, 80).collect()}
    assert want and want <= got and got <= near and len(near) < every.count()
    assert {(a, b) for a in sets for b in sets if a < b and similar(a, b)} <= near
