import random
from itertools import combinations

import tissuegrid.llm.setsim as setsim
from tissuegrid.llm.setsim import Bands, similar_sets

SCHEMA = "name string, item string, id long, size int"


def by_hand(rows, threshold):
    sets = {}
    for n, i, *_ in rows:
        if n is not None and i is not None:
            sets.setdefault(n, set()).add(i)
    return sets, {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def sample():
    r = random.Random(2)
    hubs = [f"hub{k}" for k in range(4)]
    rows = []
    for s in range(120):
        size = r.choice([1, 2, 8, 30, 200])
        base = [f"w{r.randint(0, 4000)}" for _ in range(size)] + r.sample(hubs, 2)
        rows += [(f"s{s}", w) for w in base]
        for c in range(r.choice([0, 0, 1, 3])):  # a near copy
            rows += [(f"s{s}c{c}", w) for w in base if r.random() > 0.1] + [(f"s{s}c{c}", f"n{s}{c}")]
        if s % 10 == 0:
            rows += [(f"s{s}same{c}", w) for w in base for c in range(3)]
    rows += [(f"copy{k}", w) for k in range(40) for w in ("a", "b", "c")]
    return [(*x, 0, 0) for x in rows + rows[:50]] + [(None, "a", 0, 0), ("s1", None, 0, 0), ("void", None, 0, 0)]


def check(spark, threshold):
    rows = sample()
    sets, pairs = by_hand(rows, threshold)
    got = similar_sets(spark.createDataFrame(rows, SCHEMA), "name", "item", threshold)
    found = {(r.set_a, r.set_b): r.similarity for r in got.expanded().collect()}
    assert set(found) == set(pairs) and all(abs(found[k] - pairs[k]) < 1e-12 for k in pairs)
    links = {r.name: (r.size, r.copies, r.links) for r in got.links().collect()}
    for n, s in sets.items():
        assert links[n] == (len(s), sum(s == t for t in sets.values()), sum(n in k for k in pairs))
    assert set(links) == set(sets)


def test_all_pairs(spark):
    check(spark, 0.6)


def test_sets_cut_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(setsim, "PART", 20)
    check(spark, 0.6)


def test_empty_and_single(spark):
    df = spark.createDataFrame([], SCHEMA)
    got = similar_sets(df, "name", "item")
    assert got.expanded().count() == 0 and got.links().count() == 0
    one = similar_sets(spark.createDataFrame([("a", "x", 0, 0)], SCHEMA), "name", "item")
    assert [(r.copies, r.links) for r in one.links().collect()] == [(1, 0)]


def test_missed_share():
    assert Bands().missed(0.6) < 1e-7
