import math
import random

from tissuegrid.llm.spectral import Spectral, clusters, describe

XY = {"x": "x", "y": "y"}
SCHEMA = "id long, s string, x double, y double, n int, node long"


def sample():
    """Groups of diameter below 3 that lie more than 3 apart, on a grid of step 7."""
    r = random.Random(6)
    rows, groups, k = [], [], 0
    for s in ("p", "q"):
        for gx in range(8):
            for gy in range(6):
                size = r.choice([1, 2, 3, 9, 120 if gx == gy else 5])
                ids = []
                for _ in range(size):
                    k += 1
                    a, d = r.uniform(0, 6.3), r.uniform(0, 1.49)
                    rows.append((k * 13 % 100_003, s, gx * 7 + d * math.cos(a), gy * 7 + d * math.sin(a), 1, 1))
                    ids.append(rows[-1][0])
                groups.append(frozenset(ids))
    junk = [(200_001, None, 1.0, 1.0, 1, 1), (200_002, "p", None, 1.0, 1, 1), (200_003, "p", math.nan, 1.0, 1, 1), (None, "p", 1.0, 1.0, 1, 1)]
    return rows + junk + rows[:60], groups


def grouped(df):
    of = {}
    for r in df.collect():
        of.setdefault(r.group_id, set()).add(r.id)
    assert all(g == min(v) for g, v in of.items())
    return {frozenset(v) for v in of.values()}


def test_groups_apart(spark):
    rows, groups = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    assert grouped(clusters(df, "id", ["s"], XY, Spectral(3.0))) == set(groups)


def test_typical_members(spark):
    rows, groups = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    told = describe(clusters(df, "id", ["s"], XY, Spectral(3.0)), "id", ["s"], ["x", "y"], 3.0, 3).collect()
    at = {r[0]: r[2:4] for r in rows if r[0]}
    assert len(told) == len(groups)
    for r in told:
        ids = next(g for g in groups if r.group_id in g)
        assert r["size"] == len(ids) and len(r.typical) == min(3, len(ids))
        affinity = {i: round(sum(1 - math.dist(at[i], at[j]) ** 2 / 9 for j in ids) / len(ids), 9) for i in ids}
        best = sorted(affinity.values(), reverse=True)[: len(r.typical)]
        assert all(abs(affinity[i] - b) < 2e-9 for i, b in zip(r.typical, best))


def test_equal_points_and_empty(spark):
    df = spark.createDataFrame([(k, "p", 1.0, 1.0, 1, 1) for k in range(500)], SCHEMA)
    assert grouped(clusters(df, "id", ["s"], XY)) == {frozenset(range(500))}
    assert clusters(df.limit(0), "id", ["s"], XY).count() == 0
    assert describe(clusters(df.limit(0), "id", ["s"], XY), "id", ["s"], ["x", "y"], 3.0).count() == 0


def test_chain_is_divided_not_lost(spark):
    df = spark.createDataFrame([(k, "p", k * 1.0, 0.0, 1, 1) for k in range(200)], SCHEMA)
    found = grouped(clusters(df, "id", ["s"], XY))
    assert sum(map(len, found)) == 200 and len(found) > 1


def test_three_coordinates_and_no_block(spark):
    r = random.Random(4)
    rows, groups, k = [], [], 0
    for gx in range(4):
        for gy in range(4):
            for gz in range(3):
                ids = []
                for _ in range(r.choice([1, 4, 30])):
                    k += 1
                    rows.append((k, gx * 5.0 + r.uniform(0, 1.1), gy * 5.0 + r.uniform(0, 1.1), gz * -5.0 + r.uniform(0, 1.1)))
                    ids.append(k)
                groups.append(frozenset(ids))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    found = clusters(df, "id", [], {c: c for c in "abc"}, Spectral(2.0))
    assert grouped(found) == set(groups)
    told = describe(found, "id", [], ["a", "b", "c"], 2.0).collect()
    assert sorted(r["size"] for r in told) == sorted(map(len, groups))


def test_one_coordinate(spark):
    df = spark.createDataFrame([(k, "p", float(k // 5 * 4) + k % 5 * 0.2) for k in range(50)], "id long, s string, x double")
    assert grouped(clusters(df, "id", ["s"], {"x": "x"}, Spectral(1.0))) == {frozenset(range(5 * k, 5 * k + 5)) for k in range(10)}
