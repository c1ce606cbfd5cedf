import math
import random

import pytest

from tissuegrid.llm.topn import ranked, top_n

SCHEMA = "g string, i long, s double, rank string, need int"


def by_hand(rows, n):
    of = {}
    for g, i, s, *_ in rows:
        if g is not None and i is not None and s is not None and not math.isnan(s):
            of.setdefault(g, set()).add((-s, i))
    return {(g, i) for g, v in of.items() for _, i in sorted(v)[:n]}


def check(spark, rows, n):
    got = [(r.g, r.i) for r in top_n(spark.createDataFrame(rows, SCHEMA), "g", "i", "s", n).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(rows, n)


@pytest.mark.parametrize("n", [1, 3, 50])
def test_random(spark, n):
    r = random.Random(n)
    draw = [lambda: float(r.randint(0, 20)), lambda: r.gauss(0, 1e6), lambda: r.choice([0.0, -0.0, 1e300, -1e300, math.inf, -math.inf, math.nan, None, 5e-324]), lambda: 7.0]
    rows = [(f"g{k % 9}" if k % 31 else None, r.randint(-(10**15), 10**15), draw[k % 9 % 4](), "x", 1) for k in range(3000)]
    check(spark, rows + rows[:500], n)


def test_ties_only(spark):
    rows = [("a", k, 1.0, "x", 1) for k in random.Random(1).sample(range(10**12), 4000)]
    check(spark, rows, 7)
    check(spark, [("a", k, 1.0, "x", 1) for k in (-(2**63), 2**63 - 1, 0)], 2)


def test_small_groups_and_empty(spark):
    check(spark, [("a", 1, 2.0, "x", 1), ("b", 1, None, "x", 1), (None, 1, 3.0, "x", 1)], 3)
    assert top_n(spark.createDataFrame([], SCHEMA), "g", "i", "s", 3).count() == 0
    with pytest.raises(ValueError):
        top_n(spark.createDataFrame([], SCHEMA), "g", "i", "s", 0)


def test_ranks(spark):
    df = spark.createDataFrame([("a", k, float(k % 3), "x", 1) for k in range(9)], SCHEMA)
    got = ranked(top_n(df, "g", "i", "s", 4), "g", "i", "s").collect()
    assert sorted((r["rank"], r.i) for r in got) == [(1, 2), (2, 5), (3, 8), (4, 1)]
