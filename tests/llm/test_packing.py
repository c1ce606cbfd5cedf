import random

import pytest

import tissuegrid.llm.packing as packing
from tissuegrid.llm.packing import fill, pack, plan

SCHEMA = "doc_id long, n long, piece string, container int"


@pytest.mark.parametrize("capacity", [1, 10, 97, 2048])
def test_plan_holds_every_length_and_wastes_little(capacity):
    r = random.Random(capacity)
    for kind in range(4):
        lengths = [min(capacity, max(1, int([r.uniform(1, capacity), r.expovariate(6 / capacity), capacity / 3, r.gauss(capacity * 0.6, 1)][kind]))) for _ in range(3000)]
        histogram = {k: lengths.count(k) for k in set(lengths)}
        patterns = plan(histogram, capacity)
        held = {}
        for n, contents in patterns:
            assert n > 0 and sum(k * c for k, c in contents) <= capacity
            for k, c in contents:
                held[k] = held.get(k, 0) + n * c
        assert held == histogram
        least = -(-sum(lengths) // capacity)
        if kind < 2 and capacity > 1:
            assert sum(n for n, _ in patterns) <= least * (1.04 if capacity > 50 else 1.2) + 2


def check(spark, rows, capacity):
    got = [tuple(r) for r in pack(spark.createDataFrame(rows, SCHEMA), "doc_id", "n", capacity).collect()]
    items = {(r[0], max(r[1] or 0, 0)) for r in rows if r[0] is not None}
    of, containers = {}, {}
    for doc, piece, length, container, offset in got:
        of.setdefault(doc, []).append((piece, length))
        if length:
            containers.setdefault(container, []).append((offset, length))
    for doc, n in items:
        pieces = sorted(of[doc])
        assert sum(x for _, x in pieces) == n and [p for p, _ in pieces] == list(range(max(1, -(-n // capacity))))
        assert all(x == capacity for _, x in pieces[:-1])
    assert len(got) == sum(max(1, -(-n // capacity)) for _, n in items)
    for inside in containers.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    return containers


def test_items_keep_apart_in_containers(spark, monkeypatch):
    r = random.Random(3)
    rows = [(k, int(r.lognormvariate(4, 1.5)), "x", 1) for k in range(2000)] + [(5000 + k, 12, "x", 1) for k in range(1000)]
    rows += [(9001, 0, "x", 1), (9002, None, "x", 1), (9003, -4, "x", 1), (9004, 100_000, "x", 1), (9005, 512, "x", 1), (9006, 513, "x", 1), (None, 5, "x", 1)] + rows[:30]
    first = check(spark, rows, 512)
    monkeypatch.setattr(packing, "RANKED", 50)
    assert len(check(spark, rows, 512)) == len(first)
    total = sum(n for _, n in {(a, max(n or 0, 0)) for a, n, *_ in rows if a is not None})
    assert len(first) <= -(-total // 512) * 1.01 + 1


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pack(df, "doc_id", "n", 10).count() == 0 and fill(pack(df, "doc_id", "n", 10), 10).count() == 0
    only = spark.createDataFrame([(1, 0, "x", 1)], SCHEMA)
    assert [tuple(r) for r in pack(only, "doc_id", "n", 10).collect()] == [(1, 0, 0, None, None)]
    with pytest.raises(ValueError):
        pack(df, "doc_id", "n", 0)
