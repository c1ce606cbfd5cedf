import math
import random

import numpy as np
from pyspark.sql import functions as F

from tissuegrid.llm.hnsw import Graph
from tissuegrid.llm.neighbours import nearest
from tissuegrid.operators.nearest import Shards
from tissuegrid.operators.nearest import nearest as exact

SCHEMA = "id long, a double, b double, c double, query long, node long"
SPACE = ["a", "b", "c"]


def by_hand(rows, k, limit=math.inf, asked=lambda i: True):
    points = sorted({r[:4] for r in rows if all(v is not None and not math.isnan(v) for v in r[1:4]) and r[0] is not None})
    out = {}
    for i, *v in points:
        if asked(i):
            near = sorted((math.dist(v, w), j) for j, *w in points if j != i)
            out[i] = [(j, d) for d, j in near[:k] if d <= limit]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query"], r["rank"])):
        out.setdefault(r["query"], []).append((r["neighbour"], r["distance"]))
    return out


def sample(n=900):
    r = random.Random(4)
    rows = [(k * 7, r.gauss(0, 1) + (k % 5) * 3, r.gauss(0, 1), r.gauss(0, 1), 0, 0) for k in range(n)]
    rows += [(10_000 + k, 1.0, 1.0, 1.0, 0, 0) for k in range(n // 3)]  # a third are equal
    rows += [(20_001, None, 1.0, 1.0, 0, 0), (20_002, math.nan, 1.0, 1.0, 0, 0), (None, 1.0, 1.0, 1.0, 0, 0), (20_003, -0.0, 0.0, 0.0, 0, 0), (20_004, 0.0, 0.0, 0.0, 0, 0)]
    return rows + rows[:100]


def same(got, want):
    for i, near in want.items():
        assert [d for _, d in got.get(i, [])] == [d for _, d in near] or np.allclose([d for _, d in got.get(i, [])], [d for _, d in near], atol=1e-12)
    assert {i for i, v in want.items() if v} == set(got)


def test_exact_over_many_shards(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    same(collected(exact(df, "id", SPACE, 4, shards=Shards(60, 300, 50))), by_hand(rows, 4))
    same(collected(exact(df, "id", SPACE, 3, limit=0.3, shards=Shards(60))), by_hand(rows, 3, 0.3))
    got = collected(exact(df, "id", SPACE, 2, queries=F.col("id") % 100 == 0, shards=Shards(60)))
    same(got, by_hand(rows, 2, asked=lambda i: i % 100 == 0))


def test_equal_rows_are_neighbours_by_id(spark):
    df = spark.createDataFrame([(k, 1.0, 1.0, 1.0, 0, 0) for k in range(50)], SCHEMA)
    got = collected(exact(df, "id", SPACE, 3))
    assert [j for j, _ in got[0]] == [1, 2, 3] and [j for j, _ in got[2]] == [0, 1, 3] and [j for j, _ in got[40]] == [0, 1, 2]


def test_blocks_few_rows_and_empty(spark):
    rows = [(1, 0.0, 0.0, 0.0, 1, 0), (2, 0.0, 0.0, 0.1, 1, 0), (3, 0.0, 0.0, 0.0, 2, 0), (4, 0.0, 0.0, 0.0, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {i: [j for j, _ in v] for i, v in collected(exact(df, "id", SPACE, 5, ["query"])).items()} == {1: [2], 2: [1]}
    assert nearest(df.limit(0), "id", SPACE, 3).count() == 0
    assert nearest(df.limit(1), "id", SPACE, 3).count() == 0


def test_shards_cut_twice(spark, monkeypatch):
    """Where the sample on the driver tells fewer shards apart than there are, each is cut again; the result stays exact."""
    import tissuegrid.operators.nearest as core

    monkeypatch.setattr(core, "MOST", 40)
    rows = sample(900)
    df = spark.createDataFrame(rows, SCHEMA)
    same(collected(exact(df, "id", SPACE, 4, shards=Shards(16, 40, 50))), by_hand(rows, 4))
    same(collected(exact(df, "id", SPACE, 3, limit=0.3, shards=Shards(16, 40))), by_hand(rows, 3, 0.3))


def test_small_world_recall(spark):
    rows = sample(3000)
    df = spark.createDataFrame(rows, SCHEMA)
    want = by_hand(rows, 5, asked=lambda i: i % 49 == 0)
    got = collected(nearest(df, "id", SPACE, 5, queries=F.col("id") % 49 == 0, shard=500))
    near = lambda v: {round(d, 9) for _, d in v}
    hits = sum(len(near(got[i]) & near(v)) / len(near(v)) for i, v in want.items())
    assert hits / len(want) > 0.98


def test_recall_on_features_over_half(spark):
    """Against brute force over all cells for the queries of the registered query."""
    from tissuegrid.llm.feature_queries import _space

    cells, space = _space(spark, "/root/testdata/sf0.01")
    asked = F.col("cell_id") % 100 == 0
    got = {(r["query"], r["neighbour"]) for r in nearest(cells, "cell_id", space, 10, queries=asked, shard=1000).collect()}
    want = {(r["query"], r["neighbour"]) for r in exact(cells, "cell_id", space, 10, queries=asked).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_recall_of_all_neighbours(spark):
    """p5_all searches every shard a neighbour may lie in; compared for every hundredth cell."""
    from tissuegrid.llm.feature_queries import _space, p5_all

    folder = "/root/testdata/sf0.01"
    got = {(r["query"], r["neighbour"]) for r in p5_all(spark, folder).filter("query % 100 = 0").collect()}
    cells, space = _space(spark, folder)
    want = {(r["query"], r["neighbour"]) for r in exact(cells, "cell_id", space, 10, queries=F.col("cell_id") % 100 == 0).collect()}
    assert len(want) > 300 and len(got & want) / len(want) >= 0.9


def test_graph_is_flat_and_connected():
    v = np.random.RandomState(0).randn(3000, 5)
    g = Graph.build(v, 8, 32)
    assert [len(x) for x in g.layers] == sorted((len(x) for x in g.layers), reverse=True) and g.layers[0].shape == (3000, 16)
    seen, todo = {0}, [0]
    while todo:
        for j in g.layers[0][todo.pop()]:
            if j >= 0 and j not in seen:
                seen.add(int(j))
                todo.append(int(j))
    assert len(seen) > 2990
