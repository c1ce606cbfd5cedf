import math

import pytest
from pyspark.sql import functions as F

from tissuegrid.operators import diffusion, graph, matrix, spatial


@pytest.fixture(scope="module")
def line(spark):
    """Points 0, 1, 2, 10, 11, 12 on a line: two triples whose members are each other's neighbours."""
    cells = spark.createDataFrame([(k, float(x), 0.0) for k, x in enumerate((0, 1, 2, 10, 11, 12))], "cell long, x double, y double")
    return cells, spatial.knn_edges(cells, "cell", ["x", "y"], 2, []).persist()


def entries(df, *keys):
    return {tuple(r[k] for k in keys[:-1]): r[keys[-1]] for r in df.collect()}


def equal_weights(cells):
    return graph.node_weights(cells.withColumn("h", F.lit(0.3)), "h").select("cell", "weight")


def test_shared_neighbours(line):
    _, knn = line
    triples = [(a, b) for t in ((0, 1, 2), (3, 4, 5)) for a in t for b in t if a != b]
    assert entries(graph.shared_neighbours(knn, 2), "i", "j", "w") == dict.fromkeys(triples, 0.5)
    assert entries(graph.shared_neighbours(knn, 2, True), "i", "j", "w") == dict.fromkeys(triples, 0.5)
    assert graph.asymmetric(graph.shared_neighbours(knn, 2)).count() == 0


def test_transition_and_inflation(line):
    cells, knn = line
    edges, weights = graph.shared_neighbours(knn, 2), equal_weights(cells)
    t = entries(graph.transition(edges, weights, 0.8), "dst", "src", "t")
    assert t[0, 0] == pytest.approx(0.2) and t[0, 1] == pytest.approx(0.4) and (0, 3) not in t
    both = entries(graph.inflated(edges, weights, 0.8, 0.0), "dst", "src", "t")
    assert both[0, 0] == pytest.approx(0.04) and both[0, 1] == pytest.approx(0.48)
    assert sum(v for (i, _), v in both.items() if i == 0) == pytest.approx(1)


def test_isolated_and_unweighted_cells(spark, line):
    cells, knn = line
    more = cells.unionByName(spark.createDataFrame([(9, 500.0, 0.0)], cells.schema))
    t = entries(graph.transition(graph.shared_neighbours(knn, 2), equal_weights(more), 0.8), "dst", "src", "t")
    assert {k: round(v, 12) for k, v in t.items() if k[0] == 9} == {(9, 9): 0.2}
    plain = entries(graph.transition(graph.shared_neighbours(knn, 2), equal_weights(cells), 0.8, weigh=False), "dst", "src", "t")
    assert plain[0, 0] == 0 and plain[0, 1] == pytest.approx(0.5)
    assert graph.transition(graph.shared_neighbours(knn.limit(0), 2), equal_weights(cells), 0.8).count() == 6


def test_node_weights(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 3.0)], "cell long, h double")
    w = entries(graph.node_weights(df, "h"), "cell", "weight")
    assert w[1,] == 1 and w[2,] == pytest.approx(math.exp(-1)) and w[3,] == pytest.approx(math.exp(-0.5))


def test_hops_and_lists(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (2, 1, 1.0)], "i long, j long, w double")
    assert set(map(tuple, graph.two_hops(edges).collect())) == {(1, 3), (1, 1), (2, 2)}
    lists = graph.neighbour_lists(edges)
    assert entries(lists, "i", "neighbours") == {(1,): [2], (2,): [1, 3]}
    assert set(map(tuple, graph.edges_of(lists).collect())) == set(map(tuple, edges.collect()))
    new = spark.createDataFrame([(2, [7])], "i long, neighbours array<long>")
    assert {(r.i, r.j) for r in graph.replaced(edges, new).collect()} == {(1, 2), (2, 7)}


def long(spark, columns):
    return spark.createDataFrame([(k, g, float(v)) for g, vs in columns.items() for k, v in enumerate(vs)], "cell long, gene string, value double")


def test_quantile_alignment(spark):
    a, b = long(spark, {"g": (3, 1, 2)}), long(spark, {"g": (10, 20, 30)})
    # Ranges of ten rows or fewer are the extremes: both sides are -1, 0, 1, so the reference's values come back in the order of `a`.
    assert entries(diffusion.stabilize(a, b), "cell", "gene", "value") == {(0, "g"): 30, (1, "g"): 10, (2, "g"): 20}
    tied = entries(diffusion.stabilize(long(spark, {"g": (1, 1, 2)}), b), "cell", "gene", "value")
    assert tied[0, "g"] == tied[1, "g"] == pytest.approx(12.5) and tied[2, "g"] == 30


def test_constant_gene_stays(spark):
    a, b = long(spark, {"g": (4, 5, 6), "h": (1, 1, 1)}), long(spark, {"g": (7, 7, 7), "h": (1, 2, 3)})
    got = entries(diffusion.stabilize(a, b), "cell", "gene", "value")
    assert {got[k, "g"] for k in range(3)} == {7}


def test_diffusion_keeps_range_and_spread(spark, line):
    cells, knn = line
    t = graph.transition(graph.shared_neighbours(knn, 2), equal_weights(cells), 0.8)
    s = long(spark, {"g": (1, 5, 2, 8, 9, 4), "c": (3,) * 6})
    plain = entries(diffusion.diffuse(s, t, 3, stabilized=False)[3], "cell", "gene", "value")
    assert all(1 <= v <= 9 for (_, g), v in plain.items() if g == "g")
    assert all(v == pytest.approx(3) for (_, g), v in plain.items() if g == "c")
    frames = diffusion.diffuse(s, t, 2, [1, 2])
    assert set(frames) == {1, 2}
    kept = [v for (_, g), v in entries(frames[2], "cell", "gene", "value").items() if g == "g"]
    assert min(kept) == pytest.approx(1) and max(kept) == pytest.approx(9)


def test_two_iterations_by_formula(spark):
    """Two cells swap halves: worked out by hand from S' = T S and the alignment with the iteration before (up to 10 cells: ranges are the extremes).

    S = (0, 4, 8); T S = (2, 4, 7). Scaled: (-1, -0.2, 1) and (-1, 0, 1); targets (-1, -0.1, 1) in [0, 8] give (0, 3.6, 8).
    T of that = (1.8, 3.6, 6.9). Scaled: 2 * 1.8 / 5.1 - 1 = -0.294118; the iteration before scaled has -0.1 there, the first one 0.
    Target (-0.294118 - 0.1) / 2 = -0.197059, in [0, 8]: 3.211765. Against the first iteration it would be 3.411765.
    """
    s = long(spark, {"g": (0, 4, 8)})
    t = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5), (1, 1, 1.0), (2, 2, 0.75), (2, 1, 0.25)], "dst long, src long, t double")
    got = diffusion.diffuse(s, t, 2, [1, 2])
    one, two = (entries(got[k], "cell", "gene", "value") for k in (1, 2))
    assert [one[k, "g"] for k in range(3)] == pytest.approx([0, 3.6, 8])
    assert [two[k, "g"] for k in range(3)] == pytest.approx([0, 3.2117647, 8], abs=1e-6)


@pytest.mark.parametrize("chunk, row, edges, width", [(262_144, 200_000, 40_000, 128), (16, 200_000, 40, 2), (16, 20, 40, 2)])
def test_diffusion_equals_matrices(spark, monkeypatch, chunk, row, edges, width):
    """Also where genes are ranked in several buckets, tiles are small, and rows of many edges are cut."""
    import numpy as np

    from tissuegrid.operators import blocks

    for name, v in (("CHUNK", chunk), ("ROW", row), ("EDGES", edges), ("WIDTH", width)):
        monkeypatch.setattr(blocks, name, v)
    r, n, genes = np.random.RandomState(3), 60, 3
    s = np.where(r.rand(n, genes) < 0.4, 0, np.round(r.gamma(2, 2, (n, genes)), 1))
    s[:, 0] = 3
    t = np.zeros((n, n))
    for i in range(n):
        j = r.choice(n, n if i == 0 else 4, replace=False)
        t[i, j] = r.rand(len(j))
    t /= t.sum(axis=1, keepdims=True)

    def aligned(new, ref):
        out = np.empty_like(new)
        for g in range(genes):
            (al, au), (bl, bu) = (np.quantile(x[:, g], (5 / n, 1 - 5 / n)) for x in (new, ref))
            scale = lambda v, lo, hi: v - hi if lo == hi else (v - lo) / (hi - lo) * 2 - 1
            x, y = scale(new[:, g], al, au), np.sort(scale(ref[:, g], bl, bu))
            goal = (np.sort(x) + y) / 2
            out[:, g] = [0.5 * (goal[np.sort(x) == v].mean() + 1) * (bu - bl) + bl for v in x]
        return out

    want = s
    for _ in range(2):
        want = aligned(t @ want, want)
    stored = spark.createDataFrame([(i, f"g{g}", float(s[i, g])) for i in range(n) for g in range(genes) if s[i, g]], "cell long, gene string, value double")
    table = spark.createDataFrame([(int(i), int(j), float(t[i, j])) for i, j in zip(*np.nonzero(t))], "dst long, src long, t double")
    got = entries(diffusion.diffuse(stored, table, 2)[2], "cell", "gene", "value")
    assert len(got) == n * genes and max(abs(v - want[c, int(g[1:])]) for (c, g), v in got.items()) < 1e-9


def test_diffusion_of_nothing(spark):
    none, table = long(spark, {"g": (1,)}).limit(0), spark.createDataFrame([(0, 0, 1.0)], "dst long, src long, t double")
    assert diffusion.diffuse(none, table, 2)[2].count() == 0 and diffusion.diffuse(long(spark, {"g": (1,)}), table.limit(0), 2)[2].count() == 0
    assert diffusion.stabilize(none, none).count() == 0
    holes = spark.createDataFrame([(0, "g", None), (1, "g", float("nan")), (2, "g", 4.0)], "cell long, gene string, value double")
    got = entries(diffusion.diffuse(holes, spark.createDataFrame([(k, k, 1.0) for k in range(3)], "dst long, src long, t double"), 1)[1], "cell", "gene", "value")
    assert got == {(0, "g"): 0, (1, "g"): 0, (2, "g"): 4}


def test_frames():
    assert diffusion.frames_to_write(20, 10) == [10, 20] and diffusion.frames_to_write(15, 10) == [10] and diffusion.frames_to_write(5, 10) == []


def test_samples_do_not_depend_on_partitions(spark, line):
    cells, knn = line
    edges = knn.withColumn("w", F.lit(1.0))
    s = long(spark, {"g": (1, 5, 2, 8, 9, 4)})
    one, two = (entries(diffusion.sample(s.repartition(n), edges, 3, steps=2), "cell", "gene", "value") for n in (1, 7))
    assert one == two and min(one.values()) >= 0


def test_robust_scaling(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 5.0), ("a", 10.0), ("b", 7.0), ("b", 7.0)], "g string, v double")
    q = matrix.quantile_range(df, "v", ["g"], 0, 1)
    got = df.join(q, "g").select("g", matrix.robust_scaled(F.col("v"), F.col("ql"), F.col("qu")).alias("t"))
    assert sorted(map(tuple, got.collect())) == [("a", -1.0), ("a", 0.0), ("a", 1.0), ("b", 0.0), ("b", 0.0)]
    back = got.filter("g = 'a'").select(matrix.robust_restored(F.col("t"), F.lit(2.0), F.lit(4.0)).alias("v"))
    assert sorted(r.v for r in back.collect()) == [2.0, 3.0, 4.0]


def test_standardize_and_minmax_of_constant_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0)], "cell long, a double, b double")
    assert [tuple(r) for r in matrix.standardize(df, ["a", "b"]).orderBy("cell").collect()] == [(1, -1.0, 0.0), (2, 1.0, 0.0)]
    assert [tuple(r) for r in matrix.minmax(df, ["a", "b"]).orderBy("cell").collect()] == [(1, 0.0, 0.0), (2, 1.0, 0.0)]
