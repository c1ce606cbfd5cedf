import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissuegrid.common import ordinals, quantiles
from tissuegrid.functions import shapes
from tissuegrid.functions.special import incomplete_beta, log_tail, smoothing_weights, student_two_sided
from tissuegrid.operators import analysis, cna, images, labels, matrix, simulate, spatial
from tissuegrid.operators.diffusion import uniform


def test_heterogeneity_and_entropy(spark):
    df = spark.createDataFrame([("s", 1.0, "a"), ("s", 3.0, "a"), ("s", 1.0, "b"), ("s", 3.0, "b"), ("one", 5.0, None), ("zero", 0.0, "a")], "spot string, v double, label string")
    cv = {r.spot: r.heterogeneity for r in labels.variation(df, ["spot"], ["v"]).collect()}
    assert cv == {"s": 0.5, "one": 0.0, "zero": None}
    e = {r.spot: r.entropy for r in labels.entropy(df, ["spot"], "label").collect()}
    assert e["s"] == pytest.approx(math.log(2)) and e["zero"] == 0 and "one" not in e


def test_majority_is_strict_and_ties_go_to_the_smaller(spark):
    df = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b"), ("t", "y"), ("t", "x"), ("n", None)], "spot string, label string")
    pick = lambda above: {r.spot: r.majority for r in labels.majority(df, ["spot"], "label", above).collect()}
    assert pick(0.6) == {"s": "a", "t": None} and pick(2 / 3) == {"s": None, "t": None} and pick(0.0) == {"s": "a", "t": "x"}


def test_spot_means_count_absent_zeros(spark):
    of = spark.createDataFrame([(1, "s"), (2, "s")], "cell long, spot string")
    e = spark.createDataFrame([(1, "g", 3.0)], "cell long, gene string, value double")
    assert labels.to_spots(e, of).first().value == 1.5 and labels.to_spots(e, of, "sum").first().value == 3


def test_polygon(spark):
    ring = "array(" + ", ".join(f"named_struct('x', {a}d, 'y', {b}d)" for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))) + ")"
    df = spark.createDataFrame([(0.5, 0.5), (1.0, 0.5), (2.0, 2.0), (0.0, 0.0)], "x double, y double").withColumn("ring", F.expr(ring))
    got = df.select(spatial.inside(F.col("x"), F.col("y"), "ring").alias("i"), spatial.signed_distance(F.col("x"), F.col("y"), "ring").alias("d")).collect()
    assert [r.i for r in got] == [True, False, False, False]
    assert [round(r.d, 6) for r in got] == [-0.5, 0.0, round(math.sqrt(2), 6), 0.0]


def test_resampled_segment(spark):
    ring = spark.createDataFrame([("p", 0, 0.0, 0.0), ("p", 1, 10.0, 0.0)], "id string, place int, x double, y double")
    assert [r.x for r in spatial.resampled(ring, ["id"], 3).orderBy("k").collect()] == [0.0, 5.0, 10.0]


def test_within_meets_all_pairs(spark):
    r = np.random.RandomState(1)
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(r.uniform(-50, 50, (200, 2)))] + [(900, None, 1.0)]
    df = spark.createDataFrame(points, "cell long, x double, y double")
    got = {(a.i, a.j) for a in spatial.radius_edges(df, 9.0, []).collect()}
    assert got == {(a, b) for a, *p in points for b, *q in points if a != b and None not in (*p, *q) and math.dist(p, q) <= 9}


def test_tiles_leave_out_lines(spark):
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (1, 1), (2, 2), (3, 1), (4, 4), (1, 2)])], "cell long, x double, y double")
    assert {(r.cell, r.tile_row, r.tile_column) for r in spatial.tiles(df, 2, 2, []).collect()} == {(1, 0, 0), (3, 0, 1)}


def test_folds(spark):
    e = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "a", 1.0), (2, "b", 3.0), (3, "a", 3.0), (3, "b", 1.0)], "cell long, gene string, value double")
    g = spark.createDataFrame([(1, "base"), (2, "base"), (3, "other")], "cell long, group string")
    got = {(r.group, r.gene): round(r.log2fc, 4) for r in analysis.log2_fold(e, g, "base").collect()}
    assert got == {("base", "a"): 0, ("base", "b"): 0, ("other", "a"): 1.0, ("other", "b"): -1.3219}


def test_student_p(spark):
    df = spark.createDataFrame([(2.228139, 10.0), (4.302653, 2.0), (0.0, 5.0), (None, 5.0), (1e9, 3.0)], "t double, df double")
    p = [r.p for r in df.select(student_two_sided(F.col("t"), F.col("df")).alias("p")).collect()]
    assert p[0] == pytest.approx(0.05, abs=1e-6) and p[1] == pytest.approx(0.05, abs=1e-6) and p[2] == 1 and p[3] is None and p[4] < 1e-20
    assert incomplete_beta([2.0], [3.0], [0.5])[0] == pytest.approx(0.6875)


def test_adjusted_chances(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.9), ("e", None)], "gene string, p double")
    assert {r.gene: round(r.p_adjusted, 6) for r in analysis.adjusted(df).collect()} == {"a": 0.04, "b": 0.04, "c": 0.04, "d": 0.9}


def test_smoothing_keeps_polynomials(spark):
    assert smoothing_weights(5, 2) == pytest.approx([-3 / 35, 12 / 35, 17 / 35, 12 / 35, -3 / 35])
    df = spark.createDataFrame([("g", k, float(k * k)) for k in range(9)], "gene string, ring int, v double")
    got = {r.ring: r.smooth for r in analysis.smoothed_series(df, ["gene"], "ring", "v", 5, 2).collect()}
    assert all(got[k] == pytest.approx(k * k) for k in range(2, 7))


def test_tail_by_hand(spark):
    """5 members, 3 drawn of 20: chance of 2 or more."""
    e = spark.createDataFrame([(1, g, float(10 - g)) for g in range(8)], "cell long, gene long, value double")
    sets = spark.createDataFrame([("s", g) for g in (0, 1, 5, 6, 7)] + [("far", g) for g in (3, 4, 5, 6, 7)] + [("few", 1)], "geneset string, gene long")
    got = {r.geneset: (r.overlap, r.score) for r in analysis.over_representation(e, sets, 3, 20).collect()}
    chance = sum(math.comb(5, k) * math.comb(15, 3 - k) for k in (2, 3)) / math.comb(20, 3)
    assert set(got) == {"s", "far"} and got["s"][0] == 2 and got["s"][1] == pytest.approx(-math.log10(chance)) and got["far"] == (0, 0.0)


def test_linear_scores(spark):
    r = np.random.RandomState(0)
    y, w = r.rand(12), np.r_[r.choice([-1.0, 1.0], 6), np.zeros(6)]
    e = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(y)], "cell long, gene long, value double")
    net = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(w) if v], "source string, gene long, weight double")
    rr = np.corrcoef(y, w)[0, 1]
    assert analysis.linear_scores(e, net, 12).first().t == pytest.approx(rr * math.sqrt(10 / (1 - rr * rr)))


def test_predictions(spark):
    df = spark.createDataFrame([("c1", "x"), ("c1", "x"), ("c2", "x"), ("c2", "y")], "cell string, label string")
    assert [tuple(r) for r in cna.conflicts(df, "cell", "label").collect()] == [("c2", "x,y")]
    assert [tuple(r) for r in cna.merged(df, "cell", "label", strict=False).collect()] == [("c1", "x")]
    with pytest.raises(Exception, match="different labels of c2"):
        cna.merged(df, "cell", "label").collect()


def test_combined_checks_keys(spark):
    a, b = spark.createDataFrame([(1, 5.0), (2, 6.0)], "k int, a double"), spark.createDataFrame([(1, 7.0), (2, 8.0)], "k int, b double")
    assert sorted(map(tuple, cna.combined([a, b], ["k"]).collect())) == [(1, 5.0, 7.0), (2, 6.0, 8.0)]
    for bad in (b.filter("k = 1"), b.unionByName(b.filter("k = 1"))):
        with pytest.raises(Exception, match="key missing or repeated"):
            cna.combined([a, bad], ["k"]).collect()
    with pytest.raises(ValueError):
        cna.combined([a, a], ["k"])


def test_chunks_are_even(spark):
    got = cna.chunks(spark.range(23).withColumnRenamed("id", "cell"), "cell", 5, 1).groupBy("chunk").count().collect()
    assert sorted(r["count"] for r in got) == [4, 4, 5, 5, 5]


def test_shapes(spark):
    texts = ['{"shapes":[{"type":"path","path":"M0,0L4,0L4,2Z"},{"type":"rect","x0":0,"y0":0,"x1":2,"y1":4},{"type":"line","x0":1}]}', '{"shapes[0].path":"M1,1L3,1L3,5Z"}', "no json", None, "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, json string")
    got = {(r.id, r.place): [(p.x, p.y) for p in r.ring] for r in shapes.polygons(df, "json", 2.0).collect()}
    assert got[0, 0] == [(0, 0), (2, 0), (2, 1), (0, 0)] and got[0, 1] == [(0, 0), (1, 0), (1, 2), (0, 2), (0, 0)]
    assert got[1, 0][0] == (0.5, 0.5) and set(got) == {(0, 0), (0, 1), (1, 0)}


def test_patches_meet_all_pixels(spark):
    pixels = spark.createDataFrame([(r, c, 1, r * c) for r in range(30) for c in range(30)], "row int, col int, label int, gray int")
    cells = spark.createDataFrame([(1, 10.9, 12.2), (2, 1.0, 29.0)], "cell int, x double, y double")
    got = images.patches(cells, pixels, 3, []).groupBy("cell").agg(F.count("*").alias("n"), F.min("col").alias("l"), F.max("row").alias("t"))
    assert {tuple(r) for r in got.collect()} == {(1, 36, 7, 14), (2, 4 * 4, 0, 29)}
    e = {r.cell: r.entropy for r in images.patch_entropy(spark.createDataFrame([(1, 0), (1, 0), (1, 5), (1, 5), (2, 3)], "cell int, gray int"), []).collect()}
    assert e == {1: 1.0, 2: 0.0}


def test_simulated_numbers(spark):
    u = spark.range(20_000).select(((F.col("id") + 0.5) / 20_000).alias("u"))
    got = u.select(simulate.poisson(F.lit(4.0), F.col("u"), 60).alias("n")).agg(F.avg("n").alias("m"), F.variance("n").alias("v")).first()
    assert got.m == pytest.approx(4, abs=0.02) and got.v == pytest.approx(4, abs=0.05)
    cells = spark.range(4000).select(F.col("id").alias("cell"), F.lit("a").alias("label"))
    changed = simulate.mislabelled(cells, "label", ["a", "b"], 0.25, 1).groupBy("label").count().collect()
    assert {r.label for r in changed} == {"a", "b"} and min(r["count"] for r in changed) == pytest.approx(1000, abs=120)


def _inverted(mean, u):
    n, p = 0, math.exp(-mean)
    c = p
    while u > c and n < 400:
        n += 1
        p *= mean / n
        c += p
    return n


def test_simulated_expression_by_hand(spark):
    cells = spark.createDataFrame([(k, f"l{k % 4}" if k % 9 else None) for k in range(300)], "cell long, cluster string")
    genes = spark.createDataFrame([*((f"g{k}", f"l{k % 5}") for k in range(12)), ("none", None), ("g0", "l3")], "gene string, cluster string")
    for low, high in (((1, 3), (10, 30)), ((0.5, 25), (60, 200))):
        got = simulate.expression(cells, genes, 5, low, high).join(cells, "cell").withColumns({"u": uniform(6, "cell", "gene"), "v": uniform(5, "gene", "cluster")}).collect()
        owners = [tuple(r) for r in genes.collect()]
        kinds = Counter((r.cell, r.gene, r.rate >= high[0]) for r in got)
        assert len(got) == 300 * 14 and kinds == Counter((c.cell, g, (g, c.cluster) == (g, k)) for c in cells.collect() for g, k in owners)
        for r in got:
            a, b = high if r.rate >= high[0] else low
            assert r.rate == pytest.approx(a + (b - a) * r.v, rel=1e-12) and r.value == _inverted(r.rate, r.u)
        assert max(r.value for r in got) > high[1] / 2
    assert {(r.rate, r.value) for r in simulate.expression(cells, genes, 5, (0, 0), (0, 0)).collect()} == {(0.0, 0)}


def test_many_counts_are_drawn_by_several_tasks_in_time(spark):
    cells = spark.range(0, 6000, 1, 1).select(F.col("id").alias("cell"), F.concat(F.lit("l"), (F.col("id") % 700).cast("string")).alias("cluster"))
    genes = spark.range(800).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("gene"), F.concat(F.lit("l"), (F.col("id") % 700).cast("string")).alias("cluster")).coalesce(1)
    began = time.monotonic()
    got = simulate.expression(cells, genes, 1)
    assert got.select("cell").rdd.getNumPartitions() > 2
    sums = got.agg(F.count("*").alias("n"), F.sum("value").alias("v"), F.sum("rate").alias("r")).first()
    assert sums.n == 4_800_000 and sums.v / sums.r == pytest.approx(1, abs=0.002)
    assert time.monotonic() - began < 40  # where every step of every count is interpreted, it takes minutes


def test_perturbed_keeps_degrees(spark):
    edges = spark.createDataFrame([(i, (i + d) % 200) for i in range(200) for d in (1, 2, 3)], "i long, j long")
    wider = spark.createDataFrame([(i, (i + d) % 200) for i in range(200) for d in range(1, 10)], "i long, j long")
    got = simulate.perturbed(edges, wider, 0.5, 1.5, 3)
    assert {r["count"] for r in got.groupBy("i").count().collect()} == {3} and got.distinct().count() == 600
    assert 0 < got.join(edges, ["i", "j"], "left_anti").count() < 300


def test_ordinals_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).alias("v"), F.col("id"))
    got = ordinals(df.repartition(7), ["g"], ["v", "id"], "place").collect()
    for g in range(3):
        ours = sorted((r.v, r.id, r.place) for r in got if r.g == g)
        assert [p for *_, p in ours] == list(range(len(ours)))


def test_stages_are_cleared(spark):
    from tissuegrid.common import clear_stages, stage

    staged = stage(spark.range(5))
    assert staged.count() == 5
    clear_stages(spark)
    with pytest.raises(Exception, match="(?i)not.exist|no such|not found"):
        stage(staged).count()


def test_quantiles_over_partitions(spark):
    r = np.random.RandomState(3)
    values = {"a": r.randint(0, 9, 500).astype(float), "b": r.randn(333), "c": np.array([4.0]), "d": np.array([np.nan])}
    df = spark.createDataFrame([(g, float(v), 1) for g, vs in values.items() for v in vs] + [("b", None, 1)], "g string, v double, _n int")
    got = {x.g: x for x in quantiles(df.repartition(9), ["g"], "v", {"low": 0.1, "mid": 0.5, "top": 1.0}).collect()}
    assert set(got) == {"a", "b", "c"}
    for g in got:
        assert [got[g].low, got[g].mid, got[g].top] == pytest.approx(list(np.quantile(values[g], [0.1, 0.5, 1.0])))
    assert quantiles(df.filter("g = 'c'"), [], "v", {"q": 0.3}).first().q == 4 and quantiles(df.limit(0), ["g"], "v", {"q": 0.3}).count() == 0


def test_entry_components_equal_numpy(spark):
    r = np.random.RandomState(5)
    x = np.where(r.rand(40, 6) < 0.3, 0, r.gamma(2, 2, (40, 6)))
    df = spark.createDataFrame([(i, f"g{j}", float(x[i, j])) for i in range(40) for j in range(6) if x[i, j]], "cell long, gene string, value double")
    got = {v.cell: (v.pc1, v.pc2) for v in matrix.entry_components(df, "cell", 2).collect()}
    centred = x - x.mean(axis=0)
    axes = np.linalg.svd(centred)[2][:2]
    axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(axis=1)])[:, None]
    want = centred @ axes.T
    assert len(got) == 40 and max(abs(got[i][j] - want[i, j]) for i in range(40) for j in range(2)) < 1e-9


def test_rings_and_baseline_by_hand(spark):
    """Rings of width 2 around 0 and 2 (the range ends at 3), baseline from 0 to 1: cell 1 is in both, cell 3 beyond the last ring, cell 4 has no expression."""
    distances = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, 3.5), (4, 2.0)], "cell long, distance double")
    entries = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (2, "a", 2.0), (3, "b", 9.0)], "cell long, gene string, value double")
    got = {(r.ring, r.gene): r.log2fc for r in analysis.against_baseline(entries, distances, (0.0, 3.0), (0.0, 1.0), 2.0).collect()}
    mean = {(0, "a"): 0.75, (0, "b"): 0.25, (1, "a"): 0.5, (1, "b"): 0.0, (-1, "a"): 0.75, (-1, "b"): 0.25}
    want = {(k, g): math.log2(v + 1e-6) - math.log2(mean[-1, g] + 1e-6) for (k, g), v in mean.items() if k >= 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert analysis.against_baseline(entries, distances.limit(0), (0.0, 3.0), (0.0, 1.0), 2.0).count() == 0
    assert {r.gene for r in analysis.expressed(entries, distances, 1.5).collect()} == {"b"}
    flat = spark.createDataFrame([(k, "g", 2.0) for k in range(10)], "ring int, gene string, log2fc double")
    assert all(abs(r.smooth - 2) < 1e-9 for r in analysis.gradient(flat, 10).collect())


def test_adjusted_over_stretches(spark):
    p = spark.range(150_000).select(F.col("id").alias("gene"), (((F.col("id") * 7919) % 150_000 + 1) / 150_000.0).alias("p"))
    got = analysis.adjusted(p).agg(F.min("p_adjusted"), F.max("p_adjusted"), F.count("*")).first()
    assert abs(got[0] - 1) < 1e-9 and got[1] == 1 and got[2] == 150_000  # evenly spread chances: p n / rank is 1 throughout


def test_variable_genes_have_no_cap(spark):
    scores = spark.createDataFrame([(f"g{k}", 1.0, 2.0) for k in range(3000)] + [("low", 0.01, 2.0), ("flat", 1.0, 0.2), ("none", 1.0, None)], "gene string, mean double, score double")
    assert analysis.variable(scores).count() == 3000
    assert analysis.variable(scores.filter("gene in ('low', 'none')")).count() == 2


def test_names_of_one_hot_name(spark):
    cells = spark.range(5000).select(F.col("id").alias("cell"), F.lit("s").alias("s"), F.lit("n").alias("name"))
    got = labels.unique_names(cells, ["s"], "name", ["cell"]).agg(F.count_distinct("unique_name"), F.max("ordinal")).first()
    assert tuple(got) == (5000, 4999)


def test_tails_equal_counted_hands():
    cases = [(m, d, o) for m in (1, 4, 9, 30) for d in (1, 5, 12, 30) for o in range(1, min(m, d) + 1)]
    m, d, o = (np.array(v) for v in zip(*cases, strict=True))
    got = log_tail(60.0, m, d, o)
    for (a, b, c), g in zip(cases, got, strict=True):
        hands = sum(math.comb(a, k) * math.comb(60 - a, b - k) for k in range(c, min(a, b) + 1))
        assert g == pytest.approx(math.log(hands / math.comb(60, b)), abs=1e-9)


def test_missing_pairs_are_completed(spark):
    entries = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (2, "c", 2.0), (3, "z", 5.0)], "cell long, gene string, value double")
    sets = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "c"), ("t", "a"), ("u", "q")], "geneset string, gene string")
    whole = analysis.over_representation(entries, sets, top=2, background=10, least_members=1).collect()
    some = analysis.over_representation(entries, sets, top=2, background=10, least_members=1, every=False).collect()
    assert {(r.cell, r.geneset): r.overlap for r in whole} == {(1, "s"): 2, (1, "t"): 1, (2, "s"): 0, (2, "t"): 1, (3, "s"): 0, (3, "t"): 0}
    assert {(r.cell, r.geneset) for r in some} == {(1, "s"), (1, "t"), (2, "t")}
    none = analysis.over_representation(entries.filter("false"), sets, top=2, background=10)
    assert none.collect() == []
    modules = spark.createDataFrame([("a", "m"), ("b", "n"), ("c", "n"), ("q", "o")], "gene string, module string")
    levels = {(r.cell, r.module): r.value for r in analysis.module_means(entries, modules).collect()}
    assert levels == {(1, "m"): 1.0, (1, "n"): pytest.approx(1 / 6), (1, "o"): 0.0, (2, "m"): 0.0, (2, "n"): 1.0, (2, "o"): 0.0}


def test_sampled_painting(spark):
    pixels = spark.range(0, 40).select(F.lit("s").alias("image"), (F.col("id") % 4).alias("label"), F.col("id").cast("int").alias("row"), F.lit(0).alias("col"))
    values = spark.createDataFrame([("s", 1, "g", 0.0), ("s", 2, "g", 1.0), ("s", 3, "g", 4.0), ("s", 1, "zero", 0.0), ("s", 2, "one", 7.0), ("s", 9, "g", 2.0)], "image string, label long, gene string, value double")
    drawn = images.sampled_painting(pixels, values, ["image"], 2.0, 1)
    assert {(r.gene, r.label): r.n for r in drawn.groupBy("gene", "label").agg(F.count("*").alias("n")).collect()} == {("g", 2): 5, ("g", 3): 10, ("one", 2): 10}
    assert drawn.filter("row % 4 <> label").count() == 0 and drawn.select("gene", "row").distinct().count() == 25
    assert images.sampled_painting(pixels, values.filter("false"), ["image"]).count() == 0
    paint = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, None)], "row int, col int, value double")
    assert [r.value for r in images.at_least(paint, 1.0).collect()] == [1.0, 1.0] and [r.value for r in images.at_least(paint, 1.0, True, False).collect()] == [2.0]


def test_masked_and_stored_entries(spark):
    rows = spark.createDataFrame([(1, 0.0, 2.0), (2, None, -1.0)], "id long, a double, b double")
    entries = matrix.stored(rows, "id", ["a", "b"])
    assert {tuple(r) for r in entries.collect()} == {(1, "b", 2.0), (2, "b", -1.0)}
    assert [r.cell for r in matrix.masked(entries, F.when(F.col("cell") == 1, F.lit(None).cast("boolean")).otherwise(True)).collect()] == [1]


def test_first_polygon(spark):
    drawn = spark.createDataFrame([("p", '{"shapes": [{"type": "line"}, {"path": "M0,0L4,0L4,4L0,4Z"}, {"type": "rect", "x0": 9, "y0": 9, "x1": 10, "y1": 10}]}'), ("none", "{}")], "name string, json string")
    ring = shapes.first_polygon(drawn, "json", ["name"], 5).orderBy("k").collect()
    assert [(r.x, r.y) for r in ring] == [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)] and {r.name for r in ring} == {"p"}
