"""Queries and operators do the whole job: no fixed lists, caps or cuts of the data."""

import math

import pytest
from pyspark.sql import functions as F

from tissuegrid.operators import analysis, labels, simulate
from tissuegrid.params import Params
from tissuegrid.plans import inference, parts, registry


def raw(spark, tables, *known):
    """Cells of the table as it is with the columns known, whatever else they lack: (cell, clusters, known...)."""
    cells = spark.read.parquet(f"{tables}/cell_features.parquet").select(F.col("cell_id").alias("cell"), F.nullif(F.trim("clusters"), F.lit("")).alias("clusters"), *known)
    for c in known:
        cells = cells.filter(F.col(c).isNotNull() & ~F.isnan(c))
    return cells.distinct()


def test_one_hot_keeps_every_label(spark, tables):
    cells = raw(spark, tables).filter("clusters is not null")
    got = registry.QUERIES["onehot_pivot"](spark, tables)
    assert {(r.cell, r.label, r.value) for r in got.collect()} == {(r.cell, r.clusters, 1) for r in cells.select("cell", "clusters").collect()}


def test_cells_that_lack_something_else_stay(spark, tables):
    complete = parts.features(spark, tables).count()
    placed = raw(spark, tables, "x", "y")
    got = registry.QUERIES["ring_distance"](spark, tables)
    assert placed.count() > complete and {r.cell for r in got.select("cell").collect()} == {r.cell for r in placed.select("cell").collect()}


def test_wrong_labels_come_from_all(spark, tables):
    cells = spark.range(6000).select(F.col("id").alias("cell"), F.when(F.col("id") % 7 < 6, F.concat(F.lit("l"), (F.col("id") % 6).cast("string"))).alias("label"))
    got = simulate.mislabelled(cells, "label", None, 0.5, 1).join(cells.withColumnRenamed("label", "was"), "cell").filter(~F.equal_null("label", "was"))
    counts = {(r.was, r.label): r["count"] for r in got.groupBy("was", "label").count().collect()}
    assert got.count() == pytest.approx(3000, abs=150) and {b for _, b in counts} == {f"l{k}" for k in range(6)} and len(counts) == 6 * 5 + 6
    assert min(counts.values()) > 30
    new = registry.QUERIES["mislabel"](spark, tables).select("cell", F.col("clusters").alias("new"))
    was = parts.features(spark, tables).select("cell", "clusters")
    drawn = new.join(was, "cell").filter(~F.equal_null("new", "clusters")).select("new").distinct().count()
    assert drawn > 20  # of 93 labels


def test_simulated_genes_are_the_marker_sets(spark, tables):
    got = registry.QUERIES["simulate_poisson"](spark, tables)
    sets = spark.read.parquet(f"{tables}/marker_sets.parquet").select("geneset").distinct().count()
    cells = parts.features(spark, tables).filter("clusters is not null")
    n = cells.count()
    assert got.count() == n * sets and got.select("gene").distinct().count() == sets
    high = got.filter("rate >= 10").join(cells.select("cell", "clusters"), "cell")
    assert high.select("clusters").distinct().count() == cells.select("clusters").distinct().count()


def test_thresholds_reach_the_logarithm_of_all_labels(spark, tables):
    most = registry.QUERIES["stratify_thresholds"](spark, tables).agg(F.max("threshold").alias("m")).first().m
    assert most == pytest.approx(math.log(raw(spark, tables, "x", "y").select("clusters").filter("clusters is not null").distinct().count()), abs=1e-5)
    one = spark.createDataFrame([("s", 0.0)], "spot string, entropy double")
    assert {r.rows for r in labels.thresholds(one, "entropy", 1).collect()} == {1}


def _tail(members, drawn, overlap, background):
    ways = sum(math.comb(members, k) * math.comb(background - members, drawn - k) for k in range(overlap, min(members, drawn) + 1))
    return (math.log(math.comb(background, drawn)) - math.log(ways)) / math.log(10)


def test_draws_five_percent_and_scores_large_sets(spark):
    e = spark.createDataFrame([(1, g, float(3000 - g)) for g in range(3000)], "cell long, gene long, value double")
    sets = spark.createDataFrame([("s", g) for g in range(100, 2000)] + [("in", g) for g in range(150)], "geneset string, gene long")
    got = {r.geneset: (r.overlap, r.score) for r in analysis.over_representation(e, sets, background=1000).collect()}
    assert got["s"][0] == 50 and got["s"][1] == pytest.approx(_tail(1900, 150, 50, 3000), abs=1e-6)
    assert got["in"][0] == 150 and got["in"][1] == pytest.approx(_tail(150, 150, 150, 3000), rel=1e-9)
    wide = analysis.over_representation(e, sets.filter("geneset = 'in'"), 400, 20_000).first()
    assert wide.overlap == 150 and wide.score == pytest.approx(_tail(150, 400, 150, 20_000), rel=1e-9)
    every = analysis.over_representation(e, spark.createDataFrame([("in", g) for g in range(400)], "geneset string, gene long"), 400, 20_000).first()
    assert every.score == pytest.approx(_tail(400, 400, 400, 20_000), rel=1e-9) and every.score > 308  # no smallest double


def test_ora_draws_a_share_of_the_genes(spark, tables):
    counts = parts.counts(spark, tables)
    top = math.ceil(0.05 * counts.select("gene").distinct().count())
    stored = {r.cell: r["count"] for r in counts.groupBy("cell").count().collect()}
    got = registry.QUERIES["ora_scores"](spark, tables).groupBy("cell").agg(F.sum("overlap").alias("o"), F.count_if(F.col("score").isNull()).alias("n")).collect()
    assert {r.cell for r in got} == set(stored) and all(r.o <= min(top, stored[r.cell]) and r.n == 0 for r in got)


def test_every_cell_is_painted(spark, tables):
    cells = parts.features(spark, tables)
    got = registry.QUERIES["paint_mask"](spark, tables)
    painted = {r.value for r in got.select("value").distinct().collect()}
    centred = registry.QUERIES["mask_centroids"](spark, tables).select(F.col("label").alias("cell"))
    assert painted == {r.expr_pc1 for r in cells.join(centred, "cell").select("expr_pc1").distinct().collect()} and min(painted) < 0


def test_cells_of_any_positive_total_stay(spark, tables):
    cells = raw(spark, tables, *parts.GENES)
    want = cells.filter(" or ".join(f"{c} > 0" for c in parts.GENES)).select("cell")
    assert {r.cell for r in registry.QUERIES["filter_zero_cells"](spark, tables).collect()} == {r.cell for r in want.collect()}


def test_inference_runs_all_iterations(spark, tables, monkeypatch):
    run = []
    monkeypatch.setattr(inference.Inference, "predict", lambda self: run.append(self.params) or {20: "last"})
    assert registry.QUERIES["infer_expression"](spark, tables) == "last"
    assert run == [Params()] and run[0].run.n_iter == 20
