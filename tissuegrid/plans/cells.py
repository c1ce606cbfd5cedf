"""Queries over cells: normalisation, positions, labels and spots, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuegrid.common import clean_label, rounded, stage, table, usable
from tissuegrid.operators import analysis, labels, matrix, spatial
from tissuegrid.plans import parts
from tissuegrid.plans.parts import MORPH, PITCH, sql

_KEYS = ["cell", "sample_id"]
SIX = ["hist_pc1", "hist_pc2", "hist_pc3", *parts.GENES]


def _cells(spark: SparkSession, folder: str, *need: str) -> DataFrame:
    return stage(parts.features(spark, folder, *need))


def _r(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(c, places) for c in columns})


def all_cells(spark: SparkSession, folder: str) -> DataFrame:
    """(cell, sample_id, clusters, barcode, umi, seg_label) of every cell of the large table, once; a label that is null in one copy is blank in others."""
    rows = table(spark, folder, "cells")
    return rows.select(F.col("cell_id").alias("cell"), "sample_id", clean_label("clusters").alias("clusters"), F.col("spot_barcodes").alias("barcode"), "umi", "seg_label").distinct()


def standardize_features(spark, folder):
    return _r(matrix.standardize(_cells(spark, folder, *parts.MORPH).select(*_KEYS, *MORPH), MORPH, ["sample_id"]), *MORPH)


def minmax_features(spark, folder):
    return _r(matrix.minmax(_cells(spark, folder, *parts.MORPH).select(*_KEYS, *MORPH), MORPH, ["sample_id"]), *MORPH)


def _robust(cells: DataFrame) -> DataFrame:
    q = matrix.quantile_range(cells, "mean_gray", ["sample_id"], 0.1, 0.9)
    scaled = matrix.robust_scaled(F.col("mean_gray"), F.col("ql"), F.col("qu"))
    return cells.join(q, "sample_id").withColumn("scaled", scaled)


def robustnorm(spark, folder):
    return _r(_robust(_cells(spark, folder, "mean_gray")).select("cell", "scaled"), "scaled")


def robustnorm_roundtrip(spark, folder):
    back = matrix.robust_restored(F.col("scaled"), F.col("ql"), F.col("qu"))
    return _r(_robust(_cells(spark, folder, "mean_gray")).select("cell", back.alias("mean_gray")), "mean_gray")


def row_normalize_l1(spark, folder):
    return _r(matrix.normalized(parts.counts(spark, folder), "cell"), "value", places=12)


def col_normalize_l1(spark, folder):
    return _r(matrix.normalized(parts.counts(spark, folder), "gene"), "value", places=12)


def log_normalize(spark, folder):
    return _r(matrix.log_normalized(parts.counts(spark, folder), "cell"), "value")


def scale_clip(spark, folder):
    counts = stage(parts.counts(spark, folder))
    return _r(matrix.scaled_genes(counts, "gene", counts.select("cell").distinct().count(), 3.0), "value")


def sparsity(spark, folder):
    return _r(matrix.sparsity(parts.counts(spark, folder), "cell", "gene"), "sparsity")


def dropout_ratio(spark, folder):
    counts = stage(parts.counts(spark, folder))
    return _r(matrix.dropout_ratio(counts, "gene", counts.select("cell").distinct().count()), "dropout")


def _extended(spark, folder):
    """A second matrix over the same cells and genes: lines with a discount only."""
    lines = table(spark, folder, "lineitem").filter("l_discount > 0.05")
    return lines.groupBy(F.col("l_suppkey").alias("cell"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def gene_cosine(spark, folder):
    return _r(matrix.cosine(parts.counts(spark, folder), _extended(spark, folder), "cell", "gene"), "cosine")


def relative_distance(spark, folder):
    return _r(matrix.relative_distance(parts.counts(spark, folder), _extended(spark, folder), "cell", "gene"), "distance")


def gene_cv(spark, folder):
    counts = stage(parts.counts(spark, folder))
    return _r(matrix.error_share(counts, _extended(spark, folder), "cell", "gene", counts.select("cell").distinct().count()), "cv")


def entry_ratio(spark, folder):
    return _r(matrix.divided(_extended(spark, folder), parts.counts(spark, folder), ["cell", "gene"]), "value")


def gene_block_union(spark, folder):
    return _r(matrix.blocks_joined(_extended(spark, folder), parts.counts(spark, folder), ["cell", "gene"]), "value")


def residual_vs_libsize(spark, folder):
    return _r(matrix.residuals(parts.counts(spark, folder), "cell", "gene"), "value", places=4)


def variance_stabilized(spark, folder):
    counts = stage(parts.counts(spark, folder))
    return _r(matrix.stabilized_variance(counts, "gene", counts.select("cell").distinct().count()), "value")


def pearson_vs_roi(spark, folder):
    cells = _cells(spark, folder, *parts.MORPH)
    scaled = matrix.standardize(cells.select("cell", "clusters", *MORPH), MORPH)
    return _r(matrix.pearson_with_group(scaled, "cell", MORPH, F.col("clusters") == "tumor_core"), "r")


def select_similar(spark, folder):
    """Cells whose mean correlation with the tumour core, over the three components of the image and half of those of the expression, is above the largest one over 1.2."""
    halved = {c: F.col(c) * 0.5 for c in parts.GENES}
    cells = _cells(spark, folder, *SIX).select("cell", "clusters", *SIX).withColumns(halved)
    r = stage(matrix.pearson_with_group(cells, "cell", SIX, F.col("clusters") == "tumor_core"))
    return r.crossJoin(F.broadcast(r.agg(F.max("r").alias("most")))).filter(F.col("r") > F.col("most") / 1.2).select("cell")


def pca_components(spark, folder):
    cells = _cells(spark, folder, *parts.MORPH)
    return _r(matrix.component_scores(matrix.standardize(cells.select("cell", *MORPH), MORPH), "cell", MORPH, 3), "pc1", "pc2", "pc3")


def kmeans_clusters(spark, folder):
    cells = _cells(spark, folder, *parts.MORPH)
    return matrix.k_means(matrix.standardize(cells.select("cell", *MORPH), MORPH), "cell", MORPH, 8)


def hierarchy_clusters(spark, folder):
    cells = _cells(spark, folder, *parts.MORPH)
    return matrix.bisecting(matrix.standardize(cells.select("cell", *MORPH), MORPH), "cell", MORPH, 6)


def assign_nearest_spot(spark, folder):
    """The nearest spot of each cell, below five spot diameters where the sample's diameter is known."""
    cells = _cells(spark, folder, *parts.PLACE)
    samples = table(spark, folder, "samples").select("sample_id", "spot_diameter_fullres")
    known = cells.join(samples, "sample_id", "left")
    margin = F.when(usable("spot_diameter_fullres"), 10 * 0.5 * F.col("spot_diameter_fullres"))
    return _r(spatial.nearest_spot(known.select("cell", "x", "y", "sample_id", "spot_diameter_fullres"), parts.spots(cells), PITCH, ["sample_id"], margin), "d")


def hd_radius_mean(spark, folder, how="mean"):
    """Bins are the spots with the summed components of their cells."""
    cells = _cells(spark, folder, *parts.PLACE, *parts.GENES)
    bins = labels.to_spots(parts.genes(cells), parts.spots_of(cells), "sum").withColumnRenamed("spot", "bin")
    spots = parts.spots(cells).withColumnRenamed("spot", "bin")
    return _r(spatial.radius_aggregate(cells.select("cell", "x", "y", "sample_id"), spots, bins, 2500.0, ["sample_id"], how), "value")


def hd_radius_sum(spark, folder):
    return hd_radius_mean(spark, folder, "sum")


def nearest_distance_stats(spark, folder):
    return _r(spatial.context_sizes(_cells(spark, folder, *parts.PLACE), ["sample_id"]), "mean", "median", "least", "largest")


def outlier_cells(spark, folder):
    return _r(spatial.outliers(_cells(spark, folder, *parts.PLACE), ["sample_id"], 10, 2.5), "mean_distance", "z")


def bbox_filter(spark, folder):
    return _cells(spark, folder, *parts.PLACE).filter(spatial.in_box(2000.0, 9000.0, 3000.0, 8000.0)).select("cell")


def roi_filter(spark, folder):
    return _cells(spark, folder, *parts.PLACE).filter(spatial.in_roi(2000.0, 3000.0, 4000.0, 6000.0)).select("cell")


def tile_split(spark, folder):
    return spatial.tiles(_cells(spark, folder, *parts.PLACE), 3, 4, ["sample_id"]).select("cell", "tile_row", "tile_column")


def _rings(cells: DataFrame) -> DataFrame:
    """(sample_id, ring): an eight-sided region around the middle of each sample."""
    box = spatial.bounds(cells, ["sample_id"])
    cx, cy, r = (F.col("x_min") + F.col("x_max")) / 2, (F.col("y_min") + F.col("y_max")) / 2, (F.col("x_max") - F.col("x_min")) / 4
    corners = [(1.0, 0.0), (0.75, 0.75), (0.0, 1.0), (-0.75, 0.75), (-1.0, 0.0), (-0.75, -0.75), (0.0, -1.0), (0.75, -0.75), (1.0, 0.0)]
    return box.select("sample_id", F.array(*(F.struct((cx + r * a).alias("x"), (cy + r * b).alias("y")) for a, b in corners)).alias("ring"))


def _placed(cells: DataFrame) -> DataFrame:
    return cells.join(_rings(cells), "sample_id")


def polygon_filter(spark, folder):
    return _placed(_cells(spark, folder, *parts.PLACE)).filter(spatial.inside(F.col("x"), F.col("y"), "ring")).select("cell")


def ring_distance(spark, folder):
    return _r(_placed(_cells(spark, folder, *parts.PLACE)).select("cell", spatial.signed_distance(F.col("x"), F.col("y"), "ring").alias("distance")), "distance")


def _ring_cells(cells: DataFrame) -> DataFrame:
    d = spatial.signed_distance(F.col("x"), F.col("y"), "ring")
    return _placed(cells).select("cell", "sample_id", spatial.ring_index(d, -1500.0, 1500.0, 300.0).alias("ring")).filter("ring is not null")


def ring_gradient(spark, folder):
    """Mean components by distance ring from the region's edge."""
    cells = _cells(spark, folder, *parts.PLACE, *parts.GENES)
    return _r(labels.group_means(parts.genes(cells), _ring_cells(cells).select("cell", "ring"), ["ring"]), "mean", places=11)


def savgol_smooth(spark, folder):
    from tissuegrid.operators.analysis import smoothed_series

    cells = _cells(spark, folder, *parts.PLACE, *parts.GENES)
    means = stage(labels.group_means(parts.genes(cells), _ring_cells(cells).select("cell", "ring"), ["ring"]))
    return _r(smoothed_series(means, ["gene"], "ring", "mean", 5, 2).select("gene", "ring", "smooth"), "smooth")


def _against_baseline(spark, folder) -> DataFrame:
    """Positive components as expression; rings as in `ring_gradient`, the first 600 inside as baseline."""
    cells = _cells(spark, folder, *parts.PLACE, *parts.GENES)
    d = spatial.signed_distance(F.col("x"), F.col("y"), "ring").alias("distance")
    return analysis.against_baseline(parts.genes(cells).filter("value > 0"), _placed(cells).select("cell", d), (-1500.0, 1500.0), (-1500.0, -900.0), 300.0)


def dge_against_baseline(spark, folder):
    """Fold change of the components in each ring against the baseline band."""
    return _r(_against_baseline(spark, folder), "log2fc")


def dge_gradient(spark, folder):
    """The same smoothed over the rings by polynomials of degree 5."""
    return _r(analysis.gradient(stage(_against_baseline(spark, folder)), 10).select("ring", "gene", "smooth"), "smooth")


def polygon_resample(spark, folder):
    rings = _rings(_cells(spark, folder, *parts.PLACE)).select("sample_id", F.posexplode("ring").alias("place", "p")).select("sample_id", "place", "p.x", "p.y")
    return _r(spatial.resampled(rings, ["sample_id"], 25), "x", "y", places=4)


def roi_bbox(spark, folder):
    rings = _rings(_cells(spark, folder, *parts.PLACE)).select("sample_id", F.explode("ring").alias("p")).select("sample_id", "p.x", "p.y")
    return spatial.roi_of(rings, ["sample_id"], 100)


def grid_spots(spark, folder):
    from tissuegrid.operators.simulate import grid_spots as grid

    return grid(_cells(spark, folder, *parts.PLACE), 1500.0, ["sample_id"])


def unique_cell_names(spark, folder):
    return labels.unique_names(all_cells(spark, folder).filter("barcode is not null").select("cell", "sample_id", "barcode").distinct(), ["sample_id"], "barcode", ["cell"]).select("cell", "unique_name")


def downsample_k(spark, folder):
    cells = all_cells(spark, folder).filter("clusters is not null").select("cell", "sample_id", "clusters").distinct()
    return labels.downsample(cells, ["sample_id"], "clusters", ["cell"], 3).select("cell")


def spot_cv_heterogeneity(spark, folder):
    return _r(parts.heterogeneity(_cells(spark, folder)).select("cell", "heterogeneity"), "heterogeneity")


def spot_entropy_heterogeneity(spark, folder):
    cells = _cells(spark, folder, *parts.PLACE)
    placed = cells.join(parts.spots_of(cells), "cell").select("cell", "spot", "clusters")
    return _r(labels.shared_back(placed, labels.entropy(placed, ["spot"], "clusters"), ["spot"]).select("cell", "entropy"), "entropy")


def spot_mean_from_cells(spark, folder):
    cells = _cells(spark, folder, *parts.PLACE, *parts.GENES)
    return _r(labels.to_spots(parts.genes(cells), parts.spots_of(cells)), "value", places=9)


def spot_to_cells(spark, folder):
    cells = _cells(spark, folder, *parts.PLACE, *parts.GENES)
    spot_of = parts.spots_of(cells)
    return _r(labels.to_cells(labels.to_spots(parts.genes(cells), spot_of, "sum"), spot_of), "value")


def median_cells_per_spot(spark, folder):
    cells = _cells(spark, folder, *parts.PLACE)
    return parts.spots_of(cells).groupBy("spot").agg(F.count("*").alias("n")).agg(F.floor(F.percentile("n", F.lit(0.5))).alias("cells"))


def majority_label(spark, folder, above=0.0):
    cells = _cells(spark, folder, *parts.PLACE)
    return _r(labels.majority(cells.join(parts.spots_of(cells), "cell"), ["spot"], "clusters", above), "share")


def majority_label_threshold(spark, folder):
    return majority_label(spark, folder, 0.5)


def deconvolution(spark, folder):
    cells = _cells(spark, folder, *parts.PLACE)
    return _r(labels.proportions(cells.join(parts.spots_of(cells), "cell"), ["spot"], "clusters"), "share")


def grouped_mean_melt(spark, folder):
    cells = _cells(spark, folder, *parts.GENES)
    return _r(labels.group_means(parts.genes(cells), cells.filter("clusters is not null").select("cell", "clusters"), ["clusters"]), "mean", places=9)


def onehot_pivot(spark, folder):
    return labels.one_hot(_cells(spark, folder, parts.NOTHING), ["cell"], "clusters")


def label_codes(spark, folder):
    return labels.codes(_cells(spark, folder, parts.NOTHING).select("cell", "clusters"), "clusters").filter("code is not null").select("cell", "code")


def top_umi_per_cluster(spark, folder):
    cells = all_cells(spark, folder).filter(usable("umi") & (F.col("umi") >= 0)).filter("clusters is not null").select("cell", "clusters", "umi").distinct()
    return labels.top_share(cells, ["clusters"], "umi", 0.5).select("cell")


def edge_contamination(spark, folder):
    cells = _cells(spark, folder)
    return _r(labels.cross_label_share(parts.knn(cells), cells.select("cell", F.col("clusters").alias("label"))), "mean_share", "rows_with")


def stratify_thresholds(spark, folder):
    cells = _cells(spark, folder, *parts.PLACE)
    placed = cells.join(parts.spots_of(cells), "cell")
    known = cells.agg(F.count_distinct("clusters").alias("n")).first()["n"]
    return _r(labels.thresholds(labels.entropy(placed, ["spot"], "clusters"), "entropy", known), "threshold")


_NAMES = (
    standardize_features, minmax_features, robustnorm, robustnorm_roundtrip, row_normalize_l1, col_normalize_l1, log_normalize, scale_clip, sparsity, dropout_ratio, gene_cosine,
    relative_distance, gene_cv, entry_ratio, gene_block_union, residual_vs_libsize, variance_stabilized, pearson_vs_roi, select_similar, pca_components, kmeans_clusters, hierarchy_clusters,
    assign_nearest_spot, hd_radius_mean, hd_radius_sum, nearest_distance_stats, outlier_cells, bbox_filter, roi_filter, tile_split, polygon_filter, ring_distance, ring_gradient, dge_against_baseline, dge_gradient,
    savgol_smooth, polygon_resample, roi_bbox, grid_spots, unique_cell_names, downsample_k, spot_cv_heterogeneity, spot_entropy_heterogeneity, spot_mean_from_cells, spot_to_cells,
    median_cells_per_spot, majority_label, majority_label_threshold, deconvolution, grouped_mean_melt, onehot_pivot, label_codes, top_umi_per_cluster, edge_contamination, stratify_thresholds,
)
QUERIES = {f.__name__: f for f in _NAMES}

_round = lambda *c, n=6: ", ".join(f"round({x}, {n}) + 0.0 AS {x}" for x in c)
_over = lambda e: ", ".join(f"round({e.format(c)}, 6) + 0.0 AS {c}" for c in MORPH)
_CELLS = "SELECT count(DISTINCT cell) AS n FROM counts"
_SECOND = "SELECT l_suppkey AS cell, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem WHERE l_discount > 0.05 GROUP BY 1, 2"
_BOTH = "SELECT cell, gene, coalesce(a.value, 0) AS a, coalesce(b.value, 0) AS b FROM counts a FULL JOIN second b USING (cell, gene)"
_ROBUST = """SELECT cell, ql, qu, CASE WHEN ql = qu THEN mean_gray - qu ELSE (mean_gray - ql) / (qu - ql) * 2 - 1 END AS scaled FROM features JOIN
(SELECT sample_id, quantile_cont(mean_gray, 0.1) AS ql, quantile_cont(mean_gray, 0.9) AS qu FROM features GROUP BY 1) USING (sample_id)"""
_Z_ALL = ", ".join(f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END AS {c}" for c in MORPH)
_MEAN = "(" + " + ".join(MORPH) + f") / {len(MORPH)}"
_NORM = "sqrt(" + " + ".join(f"{c} ** 2" for c in MORPH) + ")"
_PEARSON = {
    "z": f"SELECT cell, clusters, {_Z_ALL} FROM features",
    "centred": f"SELECT cell, clusters, {', '.join(f'{c} - {_MEAN} AS {c}' for c in MORPH)} FROM z",
    "unit": f"SELECT cell, clusters, {', '.join(f'{c} / nullif({_NORM}, 0) AS {c}' for c in MORPH)} FROM centred",
    "pearson": f"SELECT a.cell, {' + '.join(f'a.{c} * g.{c}' for c in MORPH)} AS r FROM unit a, (SELECT {', '.join(f'avg({c}) AS {c}' for c in MORPH)} FROM unit WHERE clusters = 'tumor_core') g",
}
_SIX_MEAN = "(" + " + ".join(SIX) + f") / {len(SIX)}"
_SIX_PEARSON = _PEARSON | {
    "z": f"SELECT cell, clusters, {', '.join(c if c in SIX[:3] else f'{c} * 0.5 AS {c}' for c in SIX)} FROM features",
    "centred": f"SELECT cell, clusters, {', '.join(f'{c} - {_SIX_MEAN} AS {c}' for c in SIX)} FROM z",
    "unit": f"SELECT cell, clusters, {', '.join(f'{c} / nullif(sqrt({" + ".join(f"{d} ** 2" for d in SIX)}), 0) AS {c}' for c in SIX)} FROM centred",
    "pearson": f"SELECT a.cell, {' + '.join(f'a.{c} * g.{c}' for c in SIX)} AS r FROM unit a, (SELECT {', '.join(f'avg({c}) AS {c}' for c in SIX)} FROM unit WHERE clusters = 'tumor_core') g",
}
_SPOT_SUMS = "SELECT spot, gene, sum(value) AS value FROM genes JOIN spot_of USING (cell) GROUP BY 1, 2"
_HD = {
    "spot_sums": _SPOT_SUMS,
    "met": "SELECT cell, spot, count(*) OVER (PARTITION BY cell) AS n FROM features f JOIN spots s ON f.sample_id = s.sample_id AND (f.x - s.x) ** 2 + (f.y - s.y) ** 2 <= 2500.0 * 2500.0",
}
_NEAREST = """SELECT i AS cell, sample_id, d, r FROM (SELECT a.cell AS i, a.sample_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d,
row_number() OVER (PARTITION BY a.cell ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.cell) AS r FROM features a JOIN features b ON a.sample_id = b.sample_id AND a.cell <> b.cell)"""
_CORNERS = [(1.0, 0.0), (0.75, 0.75), (0.0, 1.0), (-0.75, 0.75), (-1.0, 0.0), (-0.75, -0.75), (0.0, -1.0), (0.75, -0.75), (1.0, 0.0)]
_MIDDLE = "SELECT sample_id, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (max(x) - min(x)) / 4 AS r FROM features GROUP BY 1"
_VERTICES = "SELECT sample_id, place, cx + r * a AS x, cy + r * b AS y FROM middle, (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(_CORNERS)) + ") v(place, a, b)"
_SIDES = "SELECT a.sample_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM vertices a JOIN vertices b ON a.sample_id = b.sample_id AND b.place = a.place + 1"
_T = "greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2)))"
_DISTANCE = f"""SELECT cell, min(sqrt((x - x0 - {_T} * (x1 - x0)) ** 2 + (y - y0 - {_T} * (y1 - y0)) ** 2)) AS d,
count(*) FILTER (((y0 > y) <> (y1 > y)) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0) % 2 = 1 AS inside FROM features JOIN sides USING (sample_id) GROUP BY cell"""
_RING = {"middle": _MIDDLE, "vertices": _VERTICES, "sides": _SIDES, "distance": _DISTANCE}
_SIGNED = "CASE WHEN inside THEN -d ELSE d END"
_RINGS = _RING | {
    "ring_cells": f"SELECT cell, CAST(floor(({_SIGNED} + 1500) / 300 + 0.5) AS INTEGER) AS ring FROM distance WHERE floor(({_SIGNED} + 1500) / 300 + 0.5) BETWEEN 0 AND 9",
    "ring_means": "SELECT ring, gene, avg(value) AS mean FROM genes JOIN ring_cells USING (cell) GROUP BY 1, 2",
}
# Rings and the baseline, which overlaps them.
_BAND = _RING | {
    "bands": f"""SELECT cell, CAST(floor(({_SIGNED} + 1500) / 300 + 0.5) AS INTEGER) AS ring FROM distance WHERE floor(({_SIGNED} + 1500) / 300 + 0.5) BETWEEN 0 AND 9
UNION ALL SELECT cell, -1 FROM distance WHERE {_SIGNED} >= -1500 AND {_SIGNED} < -900""",
    "band_sizes": "SELECT ring, count(*) AS n FROM bands GROUP BY 1",
    "band_shares": "SELECT cell, gene, value / sum(value) OVER (PARTITION BY cell) AS share FROM genes WHERE value > 0",
    "band_means": "SELECT ring, gene, sum(coalesce(share, 0)) / any_value(n) AS m FROM bands JOIN band_sizes USING (ring) CROSS JOIN (SELECT DISTINCT gene FROM band_shares) LEFT JOIN band_shares USING (cell, gene) GROUP BY 1, 2",
    "band_folds": "SELECT a.ring, gene, log2(a.m + 1e-6) - log2(b.m + 1e-6) AS log2fc FROM band_means a JOIN (SELECT gene, m FROM band_means WHERE ring = -1) b USING (gene) WHERE a.ring >= 0",
}
_PATH = _RING | {
    "pieces": "SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len FROM (SELECT a.sample_id, a.place, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM vertices a JOIN vertices b ON a.sample_id = b.sample_id AND b.place = a.place + 1)",
    "along": "SELECT *, coalesce(sum(len) OVER (PARTITION BY sample_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0, sum(len) OVER (PARTITION BY sample_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s1, sum(len) OVER (PARTITION BY sample_id) AS total FROM pieces",
    "points": "SELECT *, total * k / 24 AS pos FROM along, (SELECT unnest(range(25)) AS k)",
}
_ALL = "SELECT DISTINCT cell_id AS cell, sample_id, nullif(trim(clusters), '') AS clusters, spot_barcodes AS barcode, umi FROM cells"
_MAJORITY = """SELECT spot, CASE WHEN n / total > {0} THEN clusters END AS majority, round(n / total, 6) + 0.0 AS share FROM (SELECT spot, clusters, n, sum(n) OVER (PARTITION BY spot) AS total,
row_number() OVER (PARTITION BY spot ORDER BY n DESC, clusters) AS r FROM label_counts) WHERE r = 1"""
_LABELS = {"label_counts": "SELECT spot, clusters, count(*) AS n FROM features JOIN spot_of USING (cell) WHERE clusters IS NOT NULL GROUP BY 1, 2"}
_ENTROPY = _LABELS | {"entropies": "SELECT spot, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy FROM label_counts GROUP BY 1"}
# Least squares of degree 5 over ten places, at their middle.
_W10 = "[" + ", ".join(repr(v / 256) for v in (10, -30, 3, 55, 90, 90, 55, 3, -30, 10)) + "]"
_W5 = "[" + ", ".join(repr(v) for v in (-3 / 35, 12 / 35, 17 / 35, 12 / 35, -3 / 35)) + "]"

SQL = {
    "standardize_features": sql(f"SELECT cell, sample_id, {_over('CASE WHEN stddev_pop({0}) OVER w > 0 THEN ({0} - avg({0}) OVER w) / stddev_pop({0}) OVER w ELSE 0 END')} FROM features WINDOW w AS (PARTITION BY sample_id)"),
    "minmax_features": sql(f"SELECT cell, sample_id, {_over('CASE WHEN max({0}) OVER w > min({0}) OVER w THEN ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) ELSE 0 END')} FROM features WINDOW w AS (PARTITION BY sample_id)"),
    "robustnorm": sql(f"SELECT cell, {_round('scaled')} FROM robust", robust=_ROBUST),
    "robustnorm_roundtrip": sql(f"SELECT cell, {_round('mean_gray')} FROM features"),
    "row_normalize_l1": sql("SELECT cell, gene, round(value / sum(abs(value)) OVER (PARTITION BY cell), 12) + 0.0 AS value FROM counts"),
    "col_normalize_l1": sql("SELECT cell, gene, round(value / sum(abs(value)) OVER (PARTITION BY gene), 12) + 0.0 AS value FROM counts"),
    "log_normalize": sql("SELECT cell, gene, round(ln(1 + value / total * (SELECT quantile_cont(total, 0.5) FROM totals)), 6) + 0.0 AS value FROM counts JOIN totals USING (cell)", totals="SELECT cell, sum(value) AS total FROM counts GROUP BY 1"),
    "scale_clip": sql(
        "SELECT cell, gene, round(least((value - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 3), 6) + 0.0 AS value FROM counts JOIN moments USING (gene)",
        size=_CELLS, moments="SELECT gene, sum(value) / any_value(n) AS m, sqrt(greatest((sum(value ** 2) - any_value(n) * (sum(value) / any_value(n)) ** 2) / (any_value(n) - 1), 0)) AS sd FROM counts, size GROUP BY 1",
    ),
    "sparsity": sql('SELECT count(DISTINCT cell) AS "rows", count(DISTINCT gene) AS genes, count(*) AS stored, round(1 - count(*) / (count(DISTINCT cell) * count(DISTINCT gene)), 6) + 0.0 AS sparsity FROM counts'),
    "dropout_ratio": sql("SELECT gene, round(1 - count(*) FILTER (value <> 0) / any_value(n), 6) + 0.0 AS dropout FROM counts, size GROUP BY 1", size=_CELLS),
    "gene_cosine": sql("SELECT gene, round(sum(a * b) / nullif(sqrt(sum(a * a) * sum(b * b)), 0), 6) + 0.0 AS cosine FROM met GROUP BY 1", second=_SECOND, met=_BOTH),
    "relative_distance": sql("SELECT gene, round(sqrt(sum((a - b) ** 2)) / nullif(sqrt(sum(a * a)), 0), 6) + 0.0 AS distance FROM met GROUP BY 1", second=_SECOND, met=_BOTH),
    "gene_cv": sql("SELECT gene, round(sqrt(sum((a - b) ** 2) / any_value(n)) / nullif(sum(a) / any_value(n), 0), 6) + 0.0 AS cv FROM met, size GROUP BY 1", second=_SECOND, met=_BOTH, size=_CELLS),
    "entry_ratio": sql("SELECT cell, gene, round(coalesce(b.value, 0) / a.value, 6) + 0.0 AS value FROM counts a LEFT JOIN second b USING (cell, gene) WHERE a.value <> 0", second=_SECOND),
    "gene_block_union": sql("SELECT cell, gene, round(coalesce(b.value, a.value), 6) + 0.0 AS value FROM counts a FULL JOIN second b USING (cell, gene)", second=_SECOND),
    "residual_vs_libsize": sql(
        "SELECT cell, gene, round(value - (regr_intercept(value, t) OVER w + regr_slope(value, t) OVER w * t), 4) + 0.0 AS value FROM logged WINDOW w AS (PARTITION BY gene)",
        logged="SELECT cell, gene, value, ln(sum(value) OVER (PARTITION BY cell)) AS t FROM counts",
    ),
    "variance_stabilized": sql(
        "SELECT cell, gene, round(ln(value + 1 / (2 * (SELECT sum((s2 - m) * m ** 2) / sum(m ** 4) FROM moments))), 6) + 0.0 AS value FROM counts",
        size=_CELLS, moments="SELECT gene, sum(value) / any_value(n) AS m, (sum(value ** 2) - sum(value) ** 2 / any_value(n)) / (any_value(n) - 1) AS s2 FROM counts, size GROUP BY 1",
    ),
    "pearson_vs_roi": sql(f"SELECT cell, {_round('r')} FROM pearson", **_PEARSON),
    "select_similar": sql("SELECT cell FROM pearson WHERE r > (SELECT max(r) FROM pearson) / 1.2", **_SIX_PEARSON),
    "assign_nearest_spot": sql(
        f"SELECT cell, spot, {_round('d')} FROM best LEFT JOIN samples USING (sample_id) WHERE r = 1 AND (spot_diameter_fullres IS NULL OR isnan(spot_diameter_fullres) OR d < 5 * spot_diameter_fullres)",
        best="""SELECT f.cell, f.sample_id, s.spot, sqrt((f.x - s.x) ** 2 + (f.y - s.y) ** 2) AS d, row_number() OVER (PARTITION BY cell ORDER BY (f.x - s.x) ** 2 + (f.y - s.y) ** 2, spot) AS r
FROM features f JOIN spots s ON f.sample_id = s.sample_id""",
    ),
    "hd_radius_mean": sql("SELECT cell, gene, round(sum(value) / any_value(n), 6) + 0.0 AS value FROM met JOIN spot_sums USING (spot) GROUP BY 1, 2", **_HD),
    "hd_radius_sum": sql("SELECT cell, gene, round(sum(value), 6) + 0.0 AS value FROM met JOIN spot_sums USING (spot) GROUP BY 1, 2", **_HD),
    "nearest_distance_stats": sql(
        "SELECT sample_id, round(avg(d), 6) + 0.0 AS mean, round(quantile_cont(d, 0.5), 6) + 0.0 AS median, round(min(d), 6) + 0.0 AS least, round(max(d), 6) + 0.0 AS largest, CAST(round_even(2 * avg(d), 0) AS INTEGER) AS context FROM near WHERE r = 1 GROUP BY 1",
        near=_NEAREST,
    ),
    "outlier_cells": sql(
        f"SELECT cell, {_round('mean_distance', 'z')} FROM (SELECT cell, mean_distance, (mean_distance - avg(mean_distance) OVER w) / stddev_pop(mean_distance) OVER w AS z FROM means WINDOW w AS (PARTITION BY sample_id)) WHERE z > 2.5",
        near=_NEAREST, means="SELECT cell, sample_id, avg(d) AS mean_distance FROM near WHERE r <= 10 GROUP BY 1, 2",
    ),
    "bbox_filter": sql("SELECT cell FROM features WHERE x BETWEEN 2000 AND 9000 AND y BETWEEN 3000 AND 8000"),
    "roi_filter": sql("SELECT cell FROM features WHERE x BETWEEN 2000 AND 6000 AND y BETWEEN 3000 AND 9000"),
    "tile_split": sql(
        "SELECT cell, CAST(floor(py) AS INTEGER) AS tile_row, CAST(floor(px) AS INTEGER) AS tile_column FROM part WHERE px > 0 AND px < 4 AND px <> floor(px) AND py > 0 AND py < 3 AND py <> floor(py)",
        part="SELECT cell, (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) * 4 AS px, (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) * 3 AS py FROM features WINDOW w AS (PARTITION BY sample_id)",
    ),
    "polygon_filter": sql("SELECT cell FROM distance WHERE inside AND d > 0", **_RING),
    "ring_distance": sql(f"SELECT cell, round({_SIGNED}, 6) + 0.0 AS distance FROM distance", **_RING),
    "ring_gradient": sql(f"SELECT ring, gene, {_round('mean', n=11)} FROM ring_means", **_RINGS),
    "dge_against_baseline": sql("SELECT ring, gene, round(log2fc, 6) + 0.0 AS log2fc FROM band_folds", **_BAND),
    "dge_gradient": sql(
        f"SELECT gene, ring, round(sum({_W10}[k + 5] * log2fc), 6) + 0.0 AS smooth FROM wanted JOIN (SELECT gene, ring AS pos, log2fc FROM band_folds) USING (gene, pos) GROUP BY 1, 2",
        **_BAND, wanted="SELECT gene, ring, k, greatest(0, least(9, ring + k)) AS pos FROM band_folds, (SELECT unnest(range(-4, 6)) AS k)",
    ),
    "savgol_smooth": sql(
        f"SELECT gene, ring, round(sum({_W5}[k + 3] * mean), 6) + 0.0 AS smooth FROM wanted JOIN (SELECT gene, ring AS pos, mean FROM ring_means) USING (gene, pos) GROUP BY 1, 2",
        **_RINGS, wanted="SELECT gene, ring, k, greatest(min(ring) OVER (PARTITION BY gene), least(max(ring) OVER (PARTITION BY gene), ring + k)) AS pos FROM ring_means, (SELECT unnest([-2, -1, 0, 1, 2]) AS k)",
    ),
    "polygon_resample": sql(
        "SELECT sample_id, CAST(k AS INTEGER) AS k, round(arg_max(x0 + (x1 - x0) * (pos - s0) / len, s0), 4) + 0.0 AS x, round(arg_max(y0 + (y1 - y0) * (pos - s0) / len, s0), 4) + 0.0 AS y FROM points WHERE len > 0 AND pos >= s0 AND (pos < s1 OR (k = 24 AND place = 7)) GROUP BY 1, 2",
        **_PATH,
    ),
    "roi_bbox": sql("SELECT sample_id, CAST(trunc(min(x) - 100) AS INTEGER) AS \"left\", CAST(trunc(min(y) - 100) AS INTEGER) AS bottom, CAST(trunc(max(x) - min(x) + 200) AS INTEGER) AS width, CAST(trunc(max(y) - min(y) + 200) AS INTEGER) AS height FROM vertices GROUP BY 1", **_RING),
    "grid_spots": sql("SELECT cell, sample_id, concat_ws('_', 'SPOT', CAST(floor((x - min(x) OVER w + 750) / 1500) AS BIGINT), CAST(floor((y - min(y) OVER w + 750) / 1500) AS BIGINT)) AS spot FROM features WINDOW w AS (PARTITION BY sample_id)"),
    "unique_cell_names": sql(
        "SELECT cell, CASE WHEN r = 1 THEN barcode ELSE barcode || '-' || (r - 1) END AS unique_name FROM (SELECT cell, barcode, row_number() OVER (PARTITION BY sample_id, barcode ORDER BY cell) AS r FROM (SELECT DISTINCT cell, sample_id, barcode FROM all_cells WHERE barcode IS NOT NULL))",
        all_cells=_ALL,
    ),
    "downsample_k": sql("SELECT cell FROM (SELECT cell, row_number() OVER (PARTITION BY sample_id, clusters ORDER BY cell) AS r FROM (SELECT DISTINCT cell, sample_id, clusters FROM all_cells WHERE clusters IS NOT NULL)) WHERE r <= 3", all_cells=_ALL),
    "spot_cv_heterogeneity": sql(f"SELECT cell, {_round('heterogeneity')} FROM heterogeneity"),
    "spot_entropy_heterogeneity": sql(f"SELECT cell, {_round('entropy')} FROM spot_of LEFT JOIN entropies USING (spot)", **_ENTROPY),
    "spot_mean_from_cells": sql("SELECT spot, gene, round(avg(value), 9) + 0.0 AS value FROM genes JOIN spot_of USING (cell) GROUP BY 1, 2"),
    "spot_to_cells": sql("SELECT cell, gene, round(value, 6) + 0.0 AS value FROM spot_of JOIN spot_sums USING (spot)", spot_sums=_SPOT_SUMS),
    "median_cells_per_spot": sql("SELECT CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS cells FROM sizes", sizes="SELECT spot, count(*) AS n FROM spot_of GROUP BY 1"),
    "majority_label": sql(_MAJORITY.format(0), **_LABELS),
    "majority_label_threshold": sql(_MAJORITY.format(0.5), **_LABELS),
    "deconvolution": sql("SELECT spot, clusters, round(n / sum(n) OVER (PARTITION BY spot), 6) + 0.0 AS share FROM label_counts", **_LABELS),
    "grouped_mean_melt": sql("SELECT clusters, gene, round(avg(value), 9) + 0.0 AS mean FROM genes JOIN features USING (cell) WHERE clusters IS NOT NULL GROUP BY 1, 2"),
    "onehot_pivot": sql("SELECT cell, clusters AS label, 1 AS value FROM features WHERE clusters IS NOT NULL"),
    "label_codes": sql("SELECT cell, code FROM features JOIN (SELECT clusters, CAST(row_number() OVER (ORDER BY clusters) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT clusters FROM features WHERE clusters IS NOT NULL)) USING (clusters)"),
    "top_umi_per_cluster": sql(
        "SELECT cell FROM measured JOIN (SELECT clusters, quantile_cont(umi, 0.5) AS cut FROM measured GROUP BY 1) USING (clusters) WHERE umi > cut",
        all_cells=_ALL, measured="SELECT DISTINCT cell, clusters, umi FROM all_cells WHERE clusters IS NOT NULL AND NOT isnan(umi) AND umi >= 0",
    ),
    "edge_contamination": sql(
        "SELECT round(avg(share), 6) + 0.0 AS mean_share, round(avg(CAST(share > 0 AS DOUBLE)), 6) + 0.0 AS rows_with FROM shares",
        shares="SELECT i, avg(CAST(a.clusters IS DISTINCT FROM b.clusters AS DOUBLE)) AS share FROM knn JOIN features a ON a.cell = i JOIN features b ON b.cell = j GROUP BY i",
    ),
    "stratify_thresholds": sql(
        'SELECT CAST(k AS INTEGER) AS k, round(k * top / 9, 6) + 0.0 AS threshold, count(entropy) AS "rows" FROM (SELECT unnest(range(10)) AS k) CROSS JOIN known LEFT JOIN entropies ON entropy >= k * top / 9 - 1e-9 GROUP BY 1, 2',
        known="SELECT ln(count(DISTINCT clusters)) AS top FROM features", **_ENTROPY,
    ),
}

#: What queries need of a cell, where it isn't everything.
_NEEDS: dict[str, tuple[str, ...]] = {"assign_nearest_spot": (*parts.PLACE,), "bbox_filter": (*parts.PLACE,), "deconvolution": (*parts.PLACE,), "grid_spots": (*parts.PLACE,), "grouped_mean_melt": (*parts.GENES,), "hd_radius_mean": (*parts.PLACE, *parts.GENES,), "hd_radius_sum": (*parts.PLACE, *parts.GENES,), "hierarchy_clusters": (*parts.MORPH,), "kmeans_clusters": (*parts.MORPH,), "label_codes": (parts.NOTHING,), "majority_label": (*parts.PLACE,), "majority_label_threshold": (*parts.PLACE,), "median_cells_per_spot": (*parts.PLACE,), "minmax_features": (*parts.MORPH,), "nearest_distance_stats": (*parts.PLACE,), "onehot_pivot": (parts.NOTHING,), "outlier_cells": (*parts.PLACE,), "pca_components": (*parts.MORPH,), "pearson_vs_roi": (*parts.MORPH,), "polygon_filter": (*parts.PLACE,), "polygon_resample": (*parts.PLACE,), "ring_distance": (*parts.PLACE,), "dge_against_baseline": (*parts.PLACE, *parts.GENES,), "dge_gradient": (*parts.PLACE, *parts.GENES,), "ring_gradient": (*parts.PLACE, *parts.GENES,), "robustnorm": ("mean_gray",), "robustnorm_roundtrip": ("mean_gray",), "roi_bbox": (*parts.PLACE,), "select_similar": tuple(SIX), "roi_filter": (*parts.PLACE,), "savgol_smooth": (*parts.PLACE, *parts.GENES,), "spot_entropy_heterogeneity": (*parts.PLACE,), "spot_mean_from_cells": (*parts.PLACE, *parts.GENES,), "spot_to_cells": (*parts.PLACE, *parts.GENES,), "standardize_features": (*parts.MORPH,), "stratify_thresholds": (*parts.PLACE,), "tile_split": (*parts.PLACE,)}
SQL = parts.needing(SQL, {k: v for k, v in _NEEDS.items() if k in SQL})
