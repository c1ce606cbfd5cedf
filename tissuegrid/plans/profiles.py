"""Queries over expression profiles, gene sets, copy-number predictions, drawings, pixels and simulations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuegrid.common import rounded, stage, table
from tissuegrid.functions import shapes
from tissuegrid.functions.special import student_two_sided
from tissuegrid.operators import analysis, cna, images, labels, simulate, spatial
from tissuegrid.plans import cells as cell_plans
from tissuegrid.plans import parts
from tissuegrid.plans.parts import GENES, sql
from tissuegrid.sources import files
from tissuegrid.sources.delimited import PREDICTION, judge, valid_rows


def _r(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(c, places) for c in columns})


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    return stage(parts.counts(spark, folder))


def _n_cells(counts: DataFrame) -> int:
    return counts.select("cell").distinct().count()


def _regions(counts: DataFrame, spark, folder) -> DataFrame:
    """(cell, group): suppliers of two regions stand for two tissue regions."""
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    of = table(spark, folder, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("cell"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("group"))
    return of.join(counts.select("cell").distinct(), "cell")


def qc_metrics(spark, folder):
    part = table(spark, folder, "part")
    flags = part.select(F.col("p_partkey").alias("gene"), (F.col("p_size") <= 5).alias("mt"), F.col("p_size").between(6, 15).alias("rb"))
    return _r(analysis.qc_metrics(parts.counts(spark, folder), flags), "pct_mt", "pct_rb")


def qc_filter(spark, folder):
    return analysis.qc_filter(qc_metrics(spark, folder), 2000, 50_000, 11.0, 30.0).select("cell")


def gene_select(spark, folder):
    return analysis.common_genes(parts.counts(spark, folder), 26)


def hvg_dispersion(spark, folder):
    counts = _counts(spark, folder)
    return _r(analysis.dispersions(counts, _n_cells(counts)), "mean", "dispersion", "score", places=5)


def reconstruction_rank(spark, folder):
    """Parts whose discounted lines follow all lines best."""
    counts = _counts(spark, folder)
    cosines = cell_plans.gene_cosine(spark, folder).fillna(0.0)
    means = counts.groupBy("gene").agg((F.sum("value") / _n_cells(counts)).alias("mean"))
    return _r(analysis.by_reconstruction(cosines, means, 0.9, 5.0), "mean")


def log2fc_regions(spark, folder):
    counts = _counts(spark, folder)
    return _r(analysis.log2_fold(counts, stage(_regions(counts, spark, folder)), "r0"), "log2fc")


def top_genes_region(spark, folder):
    return analysis.top_changes(log2fc_regions(spark, folder), F.col("group") == "r1", 10)


def dge_welch_t(spark, folder):
    counts = _counts(spark, folder)
    return _r(analysis.welch(counts, _regions(counts, spark, folder), "r0", "r1"), "mean_a", "mean_b", "t", "df", places=5)


def dge_bh_adjust(spark, folder):
    """Adjusted chances; the tested ones are a function of the region means here, so that both sides can compute them."""
    tests = dge_welch_t(spark, folder).select("gene", (1 / (1 + F.abs("t"))).alias("p"))
    return _r(analysis.adjusted(tests).select("gene", "p_adjusted"), "p_adjusted", places=5)


def dge_p_values(spark, folder):
    return dge_welch_t(spark, folder).select("gene", student_two_sided(F.col("t"), F.col("df")).alias("p"))


def differential_genes(spark, folder):
    counts = _counts(spark, folder)
    logged = counts.withColumn("value", F.log1p("value"))
    return analysis.differential(logged, _regions(counts, spark, folder), "r0", "r1", 0.9, 0.1).select("gene", "t", "p_adjusted", "log2fc")


def _part_sets(spark, folder) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_brand").alias("geneset"), F.col("p_partkey").alias("gene"))


def ora_scores(spark, folder):
    return _r(analysis.over_representation(_counts(spark, folder), _part_sets(spark, folder)).select("cell", "geneset", "overlap", "score"), "score", places=4)


def ulm_scores(spark, folder):
    part = table(spark, folder, "part")
    network = part.select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("gene"), F.when(F.col("p_size") % 2 == 0, 1.0).otherwise(-1.0).alias("weight"))
    return _r(analysis.linear_scores(parts.counts(spark, folder), network, part.count()), "t", places=5)


def gene_set_score(spark, folder):
    counts = _counts(spark, folder)
    means = counts.groupBy("gene").agg((F.sum("value") / _n_cells(counts)).alias("mean"))
    return _r(analysis.set_scores(counts, _part_sets(spark, folder), means, 10), "score", places=5)


def smoothed_set_score(spark, folder):
    """Mean of the components, smoothed over 20 neighbours, infinite and missing values replaced by the largest."""
    from tissuegrid.operators import diffusion

    cells = stage(parts.features(spark, folder, *parts.PLACE, *parts.GENES))
    scores = cells.select("cell", F.lit("mean").alias("gene"), (sum(F.col(c) for c in GENES) / len(GENES)).alias("value"))
    return _r(diffusion.smooth(analysis.finite(scores, "value"), spatial.knn_edges(cells, "cell", ["x", "y"], 20, ["sample_id"])).select("cell", "value"), "value", places=8)


def geneset_filter_strip(spark, folder):
    return analysis.set_filter(table(spark, folder, "gene_sets"), "go_biological_process", ["growth", "repair"])


def pattern_mean_scaled(spark, folder):
    modules = table(spark, folder, "part").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("module"))
    return _r(analysis.module_means(parts.counts(spark, folder), modules), "value")


def _predictions(spark, folder) -> DataFrame:
    raw = table(spark, folder, "cna_predictions_raw")
    return stage(valid_rows(judge(raw, "raw_line", PREDICTION), PREDICTION, "line_id", "split_file"))


def cna_conflicts(spark, folder):
    """Barcodes whose label in the file differs from what their score says: half or more of the score stands for aneuploid."""
    told = _predictions(spark, folder)
    by_score = told.filter("score is not null").select("cell_id", F.when(F.col("score") >= 0.5, "aneuploid").otherwise("diploid").alias("cell_type"))
    return cna.conflicts(told.select("cell_id", "cell_type").unionByName(by_score), "cell_id", "cell_type")


def cna_merge_predictions(spark, folder):
    """One label a barcode; barcodes with different ones are left to cna_conflicts."""
    return cna.merged(_predictions(spark, folder), "cell_id", "cell_type", strict=False)


def cna_label_lookup(spark, folder):
    """The predicted label of barcodes, as they are written or with dots and dashes exchanged, and the row order of heat-maps.

    Looked up are the barcodes of the cells, those of the predictions, and these in the other spelling.
    """
    merged = stage(cna_merge_predictions(spark, folder))
    of_cells = table(spark, folder, "cells").select(F.col("spot_barcodes").alias("barcode")).filter("barcode is not null")
    known = _predictions(spark, folder).select(F.explode(F.array("cell_id", cna.flipped(F.col("cell_id")))).alias("barcode"))
    found = cna.looked_up(of_cells.unionByName(known).distinct(), "barcode", merged, "cell_id", "cell_type")
    return found.withColumn("place", cna.label_order(F.col("cell_type")))


def cna_flip_ids(spark, folder):
    return _predictions(spark, folder).select("line_id", cna.flipped(F.col("cell_id")).alias("flipped"))


def cna_chunks(spark, folder):
    """Sizes of random chunks of at most 1,000 cells."""
    cells = table(spark, folder, "cells").select("cell_id").distinct()
    return cna.chunks(cells, "cell_id", 1000, 3).groupBy("chunk").agg(F.count("*").alias("cells"))


def cna_combine(spark, folder):
    """Summed quantities of two halves of the suppliers, side by side for each nation and month."""
    lines = table(spark, folder, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    half = lambda k: F.sum(F.when(F.col("l_suppkey") % 2 == k, F.col("l_quantity")).otherwise(0.0)).alias(f"half_{k}")
    return cna.combined([lines.groupBy("month", "l_returnflag").agg(half(k)) for k in (0, 1)], ["month", "l_returnflag"])


def ligrec_pathway_filter(spark, folder):
    """Members of the sets whose name holds a pathway, whatever the case; the collection names the pathway column."""
    sets = table(spark, folder, "marker_sets")
    return sets.filter(F.upper("collection") == F.upper(F.lit("Cell_Marker"))).groupBy("geneset").agg(F.count("*").alias("members"))


def distance_pairs(spark, folder):
    """Distances of all cells within the cut-off, each cell with itself included."""
    cells = stage(parts.features(spark, folder, *parts.PLACE))
    a, b = (cells.select(F.col("cell").alias(k), "x", "y", "sample_id") for k in "ij")
    return _r(spatial.within(a, b, 500.0, ["sample_id"]).select("i", "j", "d"), "d")


def filter_zero_cells(spark, folder):
    """Cells whose positive components sum to more than 0."""
    genes = parts.genes(stage(parts.features(spark, folder, *parts.GENES))).filter("value > 0")
    return genes.groupBy("cell").agg(F.sum("value").alias("total")).filter("total > 0").select("cell")


def key_clean(spark, folder):
    """Keys of the event properties without their path."""
    props = F.from_json("props", "map<string, string>")
    prefixed = F.transform_keys(props, lambda k, _: F.concat(F.lit("layout.shapes[0]."), k))
    return table(spark, folder, "events").select("event_id", F.explode(shapes.clean_keys(prefixed)).alias("key", "value"))


def roi_json_parse(spark, folder):
    """Polygons of drawings: each event type's range of values as a rectangle, and as a path in the edited form."""
    box = table(spark, folder, "events").groupBy("event_type").agg(F.min("value").alias("x0"), F.max("value").alias("x1"), F.min("user_id").cast("double").alias("y0"), F.max("user_id").cast("double").alias("y1"))
    rect = F.to_json(F.struct(F.array(F.struct(F.lit("rect").alias("type"), "x0", "y0", "x1", "y1")).alias("shapes")))
    path = F.format_string('{"shapes[0].path": "M%s,%sL%s,%sL%s,%sZ"}', *(F.col(c).cast("string") for c in ("x0", "y0", "x1", "y0", "x1", "y1")))
    drawn = box.select("event_type", F.explode(F.array(F.struct(F.lit("rect").alias("form"), rect.alias("json")), F.struct(F.lit("path").alias("form"), path.alias("json")))).alias("d")).select("event_type", "d.form", "d.json")
    rings = shapes.polygons(drawn, "json", 2.0)
    return _r(rings.select("event_type", "form", F.posexplode("ring").alias("vertex", "p")).select("event_type", "form", "vertex", "p.x", "p.y"), "x", "y", places=4)


def _pixels(spark, folder) -> DataFrame:
    """Each cell paints a square of seven pixels a side; where squares meet, the smaller label holds the pixel. Gray falls off from the cell's mean."""
    cells = parts.features(spark, folder).select("sample_id", F.col("cell").alias("label"), (F.col("x") / 20).cast("int").alias("cx"), (F.col("y") / 20).cast("int").alias("cy"), "mean_gray")
    around = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in range(-3, 4) for q in range(-3, 4)))
    drawn = cells.withColumn("s", F.explode(around)).select("sample_id", "label", (F.col("cy") + F.col("s.q")).alias("row"), (F.col("cx") + F.col("s.p")).alias("col"), (F.floor("mean_gray") - F.abs("s.p") * 2 - F.abs("s.q")).alias("gray"))
    first = drawn.groupBy("sample_id", "row", "col").agg(F.min("label").alias("label"), F.min_by("gray", "label").alias("gray"))
    return stage(first)


def mask_centroids(spark, folder):
    return _r(images.centroids(_pixels(spark, folder), ["sample_id"]), "x", "y")


def _patches(spark, folder) -> DataFrame:
    pixels = _pixels(spark, folder)
    centres = images.centroids(pixels, ["sample_id"]).withColumnRenamed("label", "cell")
    return stage(images.patches(centres, pixels, 5, ["sample_id"]))


def patch_stats(spark, folder):
    return _r(images.patch_stats(_patches(spark, folder), ["sample_id"], ["gray"]), "mean_gray", "std_gray", places=8)


def patch_entropy(spark, folder):
    return _r(images.patch_entropy(_patches(spark, folder), ["sample_id"]), "entropy")


def paint_mask(spark, folder):
    values = parts.features(spark, folder).select("sample_id", F.col("cell").alias("label"), F.col("expr_pc1").alias("value"))
    return images.painted(_pixels(spark, folder), values, ["sample_id"])


def color_limits(spark, folder):
    return _r(images.limits(parts.features(spark, folder, "expr_pc1"), ["sample_id"], "expr_pc1", 0.01, 0.99), "vmin", "vmax")


def sampled_pixels(spark, folder):
    """Pixels drawn by their gray level."""
    return images.sampled(_pixels(spark, folder), F.col("gray") / 256.0, ["sample_id", "row", "col"], 5)


def features_left_join_suffix(spark, folder):
    """Image features beside the large table's measurements; a name both have gets a suffix, and cells without a partner keep nulls."""
    a = parts.features(spark, folder, "mean_gray").select("cell", "clusters", "mean_gray")
    b = cell_plans.all_cells(spark, folder).groupBy("cell").agg(F.max("clusters").alias("clusters"), F.max("barcode").alias("barcode"))
    return files.join_external(a, b, "cell")


def logistic_dropout_prob(spark, folder):
    counts = _counts(spark, folder)
    means = counts.groupBy("gene").agg((F.sum("value") / _n_cells(counts)).alias("mean"))
    return _r(means.select("gene", simulate.dropout_chance(F.col("mean"), 1.5, -2.0).alias("chance")), "chance")


def simulate_dropouts(spark, folder):
    counts = _counts(spark, folder)
    means = counts.groupBy("gene").agg((F.sum("value") / _n_cells(counts)).alias("mean"))
    return simulate.dropouts(counts, means, 1.5, -2.0, 4)


def simulate_poisson(spark, folder):
    """Poisson counts of the marker collections' sets as genes over the cells of each label.

    Sets and labels are numbered in sorted order; a set is high in the label of its number, counted round where there are more sets than labels.
    """
    cells = stage(parts.features(spark, folder).filter("clusters is not null").select("cell", F.col("clusters").alias("cluster")))
    known = stage(labels.codes(cells.select("cluster").distinct(), "cluster"))
    sets = labels.codes(table(spark, folder, "marker_sets").filter("geneset is not null").select(F.col("geneset").alias("gene")).distinct(), "gene", "set")
    genes = sets.withColumn("code", F.col("set") % max(known.count(), 1)).join(known, "code").select("gene", "cluster")
    return simulate.expression(cells, genes, 11)


def perturb_graph(spark, folder):
    cells = stage(parts.features(spark, folder))
    wider = stage(spatial.knn_edges(cells, "cell", ["x", "y"], 15, ["sample_id"]))
    order = F.row_number().over(analysis.Window.partitionBy("i").orderBy("d", "j"))
    return simulate.perturbed(wider.withColumn("r", order).filter("r <= 5"), wider, 0.1, 1.0, 9)


def mislabel(spark, folder):
    return simulate.mislabelled(stage(parts.features(spark, folder)).select("cell", "clusters"), "clusters", None, 0.2, 2)


def spot_mode_label(spark, folder):
    """The most frequent label of each simulated spot."""
    cells = stage(parts.features(spark, folder, *parts.PLACE))
    placed = simulate.grid_spots(cells, 1500.0, ["sample_id"]).join(cells.select("cell", "clusters"), "cell")
    return labels.majority(placed, ["sample_id", "spot"], "clusters").select("sample_id", "spot", "majority")


_NAMES = (
    qc_metrics, qc_filter, gene_select, hvg_dispersion, reconstruction_rank, log2fc_regions, top_genes_region, dge_welch_t, dge_bh_adjust, dge_p_values, differential_genes, ora_scores,
    ulm_scores, gene_set_score, smoothed_set_score, geneset_filter_strip, pattern_mean_scaled, cna_conflicts, cna_merge_predictions, cna_label_lookup, cna_flip_ids, cna_chunks, cna_combine,
    ligrec_pathway_filter, distance_pairs, filter_zero_cells, key_clean, roi_json_parse, mask_centroids, patch_stats, patch_entropy, paint_mask, color_limits, sampled_pixels,
    features_left_join_suffix, logistic_dropout_prob, simulate_dropouts, simulate_poisson, perturb_graph, mislabel, spot_mode_label,
)
QUERIES = {f.__name__: f for f in _NAMES}

_SIZE = "SELECT count(DISTINCT cell) AS n FROM counts"
_REGIONS = """SELECT s_suppkey AS cell, 'r' || n_regionkey AS grp FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey IN (SELECT cell FROM counts)"""
_GROUPS = "SELECT grp, count(*) AS n FROM regions GROUP BY 1"
_FOLD = {
    "regions": _REGIONS, "groups": _GROUPS,
    "shares": "SELECT cell, gene, value / sum(value) OVER (PARTITION BY cell) AS share FROM counts",
    "means": "SELECT grp, gene, sum(share) / any_value(n) AS m FROM shares JOIN regions USING (cell) JOIN groups USING (grp) GROUP BY 1, 2",
    "grid": "SELECT grp, gene FROM groups, (SELECT DISTINCT gene FROM means)",
    "folds": "SELECT g.grp AS \"group\", g.gene, round(log2(coalesce(a.m, 0) + 1e-6) - log2(coalesce(b.m, 0) + 1e-6), 6) + 0.0 AS log2fc FROM grid g LEFT JOIN means a USING (grp, gene) LEFT JOIN means b ON b.gene = g.gene AND b.grp = 'r0'",
}
_WELCH = {
    "regions": _REGIONS, "groups": _GROUPS,
    "na": "SELECT max(CASE WHEN grp = 'r0' THEN n END) AS na, max(CASE WHEN grp = 'r1' THEN n END) AS nb FROM groups",
    "sums": """SELECT gene, coalesce(sum(value) FILTER (grp = 'r0'), 0) AS sa, coalesce(sum(value ** 2) FILTER (grp = 'r0'), 0) AS qa, coalesce(sum(value) FILTER (grp = 'r1'), 0) AS sb,
coalesce(sum(value ** 2) FILTER (grp = 'r1'), 0) AS qb FROM counts JOIN regions USING (cell) WHERE grp IN ('r0', 'r1') GROUP BY 1""",
    "errors": "SELECT gene, na, nb, sa / na AS ma, sb / nb AS mb, greatest(qa - sa * sa / na, 0) / nullif(na - 1, 0) / na AS ea, greatest(qb - sb * sb / nb, 0) / nullif(nb - 1, 0) / nb AS eb FROM sums, na",
    "tests": "SELECT gene, round(ma, 5) + 0.0 AS mean_a, round(mb, 5) + 0.0 AS mean_b, round(CASE WHEN ea + eb > 0 THEN (ma - mb) / sqrt(ea + eb) END, 5) + 0.0 AS t, round(CASE WHEN ea + eb > 0 THEN (ea + eb) ** 2 / (ea ** 2 / nullif(na - 1, 0) + eb ** 2 / nullif(nb - 1, 0)) END, 5) + 0.0 AS df FROM errors",
}
_ORA = {
    "tops": "SELECT cell, gene FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value DESC, gene) AS r FROM counts) WHERE r <= (SELECT ceil(count(DISTINCT gene) / 20) FROM counts)",
    "members": "SELECT DISTINCT p_brand AS geneset, p_partkey AS gene FROM part WHERE p_partkey IN (SELECT gene FROM counts)",
    "sizes": "SELECT geneset, count(*) AS m FROM members GROUP BY 1 HAVING count(*) >= 5",
    "grid": "SELECT cell, d, geneset, m FROM (SELECT cell, count(*) AS d FROM tops GROUP BY 1), sizes",
    "met": "SELECT cell, geneset, count(*) AS overlap FROM tops JOIN members USING (gene) GROUP BY 1, 2",
    "lf": "SELECT k, sum(ln(greatest(k, 1))) OVER (ORDER BY k) AS lf FROM (SELECT unnest(range(20001)) AS k)",
    "grid_o": "SELECT cell, geneset, m, d, coalesce(overlap, 0) AS overlap FROM grid LEFT JOIN met USING (cell, geneset)",
    "terms": "SELECT DISTINCT m, d, overlap, unnest(range(overlap, least(m, d) + 1)) AS k FROM (SELECT DISTINCT m, d, overlap FROM grid_o WHERE overlap > 0)",
    "tails": """SELECT m, d, overlap, sum(exp(a.lf - b.lf - c.lf + e.lf - f.lf - g.lf - h.lf + i.lf + j.lf)) AS p FROM terms JOIN lf a ON a.k = m JOIN lf b ON b.k = terms.k JOIN lf c ON c.k = m - terms.k JOIN lf e ON e.k = 20000 - m
JOIN lf f ON f.k = d - terms.k JOIN lf g ON g.k = 20000 - m - d + terms.k JOIN lf h ON h.k = 20000 JOIN lf i ON i.k = d JOIN lf j ON j.k = 20000 - d GROUP BY 1, 2, 3""",
}
_PIXELS = {
    "pixels_all": """SELECT sample_id, cell AS label, CAST(trunc(y / 20) AS INTEGER) + q AS "row", CAST(trunc(x / 20) AS INTEGER) + p AS col, CAST(floor(mean_gray) AS BIGINT) - abs(p) * 2 - abs(q) AS gray
FROM features, (SELECT unnest(range(-3, 4)) AS p), (SELECT unnest(range(-3, 4)) AS q)""",
    "pixels": 'SELECT sample_id, "row", col, min(label) AS label, arg_min(gray, label) AS gray FROM pixels_all GROUP BY 1, 2, 3',
    "centres": 'SELECT sample_id, label AS cell, avg(col) AS x, avg("row") AS y, count(*) AS pixels FROM pixels WHERE label > 0 GROUP BY 1, 2',
    "patch": """SELECT sample_id, cell, gray FROM pixels JOIN centres USING (sample_id) WHERE col >= trunc(x) - 5 AND col < trunc(x) + 5 AND "row" >= trunc(y) - 5 AND "row" < trunc(y) + 5""",
}


def _predicted(select: str, **more: str) -> str:
    from tissuegrid.plans import faults

    valid = "valid AS (SELECT line_id, trim(f[1]) AS cell_id, lower(trim(f[2])) AS cell_type FROM judged WHERE reason IS NULL)"
    return f"WITH {faults._PARSED}, {valid}, " + ", ".join(f"{k} AS ({v})" for k, v in more.items()) + (" " if more else "") + select if more else f"WITH {faults._PARSED}, {valid} {select}"


_MERGED = "SELECT cell_id, min(cell_type) AS cell_type FROM valid GROUP BY 1 HAVING min(cell_type) = max(cell_type)"
_MEANS = {"size": _SIZE, "gene_means": "SELECT gene, sum(value) / any_value(n) AS mean FROM counts, size GROUP BY 1"}
_QC = {
    "metrics": """SELECT cell, sum(value) AS total, count(*) FILTER (value > 0) AS detected, round(100 * sum(CASE WHEN p_size <= 5 THEN value ELSE 0 END) / sum(value), 6) + 0.0 AS pct_mt,
round(100 * sum(CASE WHEN p_size BETWEEN 6 AND 15 THEN value ELSE 0 END) / sum(value), 6) + 0.0 AS pct_rb FROM counts LEFT JOIN part ON p_partkey = gene GROUP BY 1"""
}

SQL = {
    "qc_metrics": sql("SELECT * FROM metrics", **_QC),
    "qc_filter": sql("SELECT cell FROM metrics WHERE total BETWEEN 2000 AND 50000 AND pct_mt < 11 AND pct_rb < 30", **_QC),
    "gene_select": sql("SELECT gene, count(*) FILTER (value > 0) AS cells FROM counts GROUP BY 1 HAVING count(*) FILTER (value > 0) >= 26"),
    "hvg_dispersion": sql(
        """SELECT gene, round(mean, 5) + 0.0 AS mean, round(dispersion, 5) + 0.0 AS dispersion, bin, round(CASE WHEN count(*) OVER w = 1 THEN 1 ELSE (dispersion - avg(dispersion) OVER w) / stddev_samp(dispersion) OVER w END, 5) + 0.0 AS score FROM binned WINDOW w AS (PARTITION BY bin)""",
        size=_SIZE,
        moments="SELECT gene, sum(value) / any_value(n) AS m, (sum(value ** 2) - sum(value) ** 2 / any_value(n)) / (any_value(n) - 1) AS v FROM counts, size GROUP BY 1",
        logs="SELECT gene, ln(1 + m) AS mean, ln(CASE WHEN v / m > 0 THEN v / m END) AS dispersion FROM moments",
        binned="SELECT *, CAST(least(floor((mean - min(mean) OVER ()) / (max(mean) OVER () - min(mean) OVER ()) * 20), 19) AS INTEGER) AS bin FROM logs",
    ),
    "reconstruction_rank": sql(
        "SELECT gene, CAST(r - 1 AS INTEGER) AS rank, round(mean, 6) + 0.0 AS mean FROM (SELECT gene, row_number() OVER (ORDER BY 1 - cosine, gene) AS r, count(*) OVER () AS n FROM cosines) JOIN gene_means USING (gene) WHERE r - 1 < 0.9::DOUBLE * n AND mean >= 5",
        second=cell_plans._SECOND, both_sides=cell_plans._BOTH, cosines="SELECT gene, coalesce(round(sum(a * b) / nullif(sqrt(sum(a * a) * sum(b * b)), 0), 6), 0) + 0.0 AS cosine FROM both_sides GROUP BY 1", **_MEANS,
    ),
    "log2fc_regions": sql("SELECT * FROM folds", **_FOLD),
    "top_genes_region": sql("""SELECT gene, log2fc, direction FROM (SELECT gene, log2fc, 'up' AS direction FROM folds WHERE "group" = 'r1' AND log2fc > 0 ORDER BY log2fc DESC, gene LIMIT 10)
UNION ALL SELECT gene, log2fc, direction FROM (SELECT gene, log2fc, 'down' AS direction FROM folds WHERE "group" = 'r1' AND log2fc < 0 ORDER BY log2fc, gene LIMIT 10)""", **_FOLD),
    "dge_welch_t": sql("SELECT * FROM tests", **_WELCH),
    "dge_bh_adjust": sql(
        "SELECT gene, round(least(min(p * n / r) OVER (ORDER BY r DESC), 1), 5) + 0.0 AS p_adjusted FROM (SELECT gene, 1 / (1 + abs(t)) AS p, row_number() OVER (ORDER BY 1 / (1 + abs(t)), gene) AS r, count(*) OVER () AS n FROM tests WHERE t IS NOT NULL)",
        **_WELCH,
    ),
    "ora_scores": sql("SELECT cell, geneset, overlap, round(CASE WHEN p IS NULL THEN 0 ELSE -log10(p) END, 4) + 0.0 AS score FROM grid_o LEFT JOIN tails USING (m, d, overlap)", **_ORA),
    "ulm_scores": sql(
        """SELECT cell, source, round(r * sqrt((n - 2) / greatest(1 - r * r, 1e-15)), 5) + 0.0 AS t FROM (SELECT cell, source, n, (coalesce(vw, 0) - sv * sw / n) / sqrt((qv - sv ** 2 / n) * (qw - sw ** 2 / n)) AS r
FROM (SELECT * FROM by_cell CROSS JOIN by_source) LEFT JOIN met USING (cell, source))""",
        network="SELECT p_brand AS source, p_partkey AS gene, CASE WHEN p_size % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS weight FROM part",
        by_source="SELECT source, sum(weight) AS sw, sum(weight ** 2) AS qw, (SELECT count(*) FROM part)::DOUBLE AS n FROM network GROUP BY 1 HAVING count(*) >= 5",
        by_cell="SELECT cell, sum(value) AS sv, sum(value ** 2) AS qv FROM counts GROUP BY 1",
        met="SELECT cell, source, sum(value * weight) AS vw FROM counts JOIN network USING (gene) GROUP BY 1, 2",
    ),
    "gene_set_score": sql(
        "SELECT cell, geneset, round(sm / m - coalesce(sc / nullif(c, 0), 0), 5) + 0.0 AS score FROM (SELECT cell, geneset, sum(CASE WHEN member THEN value ELSE 0 END) AS sm, sum(CASE WHEN member THEN 0 ELSE value END) AS sc FROM counts JOIN assigned USING (gene) GROUP BY 1, 2) JOIN sizes USING (geneset)",
        **_MEANS, binned="SELECT gene, ntile(10) OVER (ORDER BY mean, gene) AS bin FROM gene_means",
        members="SELECT DISTINCT p_brand AS geneset, gene, bin FROM part JOIN binned ON gene = p_partkey",
        controls="SELECT m.geneset, b.gene FROM (SELECT DISTINCT geneset, bin FROM members) m JOIN binned b USING (bin) WHERE NOT EXISTS (SELECT 1 FROM members x WHERE x.geneset = m.geneset AND x.gene = b.gene)",
        assigned="SELECT geneset, gene, true AS member FROM members UNION ALL SELECT geneset, gene, false FROM controls",
        sizes="SELECT geneset, count(*) FILTER (member) AS m, count(*) FILTER (NOT member) AS c FROM assigned GROUP BY 1",
    ),
    "geneset_filter_strip": "SELECT DISTINCT regexp_replace(geneset, '^[^_]*_', '') AS geneset, genesymbol FROM gene_sets WHERE collection = 'go_biological_process' AND genesymbol IS NOT NULL AND (contains(upper(geneset), 'GROWTH') OR contains(upper(geneset), 'REPAIR'))",
    "pattern_mean_scaled": sql(
        "SELECT module, cell, round(coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0), 6) + 0.0 AS value FROM (SELECT module, cell, coalesce(s, 0) / n AS v FROM (SELECT * FROM (SELECT p_type AS module, count(*) AS n FROM part GROUP BY 1) CROSS JOIN (SELECT DISTINCT cell FROM counts)) LEFT JOIN (SELECT p_type AS module, cell, sum(value) AS s FROM counts JOIN part ON p_partkey = gene GROUP BY 1, 2) USING (module, cell)) WINDOW w AS (PARTITION BY cell)",
    ),
    "cna_conflicts": _predicted(
        "SELECT cell_id, string_agg(DISTINCT cell_type, ',' ORDER BY cell_type) AS labels FROM both_calls GROUP BY 1 HAVING count(DISTINCT cell_type) > 1",
        both_calls="SELECT cell_id, cell_type FROM valid UNION ALL SELECT trim(f[1]), CASE WHEN CAST(trim(f[3]) AS DOUBLE) >= 0.5 THEN 'aneuploid' ELSE 'diploid' END FROM judged WHERE reason IS NULL AND trim(f[3]) <> ''",
    ),
    "cna_merge_predictions": _predicted(_MERGED),
    "cna_label_lookup": _predicted(
        """SELECT barcode, coalesce(a.cell_type, b.cell_type, 'NA') AS cell_type, CAST(CASE coalesce(a.cell_type, b.cell_type, 'NA') WHEN 'aneuploid' THEN 0 WHEN 'diploid' THEN 1 ELSE 99 END AS INTEGER) AS place
FROM (SELECT spot_barcodes AS barcode FROM cells WHERE spot_barcodes IS NOT NULL UNION SELECT cell_id FROM valid UNION SELECT translate(cell_id, '.-', '-.') FROM valid) LEFT JOIN merged a ON a.cell_id = barcode LEFT JOIN merged b ON b.cell_id = translate(barcode, '.-', '-.')""",
        merged=_MERGED,
    ),
    "cna_flip_ids": _predicted("SELECT line_id, translate(cell_id, '.-', '-.') AS flipped FROM valid"),
    "cna_chunks": "SELECT CAST(k AS INTEGER) AS chunk, CASE WHEN k < n % c THEN n // c + 1 ELSE n // c END AS cells FROM (SELECT n, c, unnest(range(c)) AS k FROM (SELECT count(DISTINCT cell_id) AS n, (count(DISTINCT cell_id) + 999) // 1000 AS c FROM cells))",
    "cna_combine": "SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag, sum(CASE WHEN l_suppkey % 2 = 0 THEN l_quantity ELSE 0 END) AS half_0, sum(CASE WHEN l_suppkey % 2 = 1 THEN l_quantity ELSE 0 END) AS half_1 FROM lineitem GROUP BY 1, 2",
    "ligrec_pathway_filter": "SELECT geneset, count(*) AS members FROM marker_sets WHERE upper(collection) = 'CELL_MARKER' GROUP BY 1",
    "distance_pairs": sql("SELECT a.cell AS i, b.cell AS j, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) + 0.0 AS d FROM features a JOIN features b ON a.sample_id = b.sample_id WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 500.0 * 500.0"),
    "filter_zero_cells": sql("SELECT cell FROM genes WHERE value > 0 GROUP BY 1 HAVING sum(value) > 0"),
    "key_clean": "SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events",
    "roi_json_parse": """WITH box AS (SELECT event_type, min(value) AS x0, max(value) AS x1, min(user_id)::DOUBLE AS y0, max(user_id)::DOUBLE AS y1 FROM events GROUP BY 1),
points AS (SELECT event_type, 'rect' AS form, unnest([0, 1, 2, 3, 4]) AS vertex, unnest([x0, x1, x1, x0, x0]) AS x, unnest([y0, y0, y1, y1, y0]) AS y FROM box
UNION ALL SELECT event_type, 'path', unnest([0, 1, 2, 3]), unnest([x0, x1, x1, x0]), unnest([y0, y0, y1, y0]) FROM box)
SELECT event_type, form, vertex, round(x / 2, 4) + 0.0 AS x, round(y / 2, 4) + 0.0 AS y FROM points""",
    "mask_centroids": sql("SELECT sample_id, cell AS label, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, pixels FROM centres", **_PIXELS),
    "patch_stats": sql("SELECT sample_id, cell, round(avg(gray), 8) + 0.0 AS mean_gray, round(stddev_pop(gray), 8) + 0.0 AS std_gray FROM patch GROUP BY 1, 2", **_PIXELS),
    "patch_entropy": sql("SELECT sample_id, cell, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0.0 AS entropy FROM levels GROUP BY 1, 2", **_PIXELS, levels="SELECT sample_id, cell, gray, count(*) AS n FROM patch GROUP BY 1, 2, 3"),
    "paint_mask": sql('SELECT p.sample_id, p."row", p.col, expr_pc1 AS value FROM pixels p JOIN features f ON f.cell = p.label AND f.sample_id = p.sample_id', **_PIXELS),
    "color_limits": sql("SELECT sample_id, round(quantile_cont(expr_pc1, 0.01), 6) + 0.0 AS vmin, round(quantile_cont(expr_pc1, 0.99), 6) + 0.0 AS vmax FROM features GROUP BY 1"),
    "features_left_join_suffix": sql(
        "SELECT f.cell, f.clusters AS clusters_default, mean_gray, clusters_external, barcode FROM features f LEFT JOIN outside USING (cell)",
        outside="SELECT cell_id AS cell, max(nullif(trim(clusters), '')) AS clusters_external, max(spot_barcodes) AS barcode FROM cells GROUP BY 1",
    ),
    "logistic_dropout_prob": sql("SELECT gene, round(1 / (1 + exp(2.0 * (ln(mean) - 1.5))), 6) + 0.0 AS chance FROM gene_means", **_MEANS),
    "spot_mode_label": sql(
        "SELECT sample_id, spot, clusters AS majority FROM (SELECT sample_id, spot, clusters, row_number() OVER (PARTITION BY sample_id, spot ORDER BY count(*) DESC, clusters) AS r FROM placed WHERE clusters IS NOT NULL GROUP BY 1, 2, 3) WHERE r = 1",
        placed="SELECT cell, sample_id, clusters, concat_ws('_', 'SPOT', CAST(floor((x - min(x) OVER w + 750) / 1500) AS BIGINT), CAST(floor((y - min(y) OVER w + 750) / 1500) AS BIGINT)) AS spot FROM features WINDOW w AS (PARTITION BY sample_id)",
    ),
}

#: What queries need of a cell, where it isn't everything.
_NEEDS: dict[str, tuple[str, ...]] = {"color_limits": ("expr_pc1",), "distance_pairs": (*parts.PLACE,), "features_left_join_suffix": ("mean_gray",), "filter_zero_cells": (*parts.GENES,), "smoothed_set_score": (*parts.PLACE, *parts.GENES,), "spot_mode_label": (*parts.PLACE,)}
SQL = parts.needing(SQL, {k: v for k, v in _NEEDS.items() if k in SQL})
