"""Further queries over groups, scales, rasters and variants, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuegrid.common import rounded, stage, table
from tissuegrid.functions import scales, shapes
from tissuegrid.operators import analysis, diffusion, graph, images, labels, matrix, simulate, spatial
from tissuegrid.plans import cells as cell_plans
from tissuegrid.plans import parts, profiles
from tissuegrid.plans.parts import SHARE, sql


def _r(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(c, places) for c in columns})


def dge_rank_sum(spark, folder):
    counts = stage(parts.counts(spark, folder))
    return _r(analysis.rank_sum(counts, stage(profiles._regions(counts, spark, folder)), "r0", "r1"), "z", places=5)


def dge_welch_overestimated(spark, folder):
    counts = stage(parts.counts(spark, folder))
    return _r(analysis.welch(counts, profiles._regions(counts, spark, folder), "r0", "r1", True).select("gene", "t", "df"), "t", "df", places=5)


def annotate_clusters(spark, folder):
    """The most frequent tissue label of each spot, given back to its cells."""
    cells = stage(parts.features(spark, folder, *parts.PLACE))
    return labels.annotated(cells.join(parts.spots_of(cells), "cell"), "spot", "clusters", "annotation", 0.2).select("cell", "annotation")


def annotate_by_expression(spark, folder):
    """Clusters of the components, each named after its most frequent label."""
    cells = stage(parts.features(spark, folder, *parts.GENES))
    found = matrix.k_means(matrix.component_scores(cells, "cell", parts.GENES, 2), "cell", ["pc1", "pc2"], 20)
    return labels.annotated(cells.join(found, "cell"), "cluster", "clusters", "annotation").select("cell", "annotation")


def marker_levels(spark, folder):
    cells = stage(parts.features(spark, folder, *parts.GENES))
    markers = cells.sparkSession.createDataFrame([("expr_pc1", "tumor_core"), ("expr_pc2", "stroma_mix"), ("expr_pc3", "immune_edge")], "gene string, marks string")
    return labels.levels(parts.genes(cells), cells.filter("clusters is not null"), "clusters", F.broadcast(markers))


def pixel_sizes(spark, folder):
    s = table(spark, folder, "samples")
    return _r(s.select("sample_id", scales.microns_per_pixel(F.col("spot_diameter_fullres")).alias("full"), scales.microns_per_pixel(F.col("spot_diameter_fullres"), F.col("tissue_hires_scalef")).alias("hires")), "full", "hires")


def list_set_ops(spark, folder):
    """Tags of posts in the order of a reference list, and those it lacks."""
    reference = F.array(*map(F.lit, ("matrix", "record", "replica", "commit", "token")))
    tags = table(spark, folder, "documents").filter("tags is not null and size(tags) > 0").select("doc_id", "tags")
    return tags.select("doc_id", F.array_join(scales.in_order_of(F.col("tags"), reference), ",").alias("known"), F.array_join(scales.without(F.col("tags"), reference), ",").alias("others"))


def gene_symbols(spark, folder):
    part = table(spark, folder, "part").filter("p_size > 10").select(F.col("p_partkey").alias("gene"), F.col("p_name").alias("symbol"))
    genes = table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("total"))
    return scales.with_symbols(genes, "l_partkey", part)


def transition_outward(spark, folder):
    cells = stage(parts.features(spark, folder, *parts.PLACE, *parts.MORPH))
    return _r(graph.transition_outward(parts.snn(parts.knn(cells)), parts.weights(cells), SHARE), "t")


def density_smooth(spark, folder):
    """Components smoothed over four times the median number of cells in a spot."""
    cells = stage(parts.features(spark, folder, *parts.PLACE, *parts.GENES))
    k = 4 * cell_plans.median_cells_per_spot(spark, folder).first()["cells"]
    return _r(diffusion.smooth(parts.genes(cells), spatial.knn_edges(cells, "cell", ["x", "y"], int(k), ["sample_id"])), "value", places=8)


def integrated_components(spark, folder):
    """Two halves of the suppliers over the common part types, reduced together."""
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    entries = stage(lines.groupBy(F.col("l_suppkey").alias("cell"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value")))
    return matrix.integrated({k: entries.filter(F.col("cell") % 2 == v) for k, v in (("even", 0), ("odd", 1))}, 3)


def likely_separation(spark, folder):
    return _r(simulate.likely_separation(parts.features(spark, folder, *parts.PLACE), ["sample_id"]), "separation")


def voronoi_raster(spark, folder):
    """The nearest centre of each painted pixel."""
    pixels = profiles._pixels(spark, folder)
    centres = images.centroids(pixels, ["sample_id"]).withColumnRenamed("label", "cell")
    named = pixels.select("sample_id", "row", "col", F.concat_ws(":", "sample_id", F.col("row").cast("string"), F.col("col").cast("string")).alias("pixel"))
    return images.nearest_cell(named, centres, 8.0, ["sample_id"]).select("pixel", "cell")


def image_features(spark, folder):
    """Features measured again from the painted pixels, outliers left out."""
    pixels = profiles._pixels(spark, folder)
    return images.cell_features(pixels, ["sample_id"], ["gray"])


def minmax_expression(spark, folder):
    """Components scaled to [0, 1] over all cells, as an encoder takes them."""
    return _r(matrix.minmax(parts.features(spark, folder, *parts.GENES).select("cell", *parts.GENES), parts.GENES), *parts.GENES)


def spots_per_label(spark, folder):
    """Spots of the pitch by sample and label, with their cells."""
    cells = stage(parts.features(spark, folder, *parts.PLACE))
    placed = cells.join(parts.spots_of(cells), "cell").filter("clusters is not null")
    return placed.groupBy("sample_id", "clusters").agg(F.count_distinct("spot").alias("spots"), F.count("*").alias("cells"))


def mask_at_least(spark, folder):
    """Pixels of the cells whose first component is 0 or more, in one colour."""
    return images.at_least(profiles.paint_mask(spark, folder), 0.0)


def sampled_molecules(spark, folder):
    """Pixels painted for each cell and component, as many as the level asks for."""
    pixels = profiles._pixels(spark, folder)
    values = stage(parts.features(spark, folder)).select("sample_id", F.col("cell").alias("label"), *parts.GENES).unpivot(["sample_id", "label"], parts.GENES, "gene", "value")
    return images.sampled_painting(pixels, values, ["sample_id"], seed=3).groupBy("sample_id", "gene", "label").agg(F.count("*").alias("pixels"))


def masked_entries(spark, folder):
    """Summed quantities without the parts of small size."""
    counts = parts.counts(spark, folder)
    small = table(spark, folder, "part").select(F.col("p_partkey").alias("gene"), (F.col("p_size") <= 5).alias("small"))
    return matrix.masked(counts.join(small, "gene", "left"), F.col("small")).select("cell", "gene", "value")


def stored_entries(spark, folder):
    """Components as entries."""
    return matrix.stored(parts.features(spark, folder, *parts.GENES), "cell", parts.GENES)


def roi_first_polygon(spark, folder):
    """The first of two rectangles drawn for each event type, as 100 points."""
    box = table(spark, folder, "events").groupBy("event_type").agg(F.min("value").alias("x0"), F.max("value").alias("x1"), F.min("user_id").cast("double").alias("y0"), F.max("user_id").cast("double").alias("y1"))
    shape = lambda d: F.struct(F.lit("rect").alias("type"), *((F.col(c) + d).alias(c) for c in ("x0", "y0", "x1", "y1")))
    drawn = box.select("event_type", F.to_json(F.struct(F.array(shape(0), shape(50)).alias("shapes"))).alias("json"))
    return _r(shapes.first_polygon(drawn, "json", ["event_type"]), "x", "y", places=3)


_NAMES = (
    mask_at_least, sampled_molecules, masked_entries, stored_entries, roi_first_polygon,
    dge_rank_sum, dge_welch_overestimated, annotate_clusters, annotate_by_expression, marker_levels, pixel_sizes, list_set_ops, gene_symbols, transition_outward, density_smooth,
    integrated_components, likely_separation, voronoi_raster, image_features, minmax_expression, spots_per_label,
)
QUERIES = {f.__name__: f for f in _NAMES}

_REFERENCE = "['matrix', 'record', 'replica', 'commit', 'token']"
_W = profiles._WELCH
SQL = {
    "mask_at_least": sql('SELECT p.sample_id, p."row", p.col, 1.0::DOUBLE AS value FROM pixels p JOIN features f ON f.cell = p.label AND f.sample_id = p.sample_id WHERE expr_pc1 >= 0', **{k: profiles._PIXELS[k] for k in ("pixels_all", "pixels")}),
    "sampled_molecules": sql(
        "SELECT sample_id, gene, label, n AS pixels FROM (SELECT levels.sample_id, gene, cell AS label, CAST(floor(size * least(share * 2.0::DOUBLE, 1)) AS BIGINT) AS n FROM levels JOIN sizes ON label = cell AND sizes.sample_id = levels.sample_id) WHERE n > 0",
        **{k: profiles._PIXELS[k] for k in ("pixels_all", "pixels")},
        sizes="SELECT sample_id, label, count(*) AS size FROM pixels WHERE label > 0 GROUP BY 1, 2",
        levels="SELECT features.sample_id, cell, gene, CASE WHEN max(value) OVER w > min(value) OVER w THEN least((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 1) WHEN max(value) OVER w = 0 THEN 0 ELSE 1 END AS share FROM genes JOIN features USING (cell) WINDOW w AS (PARTITION BY features.sample_id, gene)",
    ),
    "masked_entries": sql("SELECT cell, gene, value FROM counts LEFT JOIN part ON p_partkey = gene WHERE value <> 0 AND NOT coalesce(p_size <= 5, false)"),
    "stored_entries": sql("SELECT cell, gene, value FROM genes WHERE value <> 0"),
    "roi_first_polygon": """WITH box AS (SELECT event_type, min(value) AS x0, max(value) AS x1, min(user_id)::DOUBLE AS y0, max(user_id)::DOUBLE AS y1 FROM events GROUP BY 1),
placed AS (SELECT event_type, x0, x1, y0, y1, x1 - x0 AS w, y1 - y0 AS h, CAST(k AS INTEGER) AS k, 2 * (x1 - x0 + y1 - y0) * k / 99 AS s FROM box, (SELECT unnest(range(100)) AS k))
SELECT event_type, k, round(CASE WHEN s < w THEN x0 + s WHEN s < w + h THEN x1 WHEN s < 2 * w + h THEN x1 - (s - w - h) ELSE x0 END, 3) + 0.0 AS x,
round(CASE WHEN s < w THEN y0 WHEN s < w + h THEN y0 + s - w WHEN s < 2 * w + h THEN y1 ELSE greatest(y1 - (s - 2 * w - h), y0) END, 3) + 0.0 AS y FROM placed""",
    "dge_rank_sum": sql(
        """SELECT gene, round((w - na * (na + nb + 1) / 2.0) / sqrt(CASE WHEN v > 0 THEN v END), 5) + 0.0 AS z FROM (SELECT gene, w, na, nb, na * nb / 12.0::DOUBLE * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1))) AS v FROM summed, na)""",
        regions=_W["regions"], groups=_W["groups"], na=_W["na"],
        grid="SELECT gene, cell, grp, coalesce(value, 0) AS value FROM (SELECT DISTINCT gene FROM counts JOIN regions USING (cell) WHERE grp IN ('r0', 'r1')) CROSS JOIN (SELECT cell, grp FROM regions WHERE grp IN ('r0', 'r1')) LEFT JOIN counts USING (gene, cell)",
        ranked="SELECT gene, grp, value, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY gene, value) AS c FROM grid",
        summed="SELECT gene, sum(r) FILTER (grp = 'r0') AS w, sum(c::DOUBLE * c - 1) AS ties FROM ranked GROUP BY 1",
    ),
    "dge_welch_overestimated": sql(
        "SELECT gene, round(CASE WHEN ea + eo > 0 THEN (ma - mb) / sqrt(ea + eo) END, 5) + 0.0 AS t, round(CASE WHEN ea + eo > 0 THEN (ea + eo) ** 2 / (ea ** 2 / (na - 1) + eo ** 2 / (na - 1)) END, 5) + 0.0 AS df FROM (SELECT *, eb * nb / na AS eo FROM errors)",
        **{k: _W[k] for k in ("regions", "groups", "na", "sums", "errors")},
    ),
    "annotate_clusters": sql(
        "SELECT cell, majority AS annotation FROM spot_of LEFT JOIN (SELECT spot, CASE WHEN n / total > 0.2 THEN clusters END AS majority FROM (SELECT spot, clusters, n, sum(n) OVER (PARTITION BY spot) AS total, row_number() OVER (PARTITION BY spot ORDER BY n DESC, clusters) AS r FROM label_counts) WHERE r = 1) USING (spot)",
        **cell_plans._LABELS,
    ),
    "marker_levels": sql("SELECT cell, gene, value, clusters, CASE WHEN (gene, clusters) IN (('expr_pc1', 'tumor_core'), ('expr_pc2', 'stroma_mix'), ('expr_pc3', 'immune_edge')) THEN 'high' ELSE 'low' END AS level FROM genes JOIN features USING (cell) WHERE clusters IS NOT NULL"),
    "pixel_sizes": "SELECT sample_id, round(65 / CASE WHEN NOT isnan(spot_diameter_fullres) AND spot_diameter_fullres > 0 THEN spot_diameter_fullres END, 6) + 0.0 AS \"full\", round(65 / CASE WHEN NOT isnan(spot_diameter_fullres) AND spot_diameter_fullres > 0 THEN spot_diameter_fullres END / CASE WHEN NOT isnan(tissue_hires_scalef) AND tissue_hires_scalef > 0 THEN tissue_hires_scalef END, 6) + 0.0 AS hires FROM samples",
    "list_set_ops": f"SELECT doc_id, array_to_string(CASE WHEN len(list_intersect({_REFERENCE}, tags)) > 0 THEN list_filter({_REFERENCE}, lambda t: list_contains(tags, t)) ELSE {_REFERENCE} END, ',') AS known, array_to_string(list_filter(tags, lambda t, i: NOT list_contains({_REFERENCE}, t) AND list_position(tags, t) = i), ',') AS others FROM documents WHERE tags IS NOT NULL AND len(tags) > 0",
    "gene_symbols": "SELECT l_partkey, sum(l_quantity) AS total, coalesce(any_value(p_name), CAST(l_partkey AS VARCHAR)) AS symbol FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey GROUP BY 1",
    "transition_outward": sql(f"SELECT dst, src, round(w * flow / sum(w * flow) OVER (PARTITION BY dst) * (1 - weight) * {SHARE}, 6) + 0.0 AS t FROM flows JOIN weights ON cell = dst UNION ALL SELECT cell, cell, round(1 - {SHARE}::DOUBLE, 6) + 0.0 FROM weights"),
    "density_smooth": sql(
        "SELECT i AS cell, gene, round(avg(value), 8) + 0.0 AS value FROM (SELECT i, j FROM near UNION ALL SELECT cell, cell FROM features) JOIN genes ON genes.cell = j GROUP BY 1, 2",
        sizes="SELECT spot, count(*) AS n FROM spot_of GROUP BY 1",
        near="SELECT i, j FROM (SELECT a.cell AS i, b.cell AS j, row_number() OVER (PARTITION BY a.cell ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.cell) AS r FROM features a JOIN features b ON a.sample_id = b.sample_id AND a.cell <> b.cell) WHERE r <= 4 * (SELECT floor(quantile_cont(n, 0.5)) FROM sizes)",
    ),
    "likely_separation": sql(
        "SELECT sample_id, round(edge, 6) + 0.0 AS separation FROM (SELECT sample_id, l + k * width AS edge, row_number() OVER (PARTITION BY sample_id ORDER BY count(*) DESC, k) AS r FROM binned GROUP BY sample_id, l, width, k) WHERE r = 1",
        near=cell_plans._NEAREST,
        ranged="SELECT sample_id, d, min(d) OVER w AS l, max(d) OVER w AS u FROM near WHERE r = 1 WINDOW w AS (PARTITION BY sample_id)",
        binned="SELECT sample_id, l, (u - l) / greatest(floor(u - l), 1) AS width, least(floor((d - l) / ((u - l) / greatest(floor(u - l), 1))), greatest(floor(u - l), 1) - 1) AS k FROM ranged",
    ),
    "minmax_expression": sql("SELECT cell, " + ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) + 0.0 AS {c}" for c in parts.GENES) + " FROM features"),
    "spots_per_label": sql("SELECT sample_id, clusters, count(DISTINCT spot) AS spots, count(*) AS cells FROM features JOIN spot_of USING (cell) WHERE clusters IS NOT NULL GROUP BY 1, 2"),
    "voronoi_raster": sql(
        """SELECT pixel, cell FROM (SELECT p.sample_id || ':' || p."row" || ':' || p.col AS pixel, c.cell, row_number() OVER (PARTITION BY p.sample_id, p."row", p.col ORDER BY (p.col - c.x) ** 2 + (p."row" - c.y) ** 2, c.cell) AS r
FROM pixels p JOIN centres c ON p.sample_id = c.sample_id AND c.x BETWEEN p.col - 8 AND p.col + 8 AND c.y BETWEEN p."row" - 8 AND p."row" + 8 AND (p.col - c.x) ** 2 + (p."row" - c.y) ** 2 <= 64) WHERE r = 1""",
        **{k: profiles._PIXELS[k] for k in ("pixels_all", "pixels", "centres")},
    ),
}

#: What queries need of a cell, where it isn't everything.
_NEEDS: dict[str, tuple[str, ...]] = {"annotate_by_expression": (*parts.GENES,), "annotate_clusters": (*parts.PLACE,), "density_smooth": (*parts.PLACE, *parts.GENES,), "likely_separation": (*parts.PLACE,), "marker_levels": (*parts.GENES,), "minmax_expression": (*parts.GENES,), "spots_per_label": (*parts.PLACE,), "stored_entries": (*parts.GENES,), "transition_outward": (*parts.PLACE, *parts.MORPH,)}
SQL = parts.needing(SQL, {k: v for k, v in _NEEDS.items() if k in SQL})
