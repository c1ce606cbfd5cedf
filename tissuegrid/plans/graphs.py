"""Queries over cell graphs, transitions and diffusion, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuegrid.common import rounded, stage
from tissuegrid.operators import diffusion, graph, spatial
from tissuegrid.plans import parts
from tissuegrid.plans.parts import K, SHARE, sql


def _cells(spark: SparkSession, folder: str, *need: str) -> DataFrame:
    return stage(parts.features(spark, folder, *need))


def _transition(cells: DataFrame) -> DataFrame:
    return stage(graph.transition(parts.snn(parts.knn(cells)), parts.weights(cells), SHARE))


def _r(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(c, places) for c in columns})


def knn_edges(spark, folder):
    return _r(parts.knn(_cells(spark, folder, *parts.PLACE, *parts.MORPH)), "d")


def knn_constrained(spark, folder):
    return _r(spatial.constrained_knn(_cells(spark, folder, *parts.PLACE, *parts.MORPH), parts.MORPH, K, 1500.0, ["sample_id"]), "d")


def radius_edges(spark, folder):
    return _r(spatial.radius_edges(_cells(spark, folder, *parts.PLACE), 600.0, ["sample_id"]), "d")


def snn_edges(spark, folder):
    return _r(graph.shared_neighbours(parts.knn(_cells(spark, folder, *parts.PLACE, *parts.MORPH)), K), "w")


def snn_thresholded(spark, folder):
    return _r(graph.thresholded(graph.shared_neighbours(parts.knn(_cells(spark, folder, *parts.PLACE, *parts.MORPH)), K), 0.4), "w")


def snn_of_neighbours(spark, folder):
    return _r(graph.shared_neighbours(parts.knn(_cells(spark, folder, *parts.PLACE, *parts.MORPH)), K, True), "w")


def snn_distance(spark, folder):
    knn = parts.knn(_cells(spark, folder, *parts.PLACE, *parts.MORPH))
    return _r(graph.with_distance(parts.snn(knn), knn), "w", "d")


def hop2_cells(spark, folder):
    return graph.two_hops(parts.knn(_cells(spark, folder, *parts.PLACE, *parts.MORPH)))


def hop2_spots(spark, folder):
    cells = _cells(spark, folder, *parts.PLACE, *parts.MORPH)
    return graph.hop_spots(parts.knn(cells), parts.spots_of(cells))


def hop2_spot_cells(spark, folder):
    cells = _cells(spark, folder, *parts.PLACE, *parts.MORPH)
    return graph.hop_spot_cells(parts.knn(cells), parts.spots_of(cells))


def graph_symmetry(spark, folder):
    """Differing entries of the shared-neighbour graph (none) and of the neighbour graph."""
    knn = parts.knn(_cells(spark, folder, *parts.PLACE, *parts.MORPH))
    count = lambda e, name: graph.asymmetric(e).agg(F.count("*").alias("differing")).select(F.lit(name).alias("graph"), "differing")
    return count(parts.snn(knn), "snn").unionByName(count(knn.withColumn("w", F.lit(1.0)), "knn"))


def degree_stats(spark, folder):
    return _r(graph.degrees(parts.snn(parts.knn(_cells(spark, folder, *parts.PLACE, *parts.MORPH)))), "strength")


def neighbour_lists(spark, folder):
    return graph.neighbour_lists(parts.knn(_cells(spark, folder, *parts.PLACE, *parts.MORPH))).select("i", F.array_join("neighbours", ",").alias("neighbours"))


def node_weights(spark, folder):
    return _r(parts.weights(_cells(spark, folder, *parts.PLACE, *parts.MORPH)), "weight")


def node_weights_balanced(spark, folder):
    cells = _cells(spark, folder, "entropy_img")
    return _r(graph.balanced(cells.select("cell", "sample_id", "entropy_img"), "entropy_img", ["sample_id"]).select("cell", "balance"), "balance")


def preferential_flow(spark, folder):
    cells = _cells(spark, folder, *parts.PLACE, *parts.MORPH)
    return _r(graph.flow_edges(parts.snn(parts.knn(cells)), parts.weights(cells)), "w", "flow")


def transition_matrix(spark, folder):
    return _r(_transition(_cells(spark, folder, *parts.PLACE, *parts.MORPH)), "t")


def transition_rowsum(spark, folder):
    return _r(_transition(_cells(spark, folder, *parts.PLACE, *parts.MORPH)).groupBy("dst").agg(F.sum("t").alias("total")), "total")


def inflation_transition(spark, folder):
    cells = _cells(spark, folder, *parts.PLACE, *parts.MORPH)
    return _r(graph.inflated(parts.snn(parts.knn(cells)), parts.weights(cells), SHARE, 0.0), "t")


def diffuse_1step(spark, folder):
    cells = _cells(spark, folder)
    return _r(diffusion.step(parts.genes(cells), _transition(cells)), "value")


def quantile_align(spark, folder):
    """Each component after one step, given back the spread it had before."""
    cells = _cells(spark, folder)
    genes = stage(parts.genes(cells))
    return _r(diffusion.stabilize(stage(diffusion.step(genes, _transition(cells))), genes), "value", places=4)


def diffuse_stabilized_3(spark, folder):
    cells = _cells(spark, folder)
    return _r(diffusion.diffuse(parts.genes(cells), _transition(cells), 3, near=cells.select("cell", "sample_id"))[3], "value", places=4)


def rescale_mean(spark, folder):
    cells = _cells(spark, folder)
    genes = stage(parts.genes(cells))
    return _r(diffusion.rescale_mean(diffusion.step(genes, _transition(cells)), genes, parts.spots_of(cells)), "value")


def neighbor_mean_std(spark, folder):
    cells = _cells(spark, folder)
    return _r(_r(diffusion.neighbour_stats(parts.genes(cells), parts.snn(parts.knn(cells))), "mean", places=9), "std", places=5)


def knn_smooth(spark, folder):
    cells = _cells(spark, folder, *parts.PLACE, *parts.GENES)
    return _r(diffusion.smooth(parts.genes(cells), spatial.knn_edges(cells, "cell", ["x", "y"], 20, ["sample_id"])), "value")


def radius_smooth(spark, folder):
    cells = _cells(spark, folder, *parts.PLACE, *parts.GENES)
    return _r(diffusion.smooth(parts.genes(cells), spatial.radius_edges(cells, 600.0, ["sample_id"])), "value", places=9)


def sample_expression(spark, folder):
    """Random draws; equal in every run because they depend on seed, cell and gene only."""
    cells = _cells(spark, folder)
    return diffusion.sample(parts.genes(cells), parts.snn(parts.knn(cells)), seed=7, steps=10)


QUERIES = {
    f.__name__: f
    for f in (
        knn_edges, knn_constrained, radius_edges, snn_edges, snn_thresholded, snn_of_neighbours, snn_distance, hop2_cells, hop2_spots, hop2_spot_cells, graph_symmetry,
        degree_stats, neighbour_lists, node_weights, node_weights_balanced, preferential_flow, transition_matrix, transition_rowsum, inflation_transition,
        diffuse_1step, quantile_align, diffuse_stabilized_3, rescale_mean, neighbor_mean_std, knn_smooth, radius_smooth, sample_expression,
    )
}

_R = "round({0}, {1}) + 0.0 AS {0}"
_r6 = lambda *c: ", ".join(_R.format(x, 6) for x in c)
_HOPS = "SELECT DISTINCT a.i, b.j FROM knn a JOIN knn b ON a.j = b.i"
_HOP_SPOTS = "SELECT DISTINCT i, spot FROM (SELECT i, j FROM knn UNION SELECT i, j FROM hops) JOIN spot_of ON cell = j"
_RADIUS = "SELECT a.cell AS i, b.cell AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM features a JOIN features b ON a.sample_id = b.sample_id AND a.cell <> b.cell WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {0} * {0}"
_STEP = "SELECT dst AS cell, gene, sum(t * value) AS value FROM transition JOIN {0} s ON s.cell = src GROUP BY 1, 2"


def _stabilize(new: str, out: str, ref: str) -> dict[str, str]:
    """Parts that stabilise `new` against `ref`, the iteration before."""
    q = "CASE WHEN count(*) > 10 THEN 5.0 / count(*) ELSE 0 END"
    ranked = "SELECT *, row_number() OVER (PARTITION BY gene ORDER BY value, cell) AS r FROM {0}"

    def quantile(of: str, high: bool) -> str:
        at = f"((1 - {q}) * (count(*) - 1))" if high else f"({q} * (count(*) - 1))"
        lo, hi = f"list(value ORDER BY value)[CAST(floor({at}) AS BIGINT) + 1]", f"list(value ORDER BY value)[CAST(ceil({at}) AS BIGINT) + 1]"
        return f"{lo} + ({hi} - {lo}) * ({at} - floor({at}))"

    scaled = "CASE WHEN {0}l = {0}u THEN value - {0}u ELSE (value - {0}l) / ({0}u - {0}l) * 2 - 1 END"
    return {
        f"{out}_a": f"SELECT gene, {quantile(new, False)} AS al, {quantile(new, True)} AS au FROM {new} GROUP BY gene",
        f"{out}_b": f"SELECT gene, {quantile(ref, False)} AS bl, {quantile(ref, True)} AS bu FROM {ref} GROUP BY gene",
        f"{out}_x": f"SELECT cell, gene, r, value, {scaled.format('a')} AS x FROM ({ranked.format(new)}) JOIN {out}_a USING (gene)",
        f"{out}_y": f"SELECT gene, r, {scaled.format('b')} AS y, bl, bu FROM ({ranked.format(ref)}) JOIN {out}_b USING (gene)",
        out: f"SELECT cell, gene, 0.5 * (avg((x + y) / 2) OVER (PARTITION BY gene, value) + 1) * (bu - bl) + bl AS value FROM {out}_x JOIN {out}_y USING (gene, r)",
    }


_THREE = {"s1": _STEP.format("genes")} | _stabilize("s1", "d1", "genes") | {"s2": _STEP.format("d1")} | _stabilize("s2", "d2", "d1") | {"s3": _STEP.format("d2")} | _stabilize("s3", "d3", "d2")
_SMOOTH = "SELECT i AS cell, gene, round(avg(value), {1}) + 0.0 AS value FROM (SELECT i, j FROM {0} UNION ALL SELECT cell, cell FROM features) JOIN genes ON genes.cell = j GROUP BY 1, 2"

SQL = {
    "knn_edges": sql(f"SELECT i, j, {_r6('d')} FROM knn"),
    "knn_constrained": sql(
        f"SELECT i, j, {_r6('d')} FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM met) WHERE r <= {K}",
        met=f"""SELECT a.cell AS i, b.cell AS j, sqrt({" + ".join(f"(a.{c} - b.{c}) ** 2" for c in parts.MORPH)}) AS d FROM features a JOIN features b
ON a.sample_id = b.sample_id AND a.cell <> b.cell WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1500.0 * 1500.0""",
    ),
    "radius_edges": sql(f"SELECT i, j, {_r6('d')} FROM near", near=_RADIUS.format(600.0)),
    "snn_edges": sql(f"SELECT i, j, {_r6('w')} FROM snn_all"),
    "snn_thresholded": sql(f"SELECT i, j, {_r6('w')} FROM snn_all WHERE w >= 0.4"),
    "snn_of_neighbours": sql(f"SELECT i, j, {_r6('w')} FROM snn_all JOIN knn USING (i, j)"),
    "snn_distance": sql(f"SELECT i, j, {_r6('w', 'd')} FROM snn LEFT JOIN knn USING (i, j)"),
    "hop2_cells": sql("SELECT i, j FROM hops", hops=_HOPS),
    "hop2_spots": sql("SELECT i, spot FROM hop_spots", hops=_HOPS, hop_spots=_HOP_SPOTS),
    "hop2_spot_cells": sql("SELECT DISTINCT i, cell AS j FROM hop_spots JOIN spot_of USING (spot)", hops=_HOPS, hop_spots=_HOP_SPOTS),
    "graph_symmetry": sql("""SELECT 'snn' AS graph, count(*) AS differing FROM snn a FULL JOIN (SELECT i AS j, j AS i, w AS v FROM snn) b USING (i, j) WHERE coalesce(w, 0) <> coalesce(v, 0)
UNION ALL SELECT 'knn', count(*) FROM (SELECT i, j, 1 AS w FROM knn) a FULL JOIN (SELECT i AS j, j AS i, 1 AS v FROM knn) b USING (i, j) WHERE coalesce(w, 0) <> coalesce(v, 0)"""),
    "degree_stats": sql("SELECT i, count(*) AS degree, round(sum(w), 6) + 0.0 AS strength FROM snn GROUP BY i"),
    "neighbour_lists": sql("SELECT i, string_agg(j, ',' ORDER BY j) AS neighbours FROM knn GROUP BY i"),
    "node_weights": sql(f"SELECT cell, {_r6('weight')} FROM weights"),
    "node_weights_balanced": sql(
        "SELECT cell, round(CASE WHEN u > l THEN 1 / (1 + exp(-5 * (2 * (entropy_img - l) / (u - l) - 1))) ELSE entropy_img END, 6) + 0.0 AS balance FROM features JOIN q USING (sample_id)",
        q="SELECT sample_id, quantile_cont(entropy_img, 0.15) AS l, quantile_cont(entropy_img, 0.85) AS u FROM features GROUP BY 1",
    ),
    "preferential_flow": sql(f"SELECT dst, src, {_r6('w', 'flow')} FROM flows"),
    "transition_matrix": sql(f"SELECT dst, src, {_r6('t')} FROM transition"),
    "transition_rowsum": sql("SELECT dst, round(sum(t), 6) + 0.0 AS total FROM transition GROUP BY 1"),
    "inflation_transition": sql(
        "SELECT a.dst, b.src, round(sum(a.t * b.t), 6) + 0.0 AS t FROM back a JOIN transition b ON a.src = b.dst GROUP BY 1, 2",
        back=parts.PARTS["transition"].replace(str(SHARE), str(-SHARE)),
    ),
    "diffuse_1step": sql(f"SELECT cell, gene, {_r6('value')} FROM step", step=_STEP.format("genes")),
    "quantile_align": sql("SELECT cell, gene, round(value, 4) + 0.0 AS value FROM d1", **_THREE),
    "diffuse_stabilized_3": sql("SELECT cell, gene, round(value, 4) + 0.0 AS value FROM d3", **_THREE),
    "rescale_mean": sql(
        """SELECT s.cell, s.gene, round(s.value - 0.8 * (avg(s.value) OVER (PARTITION BY spot, s.gene) - g.value), 6) + 0.0 AS value
FROM step s JOIN genes g ON g.cell = s.cell AND g.gene = s.gene JOIN spot_of p ON p.cell = s.cell""",
        step=_STEP.format("genes"),
    ),
    "neighbor_mean_std": sql(
        """SELECT cell, gene, round(s / w, 9) + 0.0 AS mean, round(sqrt(greatest(q / w - (s / w) ** 2, 0)), 5) + 0.0 AS std FROM sums""",
        sums="SELECT i AS cell, gene, sum(w) AS w, sum(w * value) AS s, sum(w * value ** 2) AS q FROM snn JOIN genes ON genes.cell = j GROUP BY 1, 2",
    ),
    "knn_smooth": sql(
        _SMOOTH.format("near", 6),
        near="""SELECT i, j FROM (SELECT a.cell AS i, b.cell AS j, row_number() OVER (PARTITION BY a.cell ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.cell) AS r
FROM features a JOIN features b ON a.sample_id = b.sample_id AND a.cell <> b.cell) WHERE r <= 20""",
    ),
    "radius_smooth": sql(_SMOOTH.format("near", 9), near=_RADIUS.format(600.0)),
}

#: What queries need of a cell, where it isn't everything.
_NEEDS: dict[str, tuple[str, ...]] = {"degree_stats": (*parts.PLACE, *parts.MORPH,), "graph_symmetry": (*parts.PLACE, *parts.MORPH,), "hop2_cells": (*parts.PLACE, *parts.MORPH,), "hop2_spot_cells": (*parts.PLACE, *parts.MORPH,), "hop2_spots": (*parts.PLACE, *parts.MORPH,), "inflation_transition": (*parts.PLACE, *parts.MORPH,), "knn_constrained": (*parts.PLACE, *parts.MORPH,), "knn_edges": (*parts.PLACE, *parts.MORPH,), "knn_smooth": (*parts.PLACE, *parts.GENES,), "neighbour_lists": (*parts.PLACE, *parts.MORPH,), "node_weights": (*parts.PLACE, *parts.MORPH,), "node_weights_balanced": ("entropy_img",), "preferential_flow": (*parts.PLACE, *parts.MORPH,), "radius_edges": (*parts.PLACE,), "radius_smooth": (*parts.PLACE, *parts.GENES,), "snn_distance": (*parts.PLACE, *parts.MORPH,), "snn_edges": (*parts.PLACE, *parts.MORPH,), "snn_of_neighbours": (*parts.PLACE, *parts.MORPH,), "snn_thresholded": (*parts.PLACE, *parts.MORPH,), "transition_matrix": (*parts.PLACE, *parts.MORPH,), "transition_rowsum": (*parts.PLACE, *parts.MORPH,)}
SQL = parts.needing(SQL, {k: v for k, v in _NEEDS.items() if k in SQL})
