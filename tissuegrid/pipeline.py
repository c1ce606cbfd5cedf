"""Cell-level inference end to end: cells and spots to a cell graph, its transition table, and diffused expression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuegrid.common import stage
from tissuegrid.operators import analysis, diffusion, graph, labels, matrix, spatial
from tissuegrid.operators.nearest import nearest
from tissuegrid.params import Params

#: Feature columns beyond which the features are reduced, and the number of components kept.
MANY, KEPT = 20, 15


@dataclass
class Inference:
    """cells: (cell, x, y, block..., features...); spots: (spot, x, y, block...); expression: (spot, gene, value).

    block: columns within which cells are neighbours (a sample). reach: the largest distance of a cell from its spot. Where a layer is set in the parameters,
    `expression` has a column `layer`. edges: (i, j, w), a given graph of the cells in place of the one made here; table: (dst, src, t), a given transition
    table, which is needed where the parameters say not to initialise. Parameters that name parts of a container are an error if they are changed.
    """

    cells: DataFrame
    spots: DataFrame
    expression: DataFrame
    features: list[str]
    reach: float
    block: list[str] = field(default_factory=list)
    params: Params = Params()
    edges: DataFrame | None = None
    table: DataFrame | None = None

    def __post_init__(self):
        g, r, usual = self.params.graph, self.params.run, Params()
        if r.layer is not None:
            if "layer" not in self.expression.columns:
                raise ValueError("a layer is set, but the expression has no column for it")
            self.expression = self.expression.filter(F.col("layer") == r.layer).drop("layer")
        elif "layer" in self.expression.columns:
            raise ValueError("the expression has layers, but none is set")
        if g.conn_csr_matrix not in (None, "force"):
            raise ValueError("give a graph as `edges`")
        if not r.initialize and self.table is None:
            raise ValueError("without initialising, a transition table must be given as `table`")
        for part, names in ((g, ("conn_key", "node_features_obs_list", "reduced_dimension_transcriptome_obsm_key")), (r, ("conn_key", "out_prefix"))):
            base = usual.graph if part is g else usual.run
            changed = [k for k in names if getattr(part, k) != getattr(base, k)]
            if changed:
                raise ValueError(f"tables have no such names: {', '.join(changed)}")

    def prepare(self) -> DataFrame:
        """Cells with their nearest spot and its heterogeneity; cells out of reach drop out."""
        near = spatial.nearest_spot(self.cells, self.spots, self.reach, self.block).select("cell", "spot")
        placed = stage(self.cells.join(near, "cell"))
        return stage(labels.shared_back(placed, labels.variation(placed, ["spot"], self.features), ["spot"]))

    def input(self, placed: DataFrame) -> DataFrame:
        """Every cell with its spot's expression; zeros are absent."""
        return stage(labels.to_cells(self.expression, placed.select("cell", "spot")))

    def space(self, placed: DataFrame, transcriptome: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
        """Columns whose distances make the graph: position, features and, if given, components (cell, pc1, ...), each block of columns over the root of its number."""
        g = self.params.graph
        wanted = list(g.obs_keys or self.features)
        rows = matrix.standardize(placed.select("cell", "x", "y", *self.block, *wanted), ["x", "y", *wanted], self.block)
        if len(wanted) > MANY:
            scores = matrix.component_scores(rows, "cell", wanted, KEPT)
            rows = rows.drop(*wanted).join(scores, "cell")
            wanted = [f"pc{k + 1}" for k in range(KEPT)]
            rows = matrix.standardize(rows, wanted, self.block)
        weights = {c: F.col(c) * g.geom_morph_ratio / 2**0.5 for c in "xy"} | {c: F.col(c) / len(wanted) ** 0.5 for c in wanted}
        names = ["x", "y", *wanted]
        rows = rows.withColumns(weights)
        if transcriptome is not None:
            parts = [c for c in transcriptome.columns if c != "cell"]
            scaled = matrix.standardize(transcriptome, parts)
            factor = g.adjust_cell_network_by_transcriptome_scale * 100 / len(parts) ** 0.5
            rows = rows.join(scaled.select("cell", *(((F.col(c) * factor).alias(f"t_{c}")) for c in parts)), "cell")
            names += [f"t_{c}" for c in parts]
        return stage(rows), names

    def knn(self, placed: DataFrame, transcriptome: DataFrame | None = None) -> DataFrame:
        g = self.params.graph
        rows, names = self.space(placed, transcriptome)
        if g.geom_constraint > 0:
            raw = rows.drop("x", "y").join(placed.select("cell", "x", "y"), "cell").join(rows.select("cell", F.col("x").alias("_x"), F.col("y").alias("_y")), "cell")
            return stage(spatial.constrained_knn(raw, ["_x", "_y", *names[2:]], g.n_neighbors, g.geom_constraint, self.block))
        found = nearest(rows, "cell", names, g.n_neighbors, self.block)
        return stage(found.select(F.col("query").alias("i"), F.col("neighbour").alias("j"), F.col("distance").alias("d")))

    def transition(self, placed: DataFrame, knn: DataFrame) -> DataFrame:
        g = self.params.graph
        edges = self.edges if self.edges is not None and g.conn_csr_matrix != "force" else graph.shared_neighbours(knn, g.n_neighbors)
        edges = stage(graph.thresholded(edges, g.snn_threshold))
        weights = graph.node_weights(placed.select("cell", *self.block, "heterogeneity"), "heterogeneity", self.block)
        if g.balance_cell_quality:
            balance = graph.balanced(placed.select("cell", *self.block, "heterogeneity"), "heterogeneity", self.block, *g.bcq_IQR).select("cell", "balance")
            weights = weights.join(balance, "cell").withColumn("weight", F.col("weight") * F.col("balance"))
        weights = stage(weights.select("cell", "weight"))
        how = {"preferential": g.preferential_flow, "weigh": g.weigh_cells}
        if g.inflation_percentage is not None:
            return stage(graph.inflated(edges, weights, g.smoothing_scale, g.inflation_percentage, **how))
        return stage(graph.transition(edges, weights, g.smoothing_scale, **how))

    def burn_in(self, placed: DataFrame, entries: DataFrame) -> DataFrame:
        """Components of the variable genes after a short diffusion over the graph of position and features: (cell, pc1, ...)."""
        p = self.params
        scores = analysis.dispersions(entries.filter("value <> 0"), placed.count())
        few = stage(entries.join(analysis.variable(scores), "gene"))
        done = diffusion.diffuse(few, self.transition(placed, self.knn(placed)), p.run.burn_in_steps, near=self.near(placed))[p.run.burn_in_steps]
        kept = min(p.graph.reduced_dimension_transcriptome_obsm_dims, few.select("gene").distinct().count())
        return stage(matrix.entry_components(done, "cell", kept))

    def near(self, placed: DataFrame) -> DataFrame:
        """Keys by which cells of one block that lie together come together."""
        square = lambda c: F.floor(F.col(c) / self.reach)
        return placed.select("cell", *(F.col(b).alias(f"_b{k}") for k, b in enumerate(self.block)), square("x").alias("_x"), square("y").alias("_y"))

    def predict(self, genes: list | None = None) -> dict[int, DataFrame]:
        """Diffused expression (cell, gene, value) by iteration written; `genes` restricts the genes that are followed."""
        p = self.params
        placed = self.prepare()
        entries = self.input(placed)
        kept = entries if genes is None else stage(entries.filter(F.col("gene").isin(genes)))
        theta = p.graph.adjust_cell_network_by_transcriptome_scale
        components = self.burn_in(placed, entries) if theta > 0 else None
        knn = self.knn(placed, components)
        table = self.transition(placed, knn) if p.run.initialize else self.table
        frames = diffusion.frames_to_write(p.run.n_iter, 1 if p.run.save_chain else p.run.write_freq) or [p.run.n_iter]
        spot_of = placed.select("cell", "spot")
        out = diffusion.diffuse(kept, table, p.run.n_iter, frames, spot_of=spot_of if p.run.regulate_expression_mean else None, near=self.near(placed))
        level, steps = p.run.stochastic_expression_neighbors_level, p.run.smooth_predicted_expression_steps
        if steps > 0 and level in ("spot", "cell"):
            edges = graph.hop_spot_cells(knn, spot_of) if level == "spot" else graph.two_hops(knn)
            edges = stage(edges.withColumn("w", F.lit(1.0)))
            out = {k: diffusion.sample(v, edges, k, p.run.sample_predicted_expression_fluctuation_scale, steps) for k, v in out.items()}
        cast = "int" if p.run.is_rawCount else "float"
        return {k: v.withColumn("value", F.col("value").cast(cast)) for k, v in out.items()}
