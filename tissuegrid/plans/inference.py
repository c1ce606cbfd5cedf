"""The whole inference as a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuegrid.common import stage
from tissuegrid.operators import labels
from tissuegrid.params import Params
from tissuegrid.pipeline import Inference
from tissuegrid.plans import parts


def infer_expression(spark: SparkSession, folder: str) -> DataFrame:
    """Spot means of the components given back to cells and diffused over the cell graph for the default number of iterations."""
    cells = stage(parts.features(spark, folder))
    spots = parts.spots(cells)
    expression = stage(labels.to_spots(parts.genes(cells), parts.spots_of(cells)))
    rows = cells.select("cell", "x", "y", "sample_id", *parts.MORPH)
    params = Params()
    run = Inference(rows, spots, expression, parts.MORPH, parts.PITCH, ["sample_id"], params)
    return run.predict()[params.run.n_iter]


def infer_with_burn_in(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a graph that a burn-in over the variable genes adjusts, means kept, and values drawn from the neighbourhood; image features, scaled down, stand for expression."""
    cells = stage(parts.features(spark, folder, *parts.PLACE, *parts.MORPH))
    spots = parts.spots(cells)
    scaled = cells.select("cell", *((F.col(c) / 32).alias(c) for c in parts.MORPH)).unpivot("cell", parts.MORPH, "gene", "value")
    expression = stage(labels.to_spots(scaled, parts.spots_of(cells)))
    params = Params().changed(n_iter=10, adjust_cell_network_by_transcriptome_scale=0.5, smooth_predicted_expression_steps=2, regulate_expression_mean=True, stochastic_expression_neighbors_level="cell")
    run = Inference(cells.select("cell", "x", "y", "sample_id", *parts.MORPH), spots, expression, parts.MORPH, parts.PITCH, ["sample_id"], params)
    return run.predict()[10]


QUERIES = {"infer_expression": infer_expression, "infer_with_burn_in": infer_with_burn_in}
SQL: dict[str, str] = {}
