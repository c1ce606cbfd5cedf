"""The data the queries work on, as DataFrames and as SQL.

A cell counts once however often its row is repeated. Graphs, spots and ranges are made within samples. Genes are the expression components of the
feature table, or the parts of the order lines, whose quantities stand for counts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuegrid.common import clean_label, stage, table, usable
from tissuegrid.operators import graph, matrix, spatial

MORPH = ["mean_gray", "std_gray", "entropy_img", "mean_r", "mean_g", "mean_b"]
GENES = ["expr_pc1", "expr_pc2", "expr_pc3"]
#: For queries that need the label only.
NOTHING = "-"
PITCH, K, THRESHOLD, SHARE = 2000.0, 5, 0.1, 0.8


PLACE = ["x", "y"]
ALL = [*PLACE, *MORPH, *GENES]


def features(spark: SparkSession, folder: str, *need: str) -> DataFrame:
    """Cells with (cell, sample_id, clusters, the columns needed): those in which these are neither null nor NaN, and image features not negative; all columns by default.

    A cell that lacks something else stays.
    """
    need = need or tuple(ALL)
    rows = table(spark, folder, "cell_features").select(F.col("cell_id").alias("cell"), "sample_id", clean_label("clusters").alias("clusters"), *(c for c in need if c != NOTHING))
    for c in need:
        if c != NOTHING:
            rows = rows.filter(usable(c) & (F.col(c) >= 0) if c in MORPH else usable(c))
    return rows.filter("sample_id is not null").distinct()


def spots_of(cells: DataFrame) -> DataFrame:
    """(cell, spot): the grid square of a cell; squares stand for spots of the given pitch."""
    square = lambda c: F.floor(F.col(c) / PITCH).cast("string")
    return cells.select("cell", F.concat_ws(":", "sample_id", square("x"), square("y")).alias("spot"))


def spots(cells: DataFrame) -> DataFrame:
    """(spot, sample_id, x, y): the centres of the occupied squares."""
    middle = lambda c: ((F.floor(F.col(c) / PITCH) + 0.5) * PITCH).alias(c)
    return cells.select("sample_id", middle("x"), middle("y")).distinct().withColumn("spot", F.concat_ws(":", "sample_id", F.floor(F.col("x") / PITCH).cast("string"), F.floor(F.col("y") / PITCH).cast("string")))


def genes(cells: DataFrame) -> DataFrame:
    """(cell, gene, value) of the expression components."""
    return cells.select("cell", *GENES).unpivot("cell", GENES, "gene", "value")


def morphology_space(cells: DataFrame) -> DataFrame:
    """Standardised position over the root of 2 and features over the root of their number, within samples."""
    scaled = matrix.standardize(cells.select("cell", "sample_id", "x", "y", *MORPH), ["x", "y", *MORPH], ["sample_id"])
    weight = {c: F.col(c) / 2**0.5 for c in "xy"} | {c: F.col(c) / len(MORPH) ** 0.5 for c in MORPH}
    return scaled.withColumns(weight)


def knn(cells: DataFrame) -> DataFrame:
    return stage(spatial.knn_edges(morphology_space(cells), "cell", ["x", "y", *MORPH], K, ["sample_id"]))


def snn(edges: DataFrame) -> DataFrame:
    return stage(graph.thresholded(graph.shared_neighbours(edges, K), THRESHOLD))


def heterogeneity(cells: DataFrame) -> DataFrame:
    from tissuegrid.operators import labels

    placed = cells.join(spots_of(cells), "cell")
    return placed.join(labels.variation(placed, ["spot"], MORPH), "spot")


def weights(cells: DataFrame) -> DataFrame:
    return stage(graph.node_weights(heterogeneity(cells).select("cell", "sample_id", "heterogeneity"), "heterogeneity", ["sample_id"]).select("cell", "weight"))


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """(cell, gene, value): suppliers stand for cells, parts for genes, summed quantities for counts."""
    return table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("value"))


_Z = lambda c, n: f"CASE WHEN stddev_pop({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w ELSE 0 END / sqrt({n}) AS {c}"
_SPACE = [*((c, 2) for c in "xy"), *((c, len(MORPH)) for c in MORPH)]


def features_sql(*need: str) -> str:
    """`features` as SQL."""
    columns = [c for c in need or ALL if c != NOTHING]
    # As text, since a filter on NaN is dropped where the file's statistics, which leave NaN out, say that it always holds.
    known = [f"CAST({c} AS VARCHAR) <> 'nan'" + (f" AND {c} >= 0" if c in MORPH else "") for c in columns]
    return f"SELECT DISTINCT {', '.join(['cell_id AS cell', 'sample_id', "nullif(trim(clusters), '') AS clusters", *columns])} FROM cell_features WHERE {' AND '.join(['sample_id IS NOT NULL', *known])}"


#: Common table expressions, in the order in which they may refer to each other.
PARTS = {
    "features": features_sql(),
    "spot_of": f"SELECT cell, concat_ws(':', sample_id, CAST(floor(x / {PITCH}) AS BIGINT), CAST(floor(y / {PITCH}) AS BIGINT)) AS spot FROM features",
    "spots": f"""SELECT DISTINCT concat_ws(':', sample_id, CAST(floor(x / {PITCH}) AS BIGINT), CAST(floor(y / {PITCH}) AS BIGINT)) AS spot, sample_id,
(floor(x / {PITCH}) + 0.5) * {PITCH} AS x, (floor(y / {PITCH}) + 0.5) * {PITCH} AS y FROM features""",
    "genes": f"SELECT cell, gene, value FROM (UNPIVOT (SELECT cell, {', '.join(GENES)} FROM features) ON {', '.join(GENES)} INTO NAME gene VALUE value)",
    "space": f"SELECT cell, sample_id, {', '.join(_Z(c, n) for c, n in _SPACE)} FROM features WINDOW w AS (PARTITION BY sample_id)",
    "knn": f"""SELECT i, j, d FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM (
SELECT a.cell AS i, b.cell AS j, sqrt({" + ".join(f"(a.{c} - b.{c}) ** 2" for c, _ in _SPACE)}) AS d FROM space a JOIN space b ON a.sample_id = b.sample_id AND a.cell <> b.cell)) WHERE r <= {K}""",
    "snn_all": f"SELECT a.i, b.i AS j, count(*) / {K}::DOUBLE AS w FROM knn a JOIN knn b ON a.j = b.j AND a.i <> b.i GROUP BY 1, 2",
    "snn": f"SELECT * FROM snn_all WHERE w >= {THRESHOLD}",
    "spot_variation": f"""SELECT spot, list_avg([{", ".join(f"CASE WHEN avg({c}) <> 0 THEN stddev_pop({c}) / avg({c}) END" for c in MORPH)}]) AS heterogeneity
FROM features JOIN spot_of USING (cell) GROUP BY spot""",
    "heterogeneity": "SELECT cell, sample_id, heterogeneity FROM features JOIN spot_of USING (cell) JOIN spot_variation USING (spot)",
    "weights": """SELECT cell, exp(-CASE WHEN max(heterogeneity) OVER w > min(heterogeneity) OVER w THEN (heterogeneity - min(heterogeneity) OVER w)
/ (max(heterogeneity) OVER w - min(heterogeneity) OVER w) ELSE 0 END) AS weight FROM heterogeneity WINDOW w AS (PARTITION BY sample_id)""",
    "flows": """SELECT i AS dst, j AS src, w, 1 / (1 + exp(-5 * b.weight * (b.weight - a.weight))) AS flow FROM snn JOIN weights a ON a.cell = i JOIN weights b ON b.cell = j""",
    "transition": f"""SELECT dst, src, w * flow / sum(w * flow) OVER (PARTITION BY dst) * (1 - (1 - {SHARE}) * weight) AS t FROM flows JOIN weights ON cell = dst
UNION ALL SELECT cell, cell, (1 - {SHARE}) * weight FROM weights""",
    "counts": "SELECT l_suppkey AS cell, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2",
}


def needing(statements: dict[str, str], needs: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """The statements with the cells that have the columns a query needs, in place of those that have all."""
    whole = PARTS["features"]
    for name, need in needs.items():
        if whole not in statements[name]:
            raise ValueError(f"{name} reads no features")
    return {k: s.replace(whole, features_sql(*needs[k])) if k in needs else s for k, s in statements.items()}


def sql(select: str, **more: str) -> str:
    """A statement with the parts it needs as common table expressions; `more` are parts of its own."""
    known, needed = PARTS | more, {}

    def need(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"(?:\bFROM|\bJOIN|,)\s+{name}\b", text):
                need_of = known[name]
                needed[name] = need_of
                need(need_of)

    need(select)
    ordered = [f"{k} AS ({v})" for k, v in known.items() if k in needed]
    return (f"WITH {', '.join(ordered)} " if ordered else "") + select
