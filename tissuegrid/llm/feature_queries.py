"""Queries p6 over cell features, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuegrid.common import clean_label, rounded, table
from tissuegrid.llm import spectral
from tissuegrid.llm.neighbours import nearest

RADIUS = 3.0
NEIGHBOURS, REACH, ASKED = 5, 0.03, 100
COMPONENTS = ["hist_pc1", "hist_pc2", "hist_pc3", "expr_pc1", "expr_pc2", "expr_pc3"]


def _space(spark: SparkSession, folder: str) -> tuple[DataFrame, list[Column]]:
    cells = table(spark, folder, "cell_features").select("cell_id", *COMPONENTS, "mean_gray").filter("mean_gray >= 0")
    return cells, [*map(F.col, COMPONENTS), F.col("mean_gray") / 32]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of cells within 0.03 of which one is among the 5 nearest of the other."""
    cells, space = _space(spark, folder)
    near = nearest(cells, "cell_id", space, NEIGHBOURS, limit=REACH)
    return near.select(F.least("query", "neighbour").alias("cell_a"), F.greatest("query", "neighbour").alias("cell_b")).distinct()


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest of all cells to each cell whose id is divisible by 100."""
    cells, space = _space(spark, folder)
    near = nearest(cells, "cell_id", space, 10, queries=F.col("cell_id") % ASKED == 0)
    return near.select("query", "neighbour", F.round("distance", 6).alias("distance"), "rank")


def p5_all(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest of all cells to every cell, from all shards they may lie in."""
    cells, space = _space(spark, folder)
    near = nearest(cells, "cell_id", space, 10)
    return near.select("query", "neighbour", F.round("distance", 6).alias("distance"), "rank")


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    cells = table(spark, folder, "cell_features").select("cell_id", "sample_id", clean_label("clusters").alias("clusters"), "mean_gray", "entropy_img")
    cells = cells.filter((F.col("mean_gray") >= 0) & (F.col("entropy_img") >= 0))
    return spectral.clusters(cells, "cell_id", ["sample_id", "clusters"], {"gray": "mean_gray", "entropy": F.col("entropy_img") * 16}, spectral.Spectral(RADIUS))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Members of all groups of at least two cells."""
    found = _groups(spark, folder)
    alone = found.groupBy("group_id").agg(F.count("*").alias("n")).filter("n > 1").select("group_id")
    return found.join(alone, "group_id").select("group_id", "cell_id")


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every group with its size, mean and three most typical cells."""
    told = spectral.describe(_groups(spark, folder), "cell_id", ["sample_id", "clusters"], ["gray", "entropy"], RADIUS, 3, 10)
    members = F.array_join(F.transform("typical", lambda m: m.cast("string")), ",").alias("typical")
    return told.select("sample_id", "clusters", "group_id", "size", rounded("mean_gray", 9).alias("mean_gray"), rounded(F.col("mean_entropy") / 16, 9).alias("entropy_img"), members, rounded("affinity", 5).alias("affinity"))


QUERIES = {f.__name__: f for f in (p5_found, p5_neighbours, p5_all, p6_found, p6_groups)}

_SPACE = f"""cells AS (SELECT DISTINCT cell_id, {", ".join(f"{c} AS d{i}" for i, c in enumerate(COMPONENTS))}, mean_gray / 32 AS d6 FROM cell_features
  WHERE {" AND ".join(f"{c} BETWEEN -1e300 AND 1e300" for c in COMPONENTS)} AND mean_gray BETWEEN 0 AND 1e300)"""
_D2 = " + ".join(f"(a.d{i} - b.d{i}) ** 2" for i in range(7))
_NEAR = """{0}, near AS (SELECT a.cell_id AS query, b.cell_id AS neighbour, sqrt({1}) AS distance FROM cells a JOIN cells b ON a.cell_id <> b.cell_id {2}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM near)"""

_GROUPS = f"""cells AS (SELECT DISTINCT cell_id, sample_id, nullif(trim(clusters), '') AS clusters, mean_gray AS x, 16 * entropy_img AS y FROM cell_features
  WHERE NOT isnan(mean_gray) AND NOT isnan(entropy_img) AND mean_gray >= 0 AND entropy_img >= 0 AND sample_id IS NOT NULL),
near AS (SELECT a.cell_id, min(b.cell_id) AS group_id FROM cells a JOIN cells b USING (sample_id, clusters)
  WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {RADIUS**2} GROUP BY 1)"""

SQL = {
    "p5_found": f"""WITH {_NEAR.format(_SPACE, _D2, f"AND b.d0 BETWEEN a.d0 - {REACH} AND a.d0 + {REACH}")}
SELECT DISTINCT least(query, neighbour) AS cell_a, greatest(query, neighbour) AS cell_b FROM ranked WHERE rank <= {NEIGHBOURS} AND distance <= {REACH}""",
    "p5_neighbours": f"""WITH {_NEAR.format(_SPACE, _D2, f"WHERE a.cell_id % {ASKED} = 0")}
SELECT query, neighbour, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10""",
    "p6_found": f"WITH {_GROUPS} SELECT group_id, cell_id FROM near WHERE group_id IN (SELECT group_id FROM near GROUP BY 1 HAVING count(*) > 1)",
    # The affinity of a member by its pairs; the operator takes it from the group's moments.
    "p6_groups": f"""WITH {_GROUPS}, members AS (SELECT * FROM cells JOIN near USING (cell_id)),
scored AS (SELECT a.cell_id, a.sample_id, a.clusters, a.group_id, any_value(a.x) AS x, any_value(a.y) AS y, round(avg(1 - ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / {RADIUS**2}), 10) AS affinity
  FROM members a JOIN members b USING (group_id) GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY affinity DESC, cell_id) AS r FROM scored)
SELECT sample_id, clusters, group_id, count(*) AS size, round(avg(x), 9) + 0.0 AS mean_gray, round(avg(y) / 16, 9) + 0.0 AS entropy_img, string_agg(cell_id, ',' ORDER BY r) FILTER (r <= 3) AS typical,
round(max(affinity), 5) + 0.0 AS affinity FROM numbered GROUP BY 1, 2, 3""",
}
