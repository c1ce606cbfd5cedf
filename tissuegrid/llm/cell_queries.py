"""Queries p2 and p4 over the table of cells, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuegrid.common import clean_label, rounded, stage, table, usable
from tissuegrid.llm import quantiles, topn

MIN_CELLS, SPREAD = 40, 8.0
PARTS = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def measured(cells: DataFrame, *extra: str) -> DataFrame:
    """Each cell once with its label and valid count; repeated rows differ at most in times and in the spelling of the label."""
    rows = cells.select("cell_id", clean_label("clusters").alias("clusters"), "umi", *extra)
    return rows.filter(usable("umi") & (F.col("umi") >= 0)).distinct()


def _told(percentiles: DataFrame) -> DataFrame:
    return percentiles.select("clusters", "n", *(rounded(c, 4).alias(c) for c in percentiles.columns[2:]))


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Cells, quartiles, 90th, 95th and 99th percentile of the counts of every label; the null label is a group too."""
    sk = quantiles.sketch(measured(table(spark, folder, "cells")), ["clusters"], "umi")
    return _told(quantiles.percentiles(sk, ["clusters"], PARTS))


def p2_by_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The mergeable sketch: counts by sample, label and bucket."""
    return quantiles.sketch(measured(table(spark, folder, "cells"), "sample_id"), ["sample_id", "clusters"], "umi")


def p2_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of every label put together from the sketches of single samples."""
    sk = quantiles.merge([p2_by_sample(spark, folder)], ["clusters"])
    return _told(quantiles.percentiles(sk, ["clusters"], [0.5, 0.95]))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of at least 40 cells whose 95th percentile is at least 8 times the median.

    The sketch decides every label whose ratio is farther from 8 than its error; the others are counted exactly.
    """
    a = quantiles.ALPHA
    rows = measured(table(spark, folder, "cells")).filter("clusters is not null")
    sk = stage(quantiles.sketch(rows, ["clusters"], "umi"))
    of = quantiles.percentiles(sk, ["clusters"], [0.5, 0.95]).filter(F.col("n") >= MIN_CELLS)
    least, most = F.col("p95") / (1 + a) >= SPREAD * F.col("p50") / (1 - a), F.col("p95") / (1 - a) >= SPREAD * F.col("p50") / (1 + a)
    judged = stage(of.select("clusters", least.alias("sure"), most.alias("open")).filter("open"))
    sure, unsure = judged.filter("sure").select("clusters"), judged.filter("not sure").select("clusters")
    if unsure.isEmpty():
        return sure
    exact = quantiles.exact_percentiles(rows.join(unsure, "clusters", "left_semi"), sk.join(unsure, "clusters", "left_semi"), "clusters", "umi", [0.5, 0.95])
    return sure.unionByName(exact.filter(F.col("p95") >= SPREAD * F.col("p50")).select("clusters"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The 3 cells of highest count of every label."""
    rows = measured(table(spark, folder, "cells"))
    return topn.top_n(rows, "clusters", "cell_id", "umi", 3).select("clusters", "cell_id")


def p4_top20(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 cells of highest count of every label, numbered."""
    rows = measured(table(spark, folder, "cells"))
    return topn.ranked(topn.top_n(rows, "clusters", "cell_id", "umi", 20), "clusters", "cell_id", "umi")


QUERIES = {f.__name__: f for f in (p2_percentiles, p2_by_sample, p2_merged, p2_found, p4_found, p4_top20)}

_MEASURED = """measured AS (SELECT DISTINCT cell_id, nullif(trim(clusters), '') AS clusters, umi FROM cells
WHERE umi IS NOT NULL AND NOT isnan(umi) AND umi >= 0)"""
_TOP = """WITH {0}, numbered AS (SELECT clusters, cell_id, umi, row_number() OVER (PARTITION BY clusters ORDER BY umi DESC, cell_id) AS rank
FROM measured WHERE clusters IS NOT NULL) SELECT {1} FROM numbered WHERE rank <= {2}"""

_RATIO = "((1 + 0.01::DOUBLE) / (1 - 0.01::DOUBLE))"
_BUCKETS = f"""buckets AS (SELECT {{0}}clusters, CAST(sign(umi) AS INTEGER) AS sign, CAST(CASE WHEN umi = 0 THEN 0 ELSE ceil(ln(umi) / ln({_RATIO})) END AS INTEGER) AS bucket, count(*) AS n
FROM (SELECT DISTINCT cell_id, {{0}}nullif(trim(clusters), '') AS clusters, umi FROM cells WHERE umi IS NOT NULL AND NOT isnan(umi) AND umi >= 0) GROUP BY ALL)"""


def _percentiles(parts: list[float]) -> str:
    columns = []
    for p in parts:
        at = f"({p}::DOUBLE * (total - 1))"
        pick = lambda k: f"max(CASE WHEN upto > {k} AND upto - n <= {k} THEN centre END)"  # noqa: B023, E731
        lo, hi = pick(f"floor{at}"), pick(f"ceil{at}")
        columns.append(f"round({lo} + ({hi} - {lo}) * ({at.replace('total', 'any_value(total)')} - floor{at.replace('total', 'any_value(total)')}), 4) + 0.0 AS p{p * 100:g}")
    return f"""WITH {_BUCKETS.format('')}, placed AS (SELECT clusters, n, sum(n) OVER (PARTITION BY clusters ORDER BY sign, bucket) AS upto, sum(n) OVER (PARTITION BY clusters) AS total,
CASE WHEN sign = 0 THEN 0 ELSE 2 * {_RATIO} ** bucket / ({_RATIO} + 1) END AS centre FROM buckets) SELECT clusters, CAST(any_value(total) AS BIGINT) AS n, {', '.join(columns)} FROM placed GROUP BY clusters"""


SQL = {
    "p2_percentiles": _percentiles(PARTS),
    "p2_by_sample": f"WITH {_BUCKETS.format('sample_id, ')} SELECT sample_id, clusters, sign, bucket, n FROM buckets",
    "p2_merged": _percentiles([0.5, 0.95]),
    "p2_found": f"""WITH {_MEASURED} SELECT clusters FROM measured WHERE clusters IS NOT NULL GROUP BY clusters
HAVING count(*) >= {MIN_CELLS} AND quantile_cont(umi, 0.95) >= {SPREAD} * quantile_cont(umi, 0.5)""",
    "p4_found": _TOP.format(_MEASURED, "clusters, cell_id", 3),
    "p4_top20": _TOP.format(_MEASURED, "clusters, cell_id, umi, CAST(rank AS INTEGER) AS rank", 20),
}
