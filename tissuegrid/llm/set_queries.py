"""Queries p1 over gene sets and marker sets, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuegrid.common import table
from tissuegrid.llm.setsim import SimilarSets, similar_sets

THRESHOLD = 0.6


def _similar(spark: SparkSession, folder: str) -> SimilarSets:
    """Symbols without spaces around them and in upper case; null and blank ones don't count."""
    columns = ["geneset", F.nullif(F.upper(F.trim("genesymbol")), F.lit("")).alias("symbol")]
    members = table(spark, folder, "gene_sets").select(*columns).unionByName(table(spark, folder, "marker_sets").select(*columns))
    return similar_sets(members, "geneset", "symbol", THRESHOLD)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of set names whose members overlap by 0.6 or more."""
    return _similar(spark, folder).expanded().select("set_a", "set_b")


def p1_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every set with its number of members, of equal sets and of similar sets."""
    return _similar(spark, folder).links().select("name", "size", "copies", "links")


QUERIES = {f.__name__: f for f in (p1_found, p1_links)}

_PAIRS = f"""members AS (SELECT DISTINCT geneset, upper(trim(genesymbol)) AS symbol FROM (SELECT geneset, genesymbol FROM gene_sets
  UNION ALL SELECT geneset, genesymbol FROM marker_sets) WHERE geneset IS NOT NULL AND trim(genesymbol) <> ''),
sizes AS (SELECT geneset, count(*) AS n FROM members GROUP BY geneset),
common AS (SELECT a.geneset AS set_a, b.geneset AS set_b, count(*) AS c FROM members a JOIN members b USING (symbol) WHERE a.geneset < b.geneset GROUP BY 1, 2),
pairs AS (SELECT set_a, set_b, c, x.n AS size_a, y.n AS size_b FROM common JOIN sizes x ON x.geneset = set_a JOIN sizes y ON y.geneset = set_b
  WHERE c / (x.n + y.n - c)::DOUBLE >= {THRESHOLD})"""

SQL = {
    "p1_found": f"WITH {_PAIRS} SELECT set_a, set_b FROM pairs",
    "p1_links": f"""WITH {_PAIRS}, ends AS (SELECT set_a AS name, c = size_a AND c = size_b AS equal FROM pairs UNION ALL SELECT set_b, c = size_a AND c = size_b FROM pairs)
SELECT geneset AS name, n AS size, 1 + count(*) FILTER (WHERE equal) AS copies, count(name) AS links FROM sizes LEFT JOIN ends ON name = geneset GROUP BY 1, 2""",
}
