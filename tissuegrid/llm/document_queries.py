"""Queries p7, p8 and p9 over documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuegrid.common import table
from tissuegrid.llm import leakage, packing, splitting
from tissuegrid.llm.tokens import count_tokens, spread

CAPACITY, LIMIT, OVERLAP, WORDS = 2048, 512, 64, 12


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    posts = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return packing.pack(posts.select("doc_id", count_tokens(F.col("text")).alias("n_tokens")), "doc_id", "n_tokens", CAPACITY)


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every post in a container of 2,048 tokens; longer posts in pieces of that size and a rest."""
    return _packed(spark, folder)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers by the tokens they hold."""
    return packing.fill(_packed(spark, folder), CAPACITY)


def p8_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 12 words or more that posts share with questions and answers of test items, with their place in the post."""
    return leakage.passages(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", ["question", "answer"], WORDS)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Posts and the test items they hold a passage of."""
    return p8_passages(spark, folder).select("doc_id", "item_id").distinct()


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Posts of more than 512 tokens in pieces under that limit, neighbours sharing up to 64 tokens."""
    return splitting.split(table(spark, folder, "documents"), "doc_id", "text", LIMIT, OVERLAP)


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Posts and the test items they hold a passage of, with the share of the question's or answer's words that the post holds."""
    return leakage.leaked(p8_passages(spark, folder), "doc_id", "item_id").withColumn("share", F.round("share", 6))


QUERIES = {f.__name__: f for f in (p7_containers, p7_fill, p8_passages, p8_found, p8_shares, p9_pieces)}

_WINDOWS = """{name} AS (SELECT DISTINCT {key}, array_to_string(w[i:i + 11], ' ') AS passage FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i
  FROM (SELECT {key}, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM {source}) WHERE len(w) >= 12))"""
_FIELDS = "(SELECT item_id, 'question' AS field, question AS t FROM eval_items UNION ALL SELECT item_id, 'answer', answer FROM eval_items)"
_ITEMS = "(SELECT item_id, question AS t FROM eval_items UNION ALL SELECT item_id, answer FROM eval_items)"

SQL = {
    "p8_found": f"""WITH {_WINDOWS.format(name="posts", key="doc_id", source="(SELECT doc_id, text AS t FROM documents)")},
{_WINDOWS.format(name="items", key="item_id", source=_ITEMS)}
SELECT DISTINCT doc_id, item_id FROM posts JOIN items USING (passage)""",
    # Each word of a field counts once that lies in a window of 12 words which the post holds too.
    "p8_shares": f"""WITH {_WINDOWS.format(name="posts", key="doc_id", source="(SELECT doc_id, text AS t FROM documents)")},
fields AS (SELECT DISTINCT item_id, field, w, len(w) AS total FROM (SELECT item_id, field, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM {_FIELDS}) WHERE len(w) >= 12),
windows AS (SELECT item_id, field, total, i, array_to_string(w[i:i + 11], ' ') AS passage FROM (SELECT *, unnest(range(1, total - 10)) AS i FROM fields)),
covered AS (SELECT DISTINCT doc_id, item_id, field, total, unnest(range(i, i + 12)) AS place FROM windows JOIN posts USING (passage)),
shares AS (SELECT doc_id, item_id, count(*) / any_value(total) AS share FROM covered GROUP BY doc_id, item_id, field)
SELECT doc_id, item_id, round(max(share), 6) AS share, max(share) >= 1 AS whole FROM shares GROUP BY 1, 2""",
}
