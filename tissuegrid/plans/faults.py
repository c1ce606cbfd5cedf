"""Queries p3 over the raw prediction lines, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuegrid.common import shared_folder, table
from tissuegrid.sources.delimited import PREDICTION, faults, judge, reason_counts, valid_rows
from tissuegrid.sources.records import read_records


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "cna_predictions_raw"), "raw_line", PREDICTION)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines at fault with the first reason that holds."""
    return faults(_judged(spark, folder)).select("line_id", "reason")


def p3_valid(spark: SparkSession, folder: str) -> DataFrame:
    """The valid lines as typed records."""
    return valid_rows(_judged(spark, folder), PREDICTION, "line_id", "split_file")


def p3_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by file and reason."""
    return reason_counts(_judged(spark, folder), ["split_file"])


def p3_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The lines written to text files and loaded again, records put together across line feeds: valid typed rows and faults by reason, counted by type.

    A file doesn't tell where a broken record was meant to end: one with an open quote and a line feed would come out as two faults. These tables have none.
    """
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    table(spark, folder, "cna_predictions_raw").select(F.coalesce("raw_line", F.lit("")).alias("raw_line")).write.text(path)
    judged = judge(read_records(spark, path), "raw_line", PREDICTION)
    known = F.when(F.col("reason").isNull(), F.lower(F.col("values.cell_type")))
    return judged.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason"), known.alias("cell_type")).agg(F.count("*").alias("records"))


QUERIES = {f.__name__: f for f in (p3_found, p3_valid, p3_reasons, p3_loaded)}

_FIELD = r'("(?:[^"]|"")*"|[^"\t][^\t]*|)'
_PARSED = rf"""lines AS (SELECT line_id, split_file, regexp_replace(coalesce(raw_line, ''), '\r\z', '') AS line FROM cna_predictions_raw),
split AS (SELECT *, regexp_full_match(line, '(?:{_FIELD})(?:\t{_FIELD})*') AS quoted,
  list_transform(regexp_extract_all(chr(9) || line, '\t{_FIELD}', 1),
    lambda f: CASE WHEN f[1] = '"' THEN replace(f[2:-2], '""', '"') ELSE f END) AS f FROM lines),
judged AS (SELECT line_id, split_file, f, CASE WHEN NOT quoted THEN 'quoting' WHEN len(f) <> 4 THEN 'columns'
  WHEN NOT regexp_full_match(trim(f[1]), '[ACGT]{{16}}[-.][0-9]+([-.][0-9]+)?') THEN 'cell_id'
  WHEN lower(trim(f[2])) NOT IN ('aneuploid', 'diploid', 'not.defined') THEN 'cell_type'
  WHEN trim(f[3]) <> '' AND NOT (regexp_full_match(trim(f[3]), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
    AND coalesce(TRY_CAST(trim(f[3]) AS DOUBLE) BETWEEN 0 AND 1, false)) THEN 'score' END AS reason FROM split)"""

SQL = {
    "p3_found": f"WITH {_PARSED} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p3_valid": f"""WITH {_PARSED} SELECT line_id, split_file, trim(f[1]) AS cell_id, lower(trim(f[2])) AS cell_type,
TRY_CAST(nullif(trim(f[3]), '') AS DOUBLE) AS score, f[4] AS note FROM judged WHERE reason IS NULL""",
    "p3_loaded": f"WITH {_PARSED} SELECT coalesce(reason, 'valid') AS reason, CASE WHEN reason IS NULL THEN lower(trim(f[2])) END AS cell_type, count(*) AS records FROM judged GROUP BY ALL",
    "p3_reasons": f"WITH {_PARSED} SELECT split_file, coalesce(reason, 'valid') AS reason, count(*) AS lines FROM judged GROUP BY ALL",
}
