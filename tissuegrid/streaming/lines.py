"""Raw lines and events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tissuegrid.sources.delimited import Field, faults, judge, valid_rows


def separate_lines(lines: DataFrame, raw: str, fields: list[Field], keep: list[str], valid_path: str, fault_path: str, checkpoint: str) -> StreamingQuery:
    """Write the valid rows of a stream of lines to one table and the others, with their reasons, to another; each batch once, under its number."""

    def write(batch: DataFrame, number: int) -> None:
        judged = judge(batch, raw, fields).persist()
        valid_rows(judged, fields, *keep).write.mode("overwrite").parquet(f"{valid_path}/batch={number}")
        faults(judged).write.mode("overwrite").parquet(f"{fault_path}/batch={number}")
        judged.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, at: str, by: list[str], value: str, length: str, late: str) -> DataFrame:
    """Count, sum and largest value by window of event time; events later than `late` behind the newest don't count any more."""
    grouped = events.withWatermark(at, late).groupBy(F.window(at, length), *by)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("most")).select(F.col("window.start").alias("start"), *by, "n", "total", "most")
