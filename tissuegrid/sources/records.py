"""Records of delimited files whose quoted fields may hold line feeds, put together from lines that many tasks read.

A line takes a state (is a quoted field open?) to the next one. Such steps can be combined in any grouping, so each split of a file is summed up by itself, and only the sums
go through the file in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tissuegrid.common import discard, stage
from tissuegrid.sources.delimited import fields_of

#: Whole fields with their separators, then a quoted field that doesn't end.
_OPEN = r'\A(?:(?:"[^"]*+(?:""[^"]*+)*+"[^\t]*+|[^"\t][^\t]*+|)\t)*+"[^"]*+(?:""[^"]*+)*+\z'
_KEY = ["file", "split", "line"]


def _left_open(line: Column) -> Column:
    return F.contains(line, F.lit('"')) & line.rlike(_OPEN)


def _combined(steps: DataFrame, by: list[str], order: str) -> DataFrame:
    """`steps` with `closed_to`, `open_to`: the state behind each row if none, or one, is open before the group. Columns `a`, `b` tell it of the row alone."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    turned = steps.withColumn("_x", F.sum((F.col("a") & ~F.col("b")).cast("int")).over(upto))
    # The last row that leads to one state from both; since then only turns matter.
    fixed = turned.withColumn("_r", F.last(F.when(F.col("a") == F.col("b"), F.struct("a", "_x")), True).over(upto))
    state = lambda first: ((F.coalesce(F.col("_r.a"), F.lit(first)).cast("int") + F.col("_x") - F.coalesce(F.col("_r._x"), F.lit(0))) % 2) == 1
    return fixed.withColumns({"closed_to": state(False), "open_to": state(True)}).drop("_x", "_r")


def _framed(steps: DataFrame) -> DataFrame:
    """(file, split, line, inside, open, start): is a field open before the line, and behind it; the place (split, line) where its record starts."""
    known = stage(_combined(steps, ["file", "split"], "line"))
    in_split = Window.partitionBy("file", "split").orderBy("line")
    in_file = Window.partitionBy("file").orderBy("split")  # one row a split
    splits = known.groupBy("file", "split").agg(F.max_by(F.struct("closed_to", "open_to"), "line").alias("e")).select("file", "split", F.col("e.closed_to").alias("a"), F.col("e.open_to").alias("b"))
    begun = _combined(splits, ["file"], "split").withColumn("begun", F.coalesce(F.lag("closed_to").over(in_file), F.lit(False))).select("file", "split", "begun")
    behind = known.join(begun, ["file", "split"]).withColumn("open", F.when(F.col("begun"), F.col("open_to")).otherwise(F.col("closed_to")))
    inside = behind.withColumn("inside", F.coalesce(F.lag("open").over(in_split), F.col("begun")))
    upto = in_split.rowsBetween(Window.unboundedPreceding, 0)
    here = stage(inside.select(*_KEY, "inside", "open", F.last(F.when(~F.col("inside"), F.struct("split", "line")), True).over(upto).alias("own")))
    last = here.groupBy("file", "split").agg(F.max("own").alias("own"))
    earlier = last.select("file", "split", F.last("own", True).over(in_file.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    return here.join(earlier, ["file", "split"]).select(*_KEY, "inside", "open", F.coalesce("own", "earlier").alias("start"))


def read_records(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """(file, split, line, raw_line) of tab-separated files, one row a record, in the order of split and line within a file; lines end with line feeds.

    A record ends with the first line behind which no quoted field is open. Where a record put together that way is badly quoted, never ends, or has more than `most`
    lines, its first line is a record by itself, and the next one begins behind it: a quote that never ends costs one line, not the file. No line is lost,
    and a file without lines has no rows. Only lines of records of several lines are shuffled with their text.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("raw_line"))
    lines = stage(lines)
    steps = stage(lines.select(*_KEY, _left_open(F.col("raw_line")).alias("a"), _left_open(F.concat(F.lit('"'), "raw_line")).alias("b")))
    while True:
        several = stage(_framed(steps).filter(F.col("inside") | F.col("open")).select(*_KEY, "start"))
        sizes = several.groupBy("file", "start").agg(F.count("*").alias("n"))
        short = several.join(sizes.filter(F.col("n") <= most), ["file", "start"]).join(lines, _KEY)
        together = short.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("split", "line", "raw_line"))).alias("l"))  # at most `most`
        records = stage(together.select("file", "start", F.array_join(F.transform("l", lambda r: r["raw_line"]), "\n").alias("raw_line")).withColumn("bad", fields_of(F.col("raw_line"))["bad"]))
        bad = stage(records.filter("bad").select("file", "start").unionByName(sizes.filter(F.col("n") > most).select("file", "start")))
        if bad.isEmpty():
            break
        # What a line opens if a record starts there doesn't depend on the lines before it, so it can be settled for all of them at once.
        alone = bad.select("file", F.col("start.split").alias("split"), F.col("start.line").alias("line"), F.lit(True).alias("alone"))
        renewed = stage(steps.join(alone, _KEY, "left").select(*_KEY, (F.col("a") & F.col("alone").isNull()).alias("a"), "b"))
        discard(steps, several, records, bad)
        steps = renewed
    single = lines.join(several, _KEY, "left_anti")
    return single.unionByName(records.select("file", "start.split", "start.line", "raw_line"))
