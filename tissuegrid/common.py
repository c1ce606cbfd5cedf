"""Reading tables, staging intermediate tables and small column helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session; they need it to run its Arrow functions wherever it is not installed."""
    context = spark.sparkContext
    if not getattr(context, "_tissuegrid_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "tissuegrid")  # the driver serves the file to the executors
        context.addPyFile(shutil.make_archive(archive, "zip", root, "tissuegrid"))
        context._tissuegrid_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`; a temporary one only in local mode where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        folder = getattr(context, "_tissuegrid_shared", None)
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = context._tissuegrid_shared = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return folder.rstrip("/")


def stage(df: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Write a table to the shared folder, in folders of the values of `by`, and read it back.

    This cuts the lineage, survives the loss of executors, and lets the planner see the true size of what follows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    spark.sparkContext.__dict__.setdefault("_tissuegrid_stages", []).append(path)
    df.write.partitionBy(*by).parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.__dict__["_tissuegrid_stage"] = path
    return staged


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*staged: DataFrame) -> None:
    """Delete tables that `stage` gave, once all that is made from them is written. Other frames are left alone."""
    for df in staged:
        path = df.__dict__.pop("_tissuegrid_stage", None)
        if path:
            known = df.sparkSession.sparkContext.__dict__.get("_tissuegrid_stages", [])
            if path in known:
                known.remove(path)
                _delete(df.sparkSession, path)


def clear_stages(spark: SparkSession) -> None:
    """Delete the tables that `stage` wrote in this session; results that are still to be computed from them become unreadable."""
    for path in spark.sparkContext.__dict__.pop("_tissuegrid_stages", []):
        _delete(spark, path)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def usable(c: Column | str) -> Column:
    """True where a double is neither null nor NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c)


def clean_label(c: Column | str) -> Column:
    """A label without the spaces around it; blank becomes null."""
    return F.nullif(F.trim(c), F.lit(""))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have yet (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def with_groups(df: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    """`df` with aggregates of each group beside its rows: partial sums before the shuffle, then a join, so that a hot group is no single task.

    Without `by` the aggregates are one row. Rows with a null in `by` are dropped.
    """
    if not by:
        return df.crossJoin(F.broadcast(df.agg(*aggregates)))
    return df.join(df.groupBy(*by).agg(*aggregates), by)


def ordinals(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """`df` with the 0-based place of each row within its group in ascending order of `order`, which must name rows uniquely.

    Rows are range-partitioned over all groups, counted by partition, and numbered within partitions: a group of any size is spread over many tasks.
    """
    part, before = fresh(df, "_part"), fresh(df, "_before")
    keys = [*by, *order]
    placed = stage(df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()))
    counts = placed.groupBy(*by, part).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*by, part, F.coalesce(upto, F.lit(0)).alias(before))
    within = F.row_number().over(Window.partitionBy(*by, part).orderBy(*order)) - 1
    return placed.withColumn(name, within.cast("long")).join(offsets, [*by, part]).withColumn(name, F.col(name) + F.col(before)).drop(part, before)


def running_counts(counts: DataFrame, by: list[str], value: str, n: str, upto: str, total: str) -> DataFrame:
    """`counts` (by..., value, n), one row a value, with the counts up to and with each value in its group, and the group's total.

    Values are range-partitioned over all groups and summed up across partitions, so that no task holds a group. Rows with a null in `by` are dropped.
    """
    part, before = fresh(counts, "_part"), fresh(counts, "_before")
    placed = stage(counts.repartitionByRange(*by, value).withColumn(part, F.spark_partition_id()))
    group = Window.partitionBy(*(by or [F.lit(1)]))
    sums = placed.groupBy(*by, part).agg(F.sum(n).alias("_m"))
    offsets = sums.select(*by, part, F.coalesce(F.sum("_m").over(group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before), F.sum("_m").over(group).alias(total))
    within = F.sum(n).over(Window.partitionBy(*by, part).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn(upto, within).join(offsets, [*by, part]).withColumn(upto, F.col(upto) + F.col(before)).drop(part, before)


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear between order statistics) of each group: (by..., names of `at`). Null and NaN values don't count; a group of only those has no row.

    Equal values are counted before the shuffle, and no task holds a group.
    """
    v, n, total = (fresh(df, c) for c in ("_v", "_n", "_total"))
    counts = df.filter(usable(value)).groupBy(*by, F.col(value).cast("double").alias(v)).agg(F.count("*").alias(n))
    ranked = running_counts(counts, by, v, n, "_upto", total)
    picked, out = [], []
    for name, p in at.items():
        place = F.lit(p) * (F.col(total) - 1)
        for side, k in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picked.append(F.max(F.when((F.col("_upto") > k) & (F.col("_upto") - F.col(n) <= k), F.col(v))).alias(f"_{side}_{name}"))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (place - F.floor(place))).alias(name))
    return ranked.groupBy(*by, total).agg(*picked).select(*by, *out)


def rounded(c: Column | str, places: int = 6) -> Column:
    """A double rounded for comparison, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)
