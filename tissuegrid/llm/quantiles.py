"""Percentiles per group from mergeable counts of logarithmic buckets, with a guaranteed relative error.

Bucket b of sign +1 holds the values v with gamma^(b-1) < v <= gamma^b, gamma = (1 + alpha) / (1 - alpha). Its centre 2 gamma^b / (gamma + 1) is
within a factor 1 +- alpha of each of them. Sketches of days, samples or partitions are put together by adding counts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissuegrid.common import running_counts, stage, union, usable

ALPHA = 0.01
#: The bucket of infinite values.
ENDLESS = 1_000_000_000


def _gamma(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    return (1 + alpha) / (1 - alpha)


def bucketed(df: DataFrame, value: str, alpha: float = ALPHA) -> DataFrame:
    """`df` without null and NaN values, with the columns `sign` and `bucket` of each value."""
    v = F.col(value).cast("double")
    b = F.ceil(F.log(F.abs(v)) / math.log(_gamma(alpha)))
    endless = F.abs(v) == float("inf")
    return df.filter(usable(v)).withColumns(
        {"sign": F.signum(v).cast("int"), "bucket": F.when(endless, F.lit(ENDLESS)).when(v == 0, F.lit(0)).otherwise(b).cast("int")}
    )


def sketch(df: DataFrame, by: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """Counts (by..., sign, bucket, n). Null and NaN values don't count; a null in `by` is a group of its own.

    A group has at most 1,420 / ln(gamma) buckets of each sign whatever its size: some 71,000 for alpha 0.01, and a few hundred
    where values span a few powers of ten. Counting combines rows before the shuffle, so hot groups cost no more than others.
    """
    if {"sign", "bucket", "n"} & {c.lower() for c in by}:
        raise ValueError("groups must not be called sign, bucket or n")
    value_only = df.select(*by, F.col(value).alias("_v"))  # other columns may have any name
    return bucketed(value_only, "_v", alpha).groupBy(*by, "sign", "bucket").agg(F.count("*").alias("n"))


def merge(sketches: list[DataFrame], by: list[str]) -> DataFrame:
    """Put sketches of the same alpha together; grouping by fewer columns than they have rolls them up."""
    return union([s.select(*by, "sign", "bucket", "n") for s in sketches]).groupBy(*by, "sign", "bucket").agg(F.sum("n").alias("n"))


def _positions(sk: DataFrame, by: list[str]) -> DataFrame:
    """Adds `total`, the rows of the group, and `upto`, those up to and with the bucket. A group's buckets are bounded in number, so a window over them is too."""
    keys = by or [F.lit(1)]
    order = Window.partitionBy(*keys).orderBy("sign", F.col("sign") * F.col("bucket"))
    return sk.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))


def _centre(alpha: float):
    g = _gamma(alpha)
    size = F.exp(F.col("bucket") * math.log(g)) * (2 / (g + 1))
    return F.col("sign") * F.when(F.col("bucket") == ENDLESS, F.lit(float("inf"))).when(F.col("sign") == 0, F.lit(0.0)).otherwise(size)


def _name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def percentiles(sk: DataFrame, by: list[str], probabilities: list[float], alpha: float = ALPHA) -> DataFrame:
    """(by..., n, p50, p95, ...): percentiles with linear interpolation between order statistics.

    Each order statistic is off by at most the factor 1 +- alpha, and so is the percentile where both have one sign.
    """
    at = _positions(sk, by)
    here = lambda k: (F.col("upto") > k) & (F.col("upto") - F.col("n") <= k)
    aggregates, columns = [], []
    for p in probabilities:
        position = F.lit(p) * (F.col("total") - 1)
        for side, k in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            aggregates.append(F.max(F.when(here(k), _centre(alpha))).alias(f"{side}_{_name(p)}"))
        lo, hi, f = F.col(f"lo_{_name(p)}"), F.col(f"hi_{_name(p)}"), F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
        columns.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * f).alias(_name(p)))
    return at.groupBy(*by).agg(F.max("total").alias("n"), *aggregates).select(*by, "n", *columns)


def exact_percentiles(df: DataFrame, sk: DataFrame, by: str, value: str, probabilities: list[float], alpha: float = ALPHA) -> DataFrame:
    """(by, n, p50, ...) without error, for the groups of `sk`: only rows of the buckets that hold the wanted ranks are counted by value.

    df must be the rows that were sketched.
    """
    at = _positions(sk, [by])
    wanted = F.array(*(f(F.lit(p) * (F.col("total") - 1)).cast("long") for p in probabilities for f in (F.floor, F.ceil)))
    ranks = F.filter(wanted, lambda k: (F.col("upto") > k) & (F.col("upto") - F.col("n") <= k))
    target = stage(at.withColumn("ranks", F.array_distinct(ranks)).filter(F.size("ranks") > 0).select(by, "sign", "bucket", (F.col("upto") - F.col("n")).alias("before"), "total", "ranks"))
    values = bucketed(df.select(by, F.col(value).cast("double").alias("_v")), "_v", alpha).join(target, [by, "sign", "bucket"])
    values = values.groupBy(by, "sign", "bucket", "before", "total", "ranks", "_v").agg(F.count("*").alias("n"))
    counted = running_counts(values, [by, "sign", "bucket"], "_v", "n", "_upto", "_all")  # a bucket may hold any number of values
    hit = counted.withColumn("upto", F.col("before") + F.col("_upto")).withColumn("rank", F.explode(F.filter("ranks", lambda k: (F.col("upto") > k) & (F.col("upto") - F.col("n") <= k))))
    aggregates, columns = [], []
    for p in probabilities:
        position = F.lit(p) * (F.col("total") - 1)
        for side, k in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            aggregates.append(F.max(F.when(F.col("rank") == k, F.col("_v"))).alias(f"{side}_{_name(p)}"))
        lo, hi, f = F.col(f"lo_{_name(p)}"), F.col(f"hi_{_name(p)}"), F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
        columns.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * f).alias(_name(p)))
    return hit.groupBy(by).agg(F.max("total").alias("n"), *aggregates).select(by, "n", *columns)
