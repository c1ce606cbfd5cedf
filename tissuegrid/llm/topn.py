"""The N highest-scoring items of every group, found by bisection instead of sorting groups.

All groups are refined at once. A pass counts the rows of each group above a set of midpoints of the current cutoff
interval and keeps only the interval that holds the N-th row; rows above it are in the result, rows below are out.
The code that is bisected is the pair (score, identifier): the score descending, then the identifier ascending.
No group is ever sorted or held in one task, so a group may hold most of the table or consist of ties only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissuegrid.common import stage, union, usable

#: Midpoints a pass; also the largest number of counters a group has after the first pass.
FANOUT = 1024
#: Width of the first pass's score intervals: about one part in a hundred.
LOG_STEP = 0.01


def _first_slot():
    """Rough order-preserving code of the score: its sign, and the logarithm of its size in steps of LOG_STEP."""
    s = F.col("s")
    step = F.least(F.greatest(F.floor(F.log(F.abs(s)) / LOG_STEP), F.lit(-80_000)), F.lit(80_000)) + F.lit(100_000)
    return F.when(s == 0, F.lit(0)).when(s > 0, step).otherwise(-step).cast("long")


def _next_slot():
    """Midpoints spread evenly over the scores of the interval, or over its identifiers where all scores are equal."""
    share = (F.col("s") / 2 - F.col("s_min") / 2) / (F.col("s_max") / 2 - F.col("s_min") / 2)
    share = F.when(F.col("s") == F.col("s_max"), F.lit(1.0)).otherwise(share)  # also for infinite scores
    by_score = F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * FANOUT)
    past = lambda c: (F.col(c).cast("decimal(20,0)") - F.col("i_min").cast("decimal(20,0)")).cast("double")  # noqa: E731  exact before it is a double
    by_id = -F.floor(past("i") / (past("i_max") + 1) * FANOUT)
    return F.when(F.col("s_min") < F.col("s_max"), by_score).otherwise(by_id).cast("long")


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, max_passes: int = 400) -> DataFrame:
    """The `n` rows (group, item, score) of highest score in every group; equal scores by the smaller item.

    group: any orderable column; rows with a null group don't count. item: a long that names the row within its group.
    Null and NaN scores don't count; infinite ones do. Repeated rows count once; an item that has several scores in a group counts
    once for each. Scores and identifiers of any size are told apart exactly. A group with `n` rows or fewer is returned whole. Other columns are ignored. An empty table gives an empty result.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    names = [group, item, score]
    rows = df.select(F.col(group).alias("g"), F.col(item).cast("long").alias("i"), F.col(score).cast("double").alias("s"))
    rows = rows.filter(F.col("g").isNotNull() & F.col("i").isNotNull() & usable("s")).withColumn("s", F.col("s") + F.lit(0.0))
    # Repeated rows are removed by all columns, which spreads every group over all tasks; counts are combined before they are shuffled.
    active = stage(rows.distinct())
    active, kept, first = active.withColumn("need", F.lit(n).cast("long")), [], True
    for _ in range(max_passes):
        slotted = active.withColumn("slot", _first_slot() if first else _next_slot())
        counted = slotted.groupBy("g", "need", "slot").agg(
            F.count("*").alias("c"),
            *(f(k).alias(f"{k}_{name}") for k in "si" for name, f in (("min", F.min), ("max", F.max))),
        )
        down = Window.partitionBy("g").orderBy(F.desc("slot"))
        above = F.coalesce(F.sum("c").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # The interval that holds the last row wanted; a group without such an interval is wanted whole.
        cut = (
            counted.withColumn("above", above)
            .filter((F.col("above") < F.col("need")) & (F.col("above") + F.col("c") >= F.col("need")))
            .select("g", F.col("slot").alias("cut"), "above", (F.col("above") + F.col("c") == F.col("need")).alias("full"), *(f"{k}_{m}" for k in "si" for m in ("min", "max")))
        )
        cut = stage(cut)
        kept_or_open = (
            slotted.select("g", "i", "s", "need", "slot")
            .join(cut, "g", "left")
            .filter(F.col("cut").isNull() | (F.col("slot") >= F.col("cut")))
            .withColumn("open", (F.col("slot") == F.col("cut")) & ~F.col("full"))
            .select("g", "i", "s", (F.col("need") - F.coalesce("above", F.lit(0))).alias("need"), *(f"{k}_{m}" for k in "si" for m in ("min", "max")), F.coalesce("open", F.lit(False)).alias("open"))
        )
        done = stage(kept_or_open)
        kept.append(done.filter(~F.col("open")).select("g", "i", "s"))
        active, first = done.filter("open").drop("open"), False
        if active.isEmpty():
            return union(kept).toDF(*names)
    raise RuntimeError("the cutoffs did not settle")  # every pass parts the smallest code from the largest, and most passes divide an interval by 1,024


def ranked(top: DataFrame, group: str, item: str, score: str, rank: str = "rank") -> DataFrame:
    """Number the rows of a `top_n` result within their groups; there are at most n of them in each."""
    return top.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), F.asc(item))))
