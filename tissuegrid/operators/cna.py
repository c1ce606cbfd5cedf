"""Copy-number workflow: chunks of cells, results of chunks put together, predictions merged and looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuegrid.common import ordinals


def chunks(cells: DataFrame, cell: str, size: int, seed: int) -> DataFrame:
    """`cells` in a random order of the seed, cut into ceil(n / size) chunks whose sizes differ by at most one: columns `place` and `chunk`."""
    n = cells.count()
    count = max(1, -(-n // size))
    placed = ordinals(cells.withColumn("_h", F.xxhash64(F.lit(seed), cell)), [], ["_h", cell], "place").drop("_h")
    large, rest = -(-n // count), n % count or count  # the first `rest` chunks have one cell more
    small = n // count
    split = large * rest
    chunk = F.when(F.col("place") < split, F.floor(F.col("place") / large)).otherwise(rest + F.floor((F.col("place") - split) / max(small, 1)))
    return placed.withColumn("chunk", chunk.cast("int"))


def combined(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Columns of the parts side by side, matched by key. A key that a part lacks or repeats raises an error when the result is computed."""
    for p in parts[1:]:
        clash = (set(p.columns) & set(parts[0].columns)) - set(keys)
        if clash or [c for c in keys if c not in p.columns]:
            raise ValueError(f"columns don't fit together: {sorted(clash)}")
    out = None
    for i, p in enumerate(parts):
        once = p.groupBy(*keys).agg(F.count("*").alias(f"_n{i}"), *(F.first(c).alias(c) for c in p.columns if c not in keys))
        out = once if out is None else out.join(once, keys, "full")
    whole = F.lit(True)
    for i in range(len(parts)):
        whole = whole & (F.coalesce(F.col(f"_n{i}"), F.lit(0)) == 1)
    checked = out.filter(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("key missing or repeated: "), F.concat_ws(",", *(F.col(k).cast("string") for k in keys)))).cast("boolean")))
    return checked.select(*keys, *(c for p in parts for c in p.columns if c not in keys))


def conflicts(predictions: DataFrame, cell: str, label: str) -> DataFrame:
    """Cells with different labels: (cell, labels), the labels in order and separated by commas."""
    found = predictions.groupBy(cell).agg(F.array_sort(F.collect_set(label)).alias("l"))
    return found.filter(F.size("l") > 1).select(cell, F.array_join("l", ",").alias("labels"))


def merged(predictions: DataFrame, cell: str, label: str, strict: bool = True) -> DataFrame:
    """One label a cell. Different labels of a cell raise an error, or leave the cell out if not strict."""
    found = predictions.groupBy(cell).agg(F.min(label).alias(label), F.max(label).alias("_other"))
    same = F.col(label) == F.col("_other")
    if strict:
        same = F.when(same, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("different labels of "), F.col(cell).cast("string"))).cast("boolean"))
    return found.filter(same).drop("_other")


def flipped(id: Column) -> Column:
    """Dots and dashes of an identifier exchanged."""
    return F.translate(id, ".-", "-.")


def looked_up(cells: DataFrame, cell: str, predictions: DataFrame, id: str, label: str, missing: str = "NA") -> DataFrame:
    """`cells` with the label of their identifier, else of the identifier with dots and dashes exchanged, else `missing`. Identifiers are unique in `predictions`."""
    a = predictions.select(F.col(id).alias("_a"), F.col(label).alias("_la"))
    b = predictions.select(F.col(id).alias("_b"), F.col(label).alias("_lb"))
    met = cells.join(a, F.col(cell) == F.col("_a"), "left").join(b, flipped(F.col(cell)) == F.col("_b"), "left")
    return met.withColumn(label, F.coalesce("_la", "_lb", F.lit(missing))).select(*cells.columns, label)


def label_order(label: Column) -> Column:
    """Rows of heat-maps: aneuploid first, diploid next, all others after."""
    return F.when(label == "aneuploid", 0).when(label == "diploid", 1).otherwise(99)
