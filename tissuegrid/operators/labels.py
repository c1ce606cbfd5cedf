"""Labels and membership: cells in spots, heterogeneity of spots, majorities, proportions and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissuegrid.common import ordinals, quantiles


def unique_names(cells: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """`cells` with `ordinal` (0-based within equal names) and `unique_name`: the name itself, then name-1, name-2, ... A name may have any number of cells;
    `order` must tell them apart. Cells without a name, or with a null in `by`, drop out."""
    suffixed = F.when(F.col("ordinal") == 0, F.col(name)).otherwise(F.concat_ws("-", F.col(name), F.col("ordinal").cast("string")))
    return ordinals(cells.dropna(subset=[*by, name]), [*by, name], order, "ordinal").withColumn("unique_name", suffixed)


def downsample(cells: DataFrame, by: list[str], name: str, order: list[str], k: int) -> DataFrame:
    """At most k cells of each name; the planner keeps k of each partition before the shuffle."""
    return cells.withColumn("_r", F.row_number().over(Window.partitionBy(*by, name).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def variation(cells: DataFrame, spot: list[str], features: Sequence[str]) -> DataFrame:
    """(spot..., heterogeneity): mean over features of population deviation / mean; a feature without mean is skipped. A spot of one cell has 0."""
    each = [F.try_divide(F.stddev_pop(c), F.when(F.avg(c) != 0, F.avg(c))).alias(c) for c in features]
    per = cells.groupBy(*spot).agg(*each)
    known = F.filter(F.array(*features), lambda v: v.isNotNull() & ~F.isnan(v))
    return per.select(*spot, F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.size(known)).alias("heterogeneity"))


def entropy(cells: DataFrame, spot: list[str], label: str) -> DataFrame:
    """(spot..., entropy) of the labels in a spot, natural logarithm; null labels don't count, and a spot of only those drops out."""
    counts = cells.filter(F.col(label).isNotNull()).groupBy(*spot, label).agg(F.count("*").alias("n"))
    total = counts.groupBy(*spot).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("l"))
    return total.select(*spot, (F.log("t") - F.col("l") / F.col("t")).alias("entropy"))


def shared_back(cells: DataFrame, per_spot: DataFrame, spot: list[str]) -> DataFrame:
    """A value of spots beside each of their cells; cells whose spot has none keep null."""
    return cells.join(per_spot, spot, "left")


def to_spots(entries: DataFrame, spot_of: DataFrame, how: str = "mean") -> DataFrame:
    """(spot, gene, value) from (cell, gene, value): the sum, or the mean over all cells of the spot, absent zeros included."""
    sums = entries.join(spot_of, "cell").groupBy("spot", "gene").agg(F.sum("value").alias("value"))
    if how == "sum":
        return sums
    sizes = spot_of.groupBy("spot").agg(F.count("*").alias("_n"))
    return sums.join(sizes, "spot").select("spot", "gene", (F.col("value") / F.col("_n")).alias("value"))


def to_cells(spot_entries: DataFrame, spot_of: DataFrame) -> DataFrame:
    """Every cell with its spot's expression."""
    return spot_of.join(spot_entries, "spot").select("cell", "gene", "value")


def majority(df: DataFrame, by: list[str], label: str, above: float = 0.0) -> DataFrame:
    """(by..., majority, share): the most frequent label if its share is above the threshold (strictly), else null; equal counts by the smaller label.

    Null labels don't count; a group of only those drops out.
    """
    counts = df.filter(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("label"))).alias("b"), F.sum("n").alias("t"))
    share = -F.col("b.n") / F.col("t")
    return best.select(*by, F.when(share > above, F.col("b.label")).alias("majority"), share.alias("share"))


def annotated(cells: DataFrame, cluster: str, label: str, out: str, above: float = 0.0) -> DataFrame:
    """`cells` with the majority label of their cluster; null where the cluster has none above the threshold, or the cell no cluster."""
    return cells.join(majority(cells.filter(F.col(cluster).isNotNull()), [cluster], label, above).select(cluster, F.col("majority").alias(out)), cluster, "left")


def levels(entries: DataFrame, groups: DataFrame, group: str, markers: DataFrame) -> DataFrame:
    """(cell, gene, value, group, level): expression of marker genes, `high` in cells of the group they mark and `low` in others. markers: (gene, marks)."""
    met = entries.join(markers, "gene").join(groups.select("cell", group), "cell")
    return met.select("cell", "gene", "value", group, F.when(F.equal_null(F.col(group), F.col("marks")), "high").otherwise("low").alias("level"))


def proportions(cells: DataFrame, spot: list[str], label: str) -> DataFrame:
    """(spot..., label, share) of the labels that occur in each spot."""
    counts = cells.filter(F.col(label).isNotNull()).groupBy(*spot, label).agg(F.count("*").alias("n"))
    return counts.join(counts.groupBy(*spot).agg(F.sum("n").alias("t")), spot).select(*spot, label, (F.col("n") / F.col("t")).alias("share"))


def one_hot(df: DataFrame, id: list[str], label: str) -> DataFrame:
    """(id..., label, value): a 1 for each row's label, whatever labels there are. Zeros are absent, so a row without label has none."""
    return df.filter(F.col(label).isNotNull()).select(*id, F.col(label).alias("label"), F.lit(1).alias("value"))


def codes(df: DataFrame, label: str, code: str = "code") -> DataFrame:
    """Numbers of the labels in sorted order; null has none."""
    distinct = df.select(label).filter(F.col(label).isNotNull()).distinct()
    numbered = ordinals(distinct, [], [label], code).withColumn(code, F.col(code).cast("int"))
    return df.join(numbered, label, "left")


def group_means(entries: DataFrame, groups: DataFrame, group: list[str]) -> DataFrame:
    """(group..., gene, mean) over all members of the group, absent zeros included. groups: (cell, group...)."""
    sizes = groups.groupBy(*group).agg(F.count("*").alias("_n"))
    sums = entries.join(groups, "cell").groupBy(*group, "gene").agg(F.sum("value").alias("_s"))
    return sums.join(sizes, group).select(*group, "gene", (F.col("_s") / F.col("_n")).alias("mean"))


def top_share(df: DataFrame, by: list[str], value: str, quantile: float) -> DataFrame:
    """Rows above the group's quantile (linear, exact)."""
    cut = quantiles(df, by, value, {"_cut": quantile})
    return df.join(cut, by).filter(F.col(value) > F.col("_cut")).drop("_cut")


def cross_label_share(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: mean over rows of the share of edges to another label, and the share of rows with at least one. labels: (cell, label)."""
    a, b = labels.select(F.col("cell").alias("i"), F.col("label").alias("a")), labels.select(F.col("cell").alias("j"), F.col("label").alias("b"))
    other = (~F.equal_null("a", "b")).cast("double")
    per = edges.select("i", "j").join(a, "i").join(b, "j").groupBy("i").agg(F.avg(other).alias("share"))
    return per.agg(F.avg("share").alias("mean_share"), F.avg((F.col("share") > 0).cast("double")).alias("rows_with"))


def thresholds(df: DataFrame, score: str, labels: int, n: int = 10, at_least: bool = True) -> DataFrame:
    """Rows stratified by n even thresholds from 0 to ln(labels): (threshold, rows) that reach it (or stay below).

    Each row is counted once, at its highest threshold; the counts are then summed up.
    """
    import math

    step = math.log(max(labels, 1)) / (n - 1)
    place = F.floor(F.col(score) / step + 1e-9) if step else F.lit(n - 1)
    cuts = df.sparkSession.range(n).select(F.col("id").cast("int").alias("k"), (F.col("id") * step).alias("threshold"))
    top = F.least(place, F.lit(n - 1)) if at_least else place + 1
    counted = df.filter(F.col(score).isNotNull()).groupBy(top.cast("int").alias("_top")).agg(F.count("*").alias("_n"))
    reach = F.col("_top") >= F.col("k") if at_least else F.col("_top") <= F.col("k")
    return cuts.join(F.broadcast(counted), reach, "left").groupBy("k", "threshold").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"))
