"""Simulated truth, perturbations and dropouts. Random numbers depend on the seed and the row's keys only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissuegrid.common import stage, with_groups
from tissuegrid.operators.diffusion import uniform
from tissuegrid.operators.labels import codes
from tissuegrid.operators.nearest import nearest

COUNTS_A_TASK = 2_000_000


def grid_spots(cells: DataFrame, separation: float, block: list[str]) -> DataFrame:
    """(cell, spot): squares of a grid that starts half a separation before the first cell of the block, named SPOT_i_j."""
    box = with_groups(cells, block, F.min("x").alias("_x0"), F.min("y").alias("_y0"))
    at = lambda c: F.floor((F.col(c) - F.col(f"_{c}0") + separation / 2) / separation).cast("string")
    return box.select("cell", *block, F.concat_ws("_", F.lit("SPOT"), at("x"), at("y")).alias("spot"))


def likely_separation(cells: DataFrame, block: list[str]) -> DataFrame:
    """(block..., separation): left edge of the fullest bin of nearest-neighbour distances, in bins of about one unit; equal counts by the smaller edge."""
    d = nearest(cells, "cell", ["x", "y"], 1, block).select(F.col("query").alias("cell"), F.col("distance").alias("d"))
    placed = with_groups(cells.select("cell", *block).join(d, "cell"), block, F.min("d").alias("_l"), F.max("d").alias("_u"))
    bins = F.greatest(F.floor(F.col("_u") - F.col("_l")), F.lit(1))
    width = (F.col("_u") - F.col("_l")) / bins
    k = F.least(F.floor((F.col("d") - F.col("_l")) / F.when(width > 0, width)), bins - 1)
    counted = placed.withColumn("edge", F.col("_l") + F.coalesce(k, F.lit(0)) * width).groupBy(*block, "edge").agg(F.count("*").alias("n"))
    return counted.groupBy(*block).agg(F.min(F.struct((-F.col("n")).alias("n"), "edge")).alias("b")).select(*block, F.col("b.edge").alias("separation"))


def poisson(mean: Column, u: Column, most: int = 200) -> Column:
    """Poisson numbers by inversion: the count of cumulative probabilities that u exceeds, for means up to some 100."""
    step = lambda s, k: F.struct((s["p"] * mean / k).alias("p"), (s["c"] + s["p"] * mean / k).alias("c"), (s["n"] + (u > s["c"]).cast("int")).alias("n"))
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, lambda s, k: step(s, k.cast("double")), lambda s: s["n"])


def reach(mean: float) -> int:
    """The count beyond which Poisson numbers of a mean up to this have no chance that a double holds."""
    p, k = math.exp(-mean), 0
    while k < mean or p > 2.0**-56:
        k += 1
        p *= mean / k
    return k


def with_poisson(df: DataFrame, mean: str, u: Column, most: int, name: str) -> DataFrame:
    """`df` with Poisson numbers by inversion. Each step is a column of its own, which the planner compiles: for many rows of small means, `most` up to some 40."""
    kept, n = df.columns, F
    df = df.withColumns({"_u": u, "_p": F.exp(-F.col(mean)), "_c": F.lit(0.0)})
    for k in range(most):
        df = df.withColumns({f"_c{k}": F.col(f"_c{k - 1}" if k else "_c") + F.col("_p"), "_p": F.col("_p") * (F.col(mean) * (1.0 / (k + 1)))})
        n = n.when(F.col("_u") <= F.col(f"_c{k}"), k)
    return df.select(*kept, n.otherwise(most).alias(name))


def cumulative(mean: Column, most: int) -> Column:
    """Cumulative Poisson probabilities of the counts from 0 to `most`."""
    step = lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.array_append(s["c"], F.element_at(s["c"], -1) + s["p"] * mean / k).alias("c"))
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, lambda s, k: step(s, k.cast("double")), lambda s: s["c"])


def expression(cells: DataFrame, genes: DataFrame, seed: int, low: tuple[float, float] = (1, 3), high: tuple[float, float] = (10, 30)) -> DataFrame:
    """(cell, gene, rate, value): Poisson counts whose rate depends on gene and cluster, high in the gene's own. cells: (cell, cluster); genes: (gene, cluster).

    Cells are spread by the number of counts to draw, not by their own size. A gene's high rate is one number, whose probabilities are laid out once and searched by halving.
    """
    genes = stage(genes.select("gene", F.col("cluster").alias("_own")))
    placed = cells.select("cell", "cluster").repartition(max(1, math.ceil(cells.count() * genes.count() / COUNTS_A_TASK)), "cell")
    rate = lambda bounds, cluster: bounds[0] + (bounds[1] - bounds[0]) * uniform(seed, "gene", cluster)
    u, own = uniform(seed + 1, "cell", "gene"), F.equal_null("cluster", "_own")

    others = placed.crossJoin(F.broadcast(genes)).filter(~own).select("cell", "gene", rate(low, "cluster").alias("rate"))
    most = reach(max(low))
    others = with_poisson(others, "rate", u, most, "value") if most <= 40 else others.withColumn("value", poisson(F.col("rate"), u, most))

    halves = [1 << k for k in reversed(range(reach(max(high)).bit_length()))]
    tabled = stage(genes.withColumn("rate", rate(high, "_own")).withColumn("_c", cumulative(F.col("rate"), 2 * halves[0] - 1)))
    found = F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), lambda n, h: n + F.when(F.get("_c", n + h - 1) < F.col("_u"), h).otherwise(0))
    return others.unionByName(placed.join(F.broadcast(tabled), own).withColumn("_u", u).select("cell", "gene", "rate", found.alias("value")))


def dropout_chance(mean: Column, midpoint: float, shape: float) -> Column:
    """Logistic of the logarithm of a mean: 1 / (1 + exp(-shape (ln mean - midpoint)))."""
    return 1 / (1 + F.exp(-shape * (F.log(mean) - midpoint)))


def dropouts(entries: DataFrame, means: DataFrame, midpoint: float, shape: float, seed: int) -> DataFrame:
    """Entries of which each is kept with 1 - its gene's chance of dropping out. means: (gene, mean)."""
    chance = entries.join(means.select("gene", dropout_chance(F.col("mean"), midpoint, shape).alias("_p")), "gene")
    return chance.filter(uniform(seed, "cell", "gene") >= F.col("_p")).select(*entries.columns)


def mislabelled(cells: DataFrame, label: str, labels: list[str] | None, share: float, seed: int) -> DataFrame:
    """About a share of the cells with another of the given labels, or of all labels that the cells have where none are given.

    A cell draws a number below the count of the other labels and passes over its own, so that each other label is equally likely.
    """
    known = cells.select(label) if labels is None else cells.sparkSession.createDataFrame([(v,) for v in labels], f"`{label}` string")
    numbered = stage(codes(known.filter(F.col(label).isNotNull()).distinct(), label, "_code"))
    own = cells.join(numbered, label, "left")
    others = F.lit(numbered.count()) - F.col("_code").isNotNull().cast("int")
    pick = F.floor(uniform(seed + 1, "cell") * others)
    pick = pick + F.coalesce((pick >= F.col("_code")).cast("int"), F.lit(0))
    drawn = (uniform(seed, "cell") < share) & (others > 0)
    placed = own.withColumn("_pick", F.when(drawn, pick).otherwise(-1 - pick))  # negative numbers meet no label, and no key is frequent
    other = numbered.select(F.col("_code").cast("long").alias("_pick"), F.col(label).alias("_other"))
    return placed.join(other, "_pick", "left").withColumn(label, F.coalesce("_other", label)).select(*cells.columns)


def dropped_cells(cells: DataFrame, share: float, seed: int) -> DataFrame:
    """Cells but for about a share, by the hash of the cell."""
    return cells.filter(uniform(seed, "cell") >= share)


def perturbed(edges: DataFrame, wider: DataFrame, share: float, mean_drop: float, seed: int) -> DataFrame:
    """Neighbour edges of which some rows' are rewired: about a share of the rows lose a Poisson number of edges and get as many of the wider graph's instead.

    edges, wider: (i, j) with the edges of `edges` among the wider ones.
    """
    drawn = edges.select("i").distinct().filter(uniform(seed, "i") < share)
    drawn = drawn.withColumn("_drop", poisson(F.lit(float(mean_drop)), uniform(seed + 1, "i"), max(20, math.ceil(mean_drop * 4))))
    order = lambda k: Window.partitionBy("i").orderBy(F.xxhash64(F.lit(seed + k), "i", "j"), "j")
    marked = edges.select("i", "j").join(drawn, "i", "left").withColumn("_r", F.row_number().over(order(2)))
    kept = marked.filter(F.col("_drop").isNull() | (F.col("_r") > F.col("_drop"))).select("i", "j")
    lost = marked.filter(F.col("_r") <= F.col("_drop")).groupBy("i").agg(F.count("*").alias("_lost"))
    fresh = wider.select("i", "j").join(edges.select("i", "j"), ["i", "j"], "left_anti").join(lost, "i").withColumn("_r", F.row_number().over(order(3)))
    return kept.unionByName(fresh.filter(F.col("_r") <= F.col("_lost")).select("i", "j"))
