"""Cell graphs as edge tables (i, j, w), and the Markov transition table (dst, src, t) made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuegrid.common import quantiles, with_groups


def shared_neighbours(edges: DataFrame, k: int, only_neighbours: bool = False) -> DataFrame:
    """(i, j, w): the share of k neighbours that i and j have in common, both ways.

    edges: (i, j), j being one of the k nearest of i. By default any two rows that share a neighbour are joined, as many as a common neighbour has
    rows: bounded where coordinates differ, the square of their number for equal rows. only_neighbours: weights of neighbour edges alone.
    """
    own = edges.select("i", F.col("j").alias("m"))
    if only_neighbours:
        pairs = edges.select("i", "j")
        met = pairs.join(own, "i").join(own.select(F.col("i").alias("j"), "m"), ["j", "m"])
        return met.groupBy("i", "j").agg((F.count("*") / k).alias("w"))
    other = own.select(F.col("i").alias("j"), "m")
    return own.join(other, "m").filter("i <> j").groupBy("i", "j").agg((F.count("*") / k).alias("w"))


def thresholded(edges: DataFrame, least: float, w: str = "w") -> DataFrame:
    """Edges of weight `least` or more."""
    return edges.filter(F.col(w) >= least)


def with_distance(snn: DataFrame, knn: DataFrame) -> DataFrame:
    """Shared-neighbour edges with the distance of the neighbour edge; null where there is none."""
    return snn.join(knn.select("i", "j", "d"), ["i", "j"], "left")


def two_hops(edges: DataFrame) -> DataFrame:
    """(i, j): rows two steps away; i itself where a step can be taken back."""
    return edges.select("i", F.col("j").alias("m")).join(edges.select(F.col("i").alias("m"), "j"), "m").select("i", "j").distinct()


def hop_spots(edges: DataFrame, spot_of: DataFrame) -> DataFrame:
    """(i, spot): spots that hold a neighbour of one or two hops. spot_of: (cell, spot)."""
    near = edges.select("i", "j").unionByName(two_hops(edges))
    return near.join(spot_of.withColumnRenamed("cell", "j"), "j").select("i", "spot").distinct()


def hop_spot_cells(edges: DataFrame, spot_of: DataFrame) -> DataFrame:
    """(i, j): every cell of those spots."""
    return hop_spots(edges, spot_of).join(spot_of.withColumnRenamed("cell", "j"), "spot").select("i", "j").distinct()


def asymmetric(edges: DataFrame, w: str = "w") -> DataFrame:
    """Entries that differ from their mirror image; none for a symmetric matrix."""
    a = edges.select("i", "j", F.col(w).alias("w"))
    b = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col(w).alias("v"))
    return a.join(b, ["i", "j"], "full").filter(F.coalesce("w", F.lit(0.0)) != F.coalesce("v", F.lit(0.0)))


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """(i, neighbours) in ascending order; a list is as long as the row's degree."""
    return edges.groupBy("i").agg(F.array_sort(F.collect_list("j")).alias("neighbours"))


def edges_of(lists: DataFrame) -> DataFrame:
    """The way back: unit edges."""
    return lists.select("i", F.explode("neighbours").alias("j"), F.lit(1.0).alias("w"))


def replaced(edges: DataFrame, lists: DataFrame) -> DataFrame:
    """Edges of the rows in `lists` replaced by unit edges to their new neighbours."""
    return edges.select("i", "j", "w").join(lists.select("i"), "i", "left_anti").unionByName(edges_of(lists))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("i").agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def node_weights(df: DataFrame, score: str, by: list[str] = [], steepness: float = 1.0) -> DataFrame:  # noqa: B006
    """`df` with `weight`: exp(-k m) over its largest value, m being the score scaled to [0, 1] within the group."""
    stats = with_groups(df, by, F.min(score).alias("_l"), F.max(score).alias("_u"))
    m = F.when(F.col("_u") > F.col("_l"), (F.col(score) - F.col("_l")) / F.when(F.col("_u") > F.col("_l"), F.col("_u") - F.col("_l"))).otherwise(0.0)
    # The row of the smallest score has m = 0, so the largest of the weights is 1.
    return stats.withColumn("weight", F.exp(-steepness * m)).select(*df.columns, "weight")


def balanced(df: DataFrame, feature: str, by: list[str], low: float = 0.15, high: float = 0.85, alpha: float = 5.0) -> DataFrame:
    """`df` with `balance`: a logistic of the feature over its quantile range; the feature itself where the range is empty."""
    q = quantiles(df, by, feature, {"_l": low, "_u": high})
    joined = df.join(q, by) if by else df.crossJoin(F.broadcast(q))
    width = F.when(F.col("_u") > F.col("_l"), F.col("_u") - F.col("_l"))
    t = 2 * (F.col(feature) - F.col("_l")) / width - 1
    return joined.withColumn("balance", F.when(width.isNull(), F.col(feature)).otherwise(1 / (1 + F.exp(-alpha * t)))).select(*df.columns, "balance")


def flow(weight_dst: Column, weight_src: Column, alpha: float = 5.0) -> Column:
    """Preference of flow along an edge from src to dst: towards the row that holds less, from one that is sure."""
    return 1 / (1 + F.exp(-alpha * weight_src * (weight_src - weight_dst)))


def flow_edges(edges: DataFrame, weights: DataFrame, alpha: float = 5.0) -> DataFrame:
    """(dst, src, w, flow). edges: (i, j, w); weights: (cell, weight)."""
    a = weights.select(F.col("cell").alias("i"), F.col("weight").alias("wi"))
    b = weights.select(F.col("cell").alias("j"), F.col("weight").alias("wj"))
    both = edges.select("i", "j", "w").join(a, "i").join(b, "j")
    return both.select(F.col("i").alias("dst"), F.col("j").alias("src"), "w", flow(F.col("wi"), F.col("wj"), alpha).alias("flow"))


def transition(edges: DataFrame, weights: DataFrame, share: float = 0.8, preferential: bool = True, weigh: bool = True, alpha: float = 5.0) -> DataFrame:
    """(dst, src, t): row dst says where its next value comes from.

    t_ij = (1 - (1 - share) w_i) p_ij with p the row-normalised product of edge weight and flow, t_ii = (1 - share) w_i. A row without edges keeps
    (1 - share) w_i of itself only. weigh=False takes all node weights as 0, whereby `share` loses its effect.
    """
    node = weights if weigh else weights.withColumn("weight", F.lit(0.0))
    of = flow_edges(edges, weights, alpha)
    p = of.select("dst", "src", (F.col("w") * (F.col("flow") if preferential else F.lit(1.0))).alias("p"))
    rows = with_groups(p, ["dst"], F.sum("p").alias("_sum")).join(node.select(F.col("cell").alias("dst"), "weight"), "dst")
    off = rows.select("dst", "src", (F.col("p") / F.col("_sum") * (1 - (1 - share) * F.col("weight"))).alias("t"))
    diagonal = node.select(F.col("cell").alias("dst"), F.col("cell").alias("src"), ((1 - share) * F.col("weight")).alias("t"))
    return off.unionByName(diagonal)


def transition_outward(edges: DataFrame, weights: DataFrame, share: float = 0.8, alpha: float = 5.0) -> DataFrame:
    """The variant in which every row keeps 1 - share of itself, and takes share (1 - w_i) p_ij from its neighbours."""
    of = flow_edges(edges, weights, alpha)
    rows = with_groups(of.withColumn("p", F.col("w") * F.col("flow")), ["dst"], F.sum("p").alias("_sum")).join(weights.select(F.col("cell").alias("dst"), "weight"), "dst")
    off = rows.select("dst", "src", (F.col("p") / F.col("_sum") * (1 - F.col("weight")) * share).alias("t"))
    return off.unionByName(weights.select(F.col("cell").alias("dst"), F.col("cell").alias("src"), F.lit(1.0 - share).alias("t")))


def composed(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two transition tables."""
    right = b.select(F.col("dst").alias("m"), F.col("src").alias("s"), F.col("t").alias("u"))
    met = a.select("dst", F.col("src").alias("m"), "t").join(right, "m")
    return met.groupBy("dst", F.col("s").alias("src")).agg(F.sum(F.col("t") * F.col("u")).alias("t"))


def inflated(edges: DataFrame, weights: DataFrame, share: float = 0.8, percent: float = 0.0, **how) -> DataFrame:
    """Diffusion followed by its reverse with the share -share (100 + percent) / 100."""
    return composed(transition(edges, weights, -share * (100 + percent) / 100, **how), transition(edges, weights, share, **how))
