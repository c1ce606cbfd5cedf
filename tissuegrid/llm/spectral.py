"""Similarity clusters by power-iteration spectral clustering, for many independent blocks at once.

1. Points of a block that lie in one small square (its diagonal is shorter than the radius) become one node; its first point stands for it.
2. Nodes within the radius get an affinity; rows are normalised by their sum. The affinities are sparse: a node has a bounded number of neighbours.
3. A few random vectors are iterated with that matrix. Within a group of mutually similar nodes their entries become equal, while
   different groups keep different ones: the vectors embed the nodes.
4. k-means in the embedding, until no node changes its cluster. k is the number of the embedding's occupied places: the nodes are seeds, and seeds
   within twice the tolerance of each other are one centre.
5. Members are ranked by their internal affinity, the mean of 1 - (d / radius)^2 over the group, which follows exactly from the group's moments.

All steps are joins and aggregates over nodes; no block or group is ever held in one task. Points may have any number of coordinates; the squares a node
looks into grow as three to their number, so a handful is what this is for.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissuegrid.common import discard, stage, usable


@dataclass(frozen=True)
class Spectral:
    """vectors: iterated together; iterations: of each; tolerance: distance in the embedding (entries lie in [0, 1]) within which centres are one;
    rounds: of k-means at most, which end as soon as no node changes its cluster."""

    radius: float = 3.0
    vectors: int = 6
    iterations: int = 8
    tolerance: float = 0.004
    rounds: int = 20


def _squares(axes: list[str], side: float, stem: str) -> dict[str, Column]:
    return {f"{stem}{c}": F.floor(F.col(c) / side) for c in axes}


def _fine(axes: list[str], p: Spectral) -> dict[str, Column]:
    """Squares whose diagonal is shorter than the radius."""
    return _squares(axes, p.radius / len(axes) ** 0.5 * 0.999, "s")


def _nodes(points: DataFrame, axes: list[str], p: Spectral) -> DataFrame:
    fine = _fine(axes, p)
    first = F.min(F.struct("id", *axes)).alias("first")
    found = points.withColumns(fine).groupBy("block", *fine).agg(first, F.count("*").alias("n"))
    return found.select("block", *fine, F.col("first.id").alias("node"), "n", *(F.col(f"first.{c}").alias(c) for c in axes))


def _edges(nodes: DataFrame, axes: list[str], p: Spectral) -> DataFrame:
    """(block, i, j, w): affinities of nodes within the radius, both ways, weighted by the points of j; the node itself is included."""
    coarse = _squares(axes, p.radius, "c")
    placed = nodes.withColumns(coarse)
    half = [s for s in itertools.product((-1, 0, 1), repeat=len(axes)) if s >= (0,) * len(axes)]  # each pair of neighbouring squares once
    steps = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(s, axes, strict=True))) for s in half))
    here = reduce(lambda a, b: a & b, [F.col(f"step.{c}") == 0 for c in axes])
    left = placed.withColumn("step", F.explode(steps)).select("block", *((F.col(f"c{c}") + F.col(f"step.{c}")).alias(f"c{c}") for c in axes), F.col("node").alias("i"), F.col("n").alias("n_i"), *(F.col(c).alias(f"{c}_i") for c in axes), here.alias("same"))
    right = placed.select("block", *coarse, F.col("node").alias("j"), F.col("n").alias("n_j"), *(F.col(c).alias(f"{c}_j") for c in axes))
    d2 = sum((F.col(f"{c}_i") - F.col(f"{c}_j")) ** 2 for c in axes)
    met = left.join(right, ["block", *coarse]).withColumn("d2", d2).filter(F.col("d2") <= p.radius**2).filter(~F.col("same") | (F.col("i") <= F.col("j")))
    k = 1 - F.col("d2") / (4 * p.radius**2)
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j", (k * F.col("n_j")).alias("w")))).otherwise(
        F.array(F.struct("i", "j", (k * F.col("n_j")).alias("w")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), (k * F.col("n_i")).alias("w")))
    )
    return met.select("block", F.explode(both).alias("e")).select("block", "e.i", "e.j", "e.w")


def _iterate(nodes: DataFrame, edges: DataFrame, p: Spectral) -> DataFrame:
    """(block, node, n, v0, v1, ...) after the power iterations."""
    names = [f"v{k}" for k in range(p.vectors)]
    rate = edges.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("i")))
    rate = stage(rate.repartition("j"))
    uniform = lambda k: F.pmod(F.xxhash64(F.lit(k), "node"), F.lit(1 << 30)) / float(1 << 30)
    v = nodes.select(F.col("node").alias("j"), *(uniform(k).alias(x) for k, x in enumerate(names)))
    for step in range(p.iterations):
        v = rate.join(v, "j").groupBy("i").agg(*(F.sum(F.col("w") * F.col(x)).alias(x) for x in names)).withColumnRenamed("i", "j")
        if step % 3 == 2:
            v = stage(v)
    return stage(nodes.select("block", "node", "n").join(v.withColumnRenamed("j", "node"), "node"))


def _near(p: Spectral, names: list[str], a: str, b: str) -> Column:
    return sum((F.col(f"{a}{x}") - F.col(f"{b}{x}")) ** 2 for x in names)


def _cells(names: list[str], width: float, around: bool) -> Column:
    """The embedding's cell by its first two entries, as an array of the cells to look into."""
    steps = (-1, 0, 1) if around else (0,)
    return F.array(*(F.struct((F.floor(F.col(names[0]) / width) + a).alias("ca"), (F.floor(F.col(names[1]) / width) + b).alias("cb")) for a in steps for b in steps))


def _k_means(embedded: DataFrame, p: Spectral) -> DataFrame:
    """(block, node, cluster): a cluster is named by the smallest node that seeded it."""
    names = [f"v{k}" for k in range(p.vectors)]
    width = 4 * p.tolerance
    mean = [(F.sum(F.col(x) * F.col("n")) / F.sum("n")).alias(x) for x in names]
    seeds = embedded.groupBy("block", *(F.floor(F.col(x) / p.tolerance).alias(f"q{x}") for x in names)).agg(F.min("node").alias("centre"), *mean, F.sum("n").alias("n"))
    seeds = stage(seeds.select("block", "centre", "n", *names))

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        a = left.withColumn("c", F.explode(_cells(names, width, True))).select("*", "c.ca", "c.cb").drop("c")
        b = right.withColumn("c", _cells(names, width, False)[0]).select("block", "c.ca", "c.cb", F.col("centre").alias("to"), *(F.col(x).alias(f"to_{x}") for x in names))
        return a.join(b, ["block", "ca", "cb"]).withColumn("d2", _near(p, names, "", "to_")).filter(F.col("d2") <= (2 * p.tolerance) ** 2)

    joined = meet(seeds, seeds).groupBy("block", "centre").agg(F.min("to").alias("merged"), *(F.first(x).alias(x) for x in [*names, "n"]))
    centres = joined.groupBy("block", F.col("merged").alias("centre")).agg(*mean, F.sum("n").alias("n")).select("block", "centre", *names)
    before = None
    for _ in range(p.rounds):
        nearest = meet(embedded, centres).groupBy("block", "node").agg(F.min_by("to", F.struct("d2", "to")).alias("to"))
        assigned = stage(embedded.join(nearest, ["block", "node"], "left").withColumn("cluster", F.coalesce("to", "node")).drop("to"))  # far from all: alone
        if before is not None:
            moved = assigned.select("node", "cluster").join(before.select("node", F.col("cluster").alias("_was")), "node").filter(F.col("cluster") != F.col("_was"))
            settled = moved.isEmpty()
            discard(before)
            if settled:
                break
        before = assigned
        centres = assigned.groupBy("block", F.col("cluster").alias("centre")).agg(*mean)
    return assigned.select("block", "node", "cluster")


def clusters(df: DataFrame, id: str, block: list[str], coordinates: dict[str, Column | str], params: Spectral = Spectral()) -> DataFrame:
    """(block columns, id, coordinates, group_id): `group_id` is the smallest id of the group.

    id: a long, unique. coordinates: names and the doubles they stand for. Rows with a null id, a null block column, or a null or NaN coordinate take no part. Repeated
    rows count once. Equal points are always in one group. Groups that lie farther apart than the radius are never joined; a chain of points may be
    divided into several clusters along its length. An empty table gives no groups.
    """
    if not coordinates:
        raise ValueError("points need a coordinate")
    axes = [f"x{k}" for k in range(len(coordinates))]
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    points = df.select(F.col(id).alias("id"), *(F.col(b).alias(f"b{k}") for k, b in enumerate(block)), *(as_column(c).cast("double").alias(a) for a, c in zip(axes, coordinates.values(), strict=True)))
    for a in axes:
        points = points.filter(usable(a)).withColumn(a, F.col(a) + F.lit(0.0))
    held = [f"b{k}" for k in range(len(block))]
    points = stage(points.dropna(subset=["id", *held]).distinct().withColumn("block", F.xxhash64(*held) if held else F.lit(0).cast("long")))
    nodes = stage(_nodes(points, axes, params))
    edges = stage(_edges(nodes, axes, params))
    found = _k_means(_iterate(nodes, edges, params), params)
    fine = _fine(axes, params)
    where = nodes.select("block", *fine, "node").join(found, ["block", "node"])
    members = stage(points.withColumns(fine).join(where, ["block", *fine]).select(*held, "id", *axes, "cluster", "block"))
    discard(points, nodes, edges)
    least = members.groupBy("block", "cluster").agg(F.min("id").alias("group_id"))
    back = [F.col(h).alias(b) for h, b in zip(held, block, strict=True)] + [F.col("id").alias(id)] + [F.col(a).alias(c) for a, c in zip(axes, coordinates, strict=True)]
    return members.join(least, ["block", "cluster"]).select(*back, "group_id")


def describe(found: DataFrame, id: str, block: list[str], coordinates: list[str], radius: float, typical: int = 3, places: int = 9) -> DataFrame:
    """One row a group: size, mean position (mean_...) and its `typical` members of highest internal affinity (equal ones to so many places by the smaller id), best first."""
    spread = sum(F.var_pop(c) for c in coordinates)
    moments = stage(found.groupBy("group_id").agg(F.count("*").alias("size"), *(F.avg(c).alias(f"mean_{c}") for c in coordinates), spread.alias("_spread")))
    d2 = sum((F.col(c) - F.col(f"mean_{c}")) ** 2 for c in coordinates) + F.col("_spread")
    scored = found.join(moments, "group_id").withColumn("affinity", F.round(1 - d2 / radius**2, places))
    best = Window.partitionBy("group_id").orderBy(F.desc("affinity"), F.asc(id))
    top = scored.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= typical)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("r", F.col(id).alias("member")))), lambda t: t["member"])
    return top.groupBy(*block, "group_id", "size", *(f"mean_{c}" for c in coordinates)).agg(listed.alias("typical"), F.max("affinity").alias("affinity"))
