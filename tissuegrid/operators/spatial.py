"""Joins and filters by position: radius joins over a grid, nearest spots, polygons, tiles, rings and outliers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissuegrid.common import quantiles, stage, with_groups
from tissuegrid.operators.nearest import nearest


def within(left: DataFrame, right: DataFrame, radius: float, block: list[str] = [], x: str = "x", y: str = "y") -> DataFrame:  # noqa: B006
    """Pairs of rows at most `radius` apart, with their distance `d`: an equality join on grid squares as wide as the radius, each right row
    standing in the nine squares around it. left: (i, x, y, block...), right: (j, x, y, block...). A row without position has no partner.
    """
    if radius <= 0:
        raise ValueError("the radius must be positive")
    square = lambda c: F.floor(F.col(c) / radius)
    a = left.withColumns({"_gx": square(x), "_gy": square(y)})
    steps = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (-1, 0, 1) for q in (-1, 0, 1)))
    b = right.withColumn("_s", F.explode(steps)).select("*", (square(x) + F.col("_s.p")).alias("_gx"), (square(y) + F.col("_s.q")).alias("_gy")).drop("_s")
    b = b.withColumnsRenamed({x: "_x", y: "_y"})
    d2 = (F.col(x) - F.col("_x")) ** 2 + (F.col(y) - F.col("_y")) ** 2
    met = a.join(b, [*block, "_gx", "_gy"]).withColumn("_d2", d2).filter(F.col("_d2") <= radius * radius)
    return met.withColumn("d", F.sqrt("_d2")).drop("_gx", "_gy", "_x", "_y", "_d2")


def radius_edges(cells: DataFrame, radius: float, block: list[str]) -> DataFrame:
    """(i, j, d) of all different cells (cell, x, y, block...) within the radius, both ways."""
    a, b = (cells.select(F.col("cell").alias(k), "x", "y", *block) for k in "ij")
    return within(a, b, radius, block).filter("i <> j").select("i", "j", "d")


def nearest_spot(cells: DataFrame, spots: DataFrame, reach: float, block: list[str], margin: Column | None = None) -> DataFrame:
    """The nearest spot of each cell, equal distances by the smaller spot; cells farther than `reach` have none.

    cells: (cell, x, y, block...); spots: (spot, x, y, block...). margin: the distance a cell must stay below (strictly), of the cell's columns; null lets all pass.
    """
    met = within(cells.withColumnRenamed("cell", "i"), spots.withColumnRenamed("spot", "j"), reach, block)
    best = met.groupBy("i").agg(F.min(F.struct("d", "j")).alias("b")).select(F.col("i").alias("cell"), F.col("b.j").alias("spot"), F.col("b.d").alias("d"))
    if margin is None:
        return best
    limit = cells.select("cell", margin.alias("_m"))
    return best.join(limit, "cell").filter(F.col("_m").isNull() | (F.col("d") < F.col("_m"))).select("cell", "spot", "d")


def radius_aggregate(cells: DataFrame, bins: DataFrame, entries: DataFrame, radius: float, block: list[str], how: str = "mean") -> DataFrame:
    """Expression of all bins within the radius of a cell: (cell, gene, value), the mean over the bins (zeros counted) or the sum. Cells without bins drop out.

    bins: (bin, x, y, block...); entries: (bin, gene, value).
    """
    met = within(cells.withColumnRenamed("cell", "i"), bins.withColumnRenamed("bin", "j"), radius, block).select("i", "j")
    counted = with_groups(met, ["i"], F.count("*").alias("_n"))
    total = counted.join(entries.withColumnRenamed("bin", "j"), "j").groupBy("i", "gene", "_n").agg(F.sum("value").alias("value"))
    return total.select(F.col("i").alias("cell"), "gene", (F.col("value") / F.col("_n") if how == "mean" else F.col("value")).alias("value"))


def knn_edges(cells: DataFrame, id: str, dimensions: list[str], k: int, block: list[str]) -> DataFrame:
    """(i, j, d) of the k nearest cells of the same block."""
    return nearest(cells, id, dimensions, k, block).select(F.col("query").alias("i"), F.col("neighbour").alias("j"), F.col("distance").alias("d"))


def constrained_knn(cells: DataFrame, dimensions: list[str], k: int, radius: float, block: list[str]) -> DataFrame:
    """(i, j, d): of the cells within the radius, the k nearest by feature distance d; equal ones by the smaller id."""
    a, b = (cells.select(F.col("cell").alias(s), "x", "y", *block, *(F.col(c).alias(f"{s}_{c}") for c in dimensions)) for s in "ij")
    met = within(a, b, radius, block).filter("i <> j")
    d2 = sum((F.col(f"i_{c}") - F.col(f"j_{c}")) ** 2 for c in dimensions)
    best = Window.partitionBy("i").orderBy("d", "j")
    return met.select("i", "j", F.sqrt(d2).alias("d")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("i", "j", "d")


def context_sizes(cells: DataFrame, block: list[str]) -> DataFrame:
    """Per block mean, median, least and largest nearest-neighbour distance, and twice the mean rounded to an integer: the half width of patches."""
    d = nearest(cells, "cell", ["x", "y"], 1, block).select(F.col("query").alias("cell"), F.col("distance").alias("d"))
    of = stage(cells.select("cell", *block).join(d, "cell"))
    stats = of.groupBy(*block).agg(F.avg("d").alias("mean"), F.min("d").alias("least"), F.max("d").alias("largest"))
    middle = quantiles(of, block, "d", {"median": 0.5})
    stats = stats.join(middle, block) if block else stats.crossJoin(middle)
    return stats.withColumn("context", F.bround(2 * F.col("mean"), 0).cast("int"))


def outliers(cells: DataFrame, block: list[str], k: int = 10, cutoff: float = 4.0) -> DataFrame:
    """(cell, mean_distance, z) of cells whose mean distance to k neighbours has a population z-score above the cutoff in the block."""
    d = nearest(cells, "cell", ["x", "y"], k, block).groupBy(F.col("query").alias("cell")).agg(F.avg("distance").alias("mean_distance"))
    placed = with_groups(d.join(cells.select("cell", *block), "cell"), block, F.avg("mean_distance").alias("_m"), F.stddev_pop("mean_distance").alias("_s"))
    z = (F.col("mean_distance") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s"))
    return placed.withColumn("z", z).filter(F.col("z") > cutoff).select("cell", "mean_distance", "z")


def bounds(cells: DataFrame, block: list[str], margin: float = 0.0) -> DataFrame:
    return cells.groupBy(*block).agg((F.min("x") - margin).alias("x_min"), (F.max("x") + margin).alias("x_max"), (F.min("y") - margin).alias("y_min"), (F.max("y") + margin).alias("y_max"))


def in_box(x_min, x_max, y_min, y_max, x: str = "x", y: str = "y") -> Column:
    """Inclusive on all sides."""
    return F.col(x).between(x_min, x_max) & F.col(y).between(y_min, y_max)


def in_roi(left, bottom, width, height, x: str = "x", y: str = "y") -> Column:
    """The same from a corner and the sizes."""
    return in_box(left, left + width, bottom, bottom + height, x, y)


def roi_of(vertices: DataFrame, by: list[str], extend: int = 100) -> DataFrame:
    """(left, bottom, width, height) around a polygon's vertices (x, y), cut to integers."""
    box = bounds(vertices, by)
    whole = lambda c: c.cast("int")
    sizes = [whole(F.col(f"{a}_max") - F.col(f"{a}_min") + 2 * extend) for a in "xy"]
    return box.select(*by, whole(F.col("x_min") - extend).alias("left"), whole(F.col("y_min") - extend).alias("bottom"), sizes[0].alias("width"), sizes[1].alias("height"))


def roi_ring(left: float, bottom: float, width: float, height: float) -> list[tuple[float, float]]:
    """The closed ring of a box."""
    return [(left, bottom), (left + width, bottom), (left + width, bottom + height), (left, bottom + height), (left, bottom)]


def tiles(cells: DataFrame, rows: int, columns: int, block: list[str]) -> DataFrame:
    """`cells` with (tile_row, tile_column) of an even division of the block's bounding box; a cell on a line between tiles or on the border has no tile."""
    box = bounds(cells, block)
    joined = cells.join(F.broadcast(box) if not block else box, block) if block else cells.crossJoin(F.broadcast(box))
    part = lambda c, n: (F.col(c) - F.col(f"{c}_min")) / F.when(F.col(f"{c}_max") > F.col(f"{c}_min"), F.col(f"{c}_max") - F.col(f"{c}_min")) * n
    px, py = part("x", columns), part("y", rows)
    inside = (px > 0) & (px < columns) & (px != F.floor(px)) & (py > 0) & (py < rows) & (py != F.floor(py))
    return joined.filter(inside).select(*cells.columns, F.floor(py).cast("int").alias("tile_row"), F.floor(px).cast("int").alias("tile_column"))


def _edges(ring: str) -> Column:
    """Edges of a closed ring given as an array of (x, y)."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))


def crossings(x: Column, y: Column, ring: str) -> Column:
    """Edges of the ring that a ray from the point towards larger x crosses; an odd number means inside."""
    hit = lambda e: ((e["y0"] > y) != (e["y1"] > y)) & (x < (e["x1"] - e["x0"]) * (y - e["y0"]) / F.when(e["y1"] != e["y0"], e["y1"] - e["y0"]) + e["x0"])
    return F.size(F.filter(_edges(ring), hit))


def edge_distance(x: Column, y: Column, ring: str) -> Column:
    """Distance of a point from the nearest edge of the ring."""

    def to(e: Column) -> Column:
        dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
        length = dx * dx + dy * dy
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["x0"]) * dx + (y - e["y0"]) * dy) / F.when(length > 0, length)))
        t = F.coalesce(t, F.lit(0.0))
        return (x - (e["x0"] + t * dx)) ** 2 + (y - (e["y0"] + t * dy)) ** 2

    return F.sqrt(F.array_min(F.transform(_edges(ring), to)))


def inside(x: Column, y: Column, ring: str) -> Column:
    """Strictly inside: points on the ring are out."""
    return (crossings(x, y, ring) % 2 == 1) & (edge_distance(x, y, ring) > 0)


def signed_distance(x: Column, y: Column, ring: str) -> Column:
    """Distance from the ring, negative inside."""
    d = edge_distance(x, y, ring)
    return F.when(crossings(x, y, ring) % 2 == 1, -d).otherwise(d)


def resampled(rings: DataFrame, by: list[str], points: int = 100) -> DataFrame:
    """(by..., k, x, y): evenly spaced points along each ring, from its first vertex to its last. rings: (by..., place, x, y)."""
    along = Window.partitionBy(*by).orderBy("place")
    step = F.sqrt((F.col("x") - F.lag("x").over(along)) ** 2 + (F.col("y") - F.lag("y").over(along)) ** 2)
    lengths = rings.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("s", F.sum("_step").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = lengths.select(*by, "x", "y", F.col("s").alias("s0"), F.lead("s").over(along).alias("s1"), F.lead("x").over(along).alias("x1"), F.lead("y").over(along).alias("y1"), (F.lead("place").over(along.orderBy("place"))).isNull().alias("last"))
    total = lengths.groupBy(*by).agg(F.max("s").alias("total"))
    grid = total.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("at", F.col("total") * F.col("k") / (points - 1))
    on = (F.col("at") >= F.col("s0")) & (F.col("at") < F.col("s1"))
    end = (F.col("k") == points - 1) & (F.col("s1") == F.col("total")) & (F.col("s1") > F.col("s0"))
    met = grid.join(pieces.filter("s1 > s0"), by).filter(on | end)
    share = (F.col("at") - F.col("s0")) / (F.col("s1") - F.col("s0"))
    found = met.select(*by, "k", (F.col("x") + (F.col("x1") - F.col("x")) * share).alias("x"), (F.col("y") + (F.col("y1") - F.col("y")) * share).alias("y"), "s0")
    return found.groupBy(*by, "k").agg(F.max_by("x", "s0").alias("x"), F.max_by("y", "s0").alias("y"))


def ring_index(distance: Column, start: float, end: float, width: float) -> Column:
    """Number of the ring of a signed distance: rings of the given width around start, start + width, ..., as many as cover the range; null outside."""
    n = ring_count(start, end, width)
    k = F.floor((distance - start) / width + 0.5)
    return F.when((k >= 0) & (k < n), k.cast("int"))


def ring_count(start: float, end: float, width: float) -> int:
    return math.ceil((end - start) / width)
