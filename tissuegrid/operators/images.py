"""Images as tables of pixels (image..., row, col, label, gray...); pixels of the background are absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissuegrid.common import quantiles, stage, with_groups
from tissuegrid.operators.spatial import context_sizes, nearest_spot, outliers


def centroids(pixels: DataFrame, by: list[str]) -> DataFrame:
    """(by..., label, x, y, pixels): mean column and row of each label above 0."""
    return pixels.filter("label > 0").groupBy(*by, "label").agg(F.avg("col").alias("x"), F.avg("row").alias("y"), F.count("*").alias("pixels"))


def pixel_lists(pixels: DataFrame, by: list[str], cells: DataFrame) -> DataFrame:
    """(by..., label, pixels): the pixels of each cell in order; an empty list where it has none. cells: (by..., label)."""
    lists = pixels.filter("label > 0").groupBy(*by, "label").agg(F.array_sort(F.collect_list(F.struct("row", "col"))).alias("pixels"))
    return cells.select(*by, "label").join(lists, [*by, "label"], "left").withColumn("pixels", F.coalesce("pixels", F.array()))


def patches(cells: DataFrame, pixels: DataFrame, half: int, by: list[str]) -> DataFrame:
    """Pixels within [x - half, x + half) and [y - half, y + half) of each cell's truncated centre, by an equality join on squares as wide as the patch.

    cells: (by..., cell, x, y); pixels keep their columns.
    """
    side = 2 * half
    c = cells.select(*by, "cell", F.col("x").cast("int").alias("_x"), F.col("y").cast("int").alias("_y"))
    corners = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (0, 1) for q in (0, 1)))
    first = lambda v: F.floor((F.col(v) - half) / side)
    c = c.withColumn("_s", F.explode(corners)).withColumns({"_gx": first("_x") + F.col("_s.p"), "_gy": first("_y") + F.col("_s.q")}).drop("_s")
    placed = pixels.withColumns({"_gx": F.floor(F.col("col") / side), "_gy": F.floor(F.col("row") / side)})
    met = placed.join(c, [*by, "_gx", "_gy"])
    inside = (F.col("col") >= F.col("_x") - half) & (F.col("col") < F.col("_x") + half) & (F.col("row") >= F.col("_y") - half) & (F.col("row") < F.col("_y") + half)
    return met.filter(inside).drop("_gx", "_gy", "_x", "_y")


def patch_stats(patch_pixels: DataFrame, by: list[str], channels: list[str]) -> DataFrame:
    """Mean and population deviation of each channel by cell."""
    return patch_pixels.groupBy(*by, "cell").agg(*(f(c).alias(f"{n}_{c}") for c in channels for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def patch_entropy(patch_pixels: DataFrame, by: list[str], gray: str = "gray") -> DataFrame:
    """Entropy in bits of the gray levels of each cell's patch; each distinct level is counted once before the sum."""
    counts = patch_pixels.groupBy(*by, "cell", gray).agg(F.count("*").alias("n"))
    sums = counts.groupBy(*by, "cell").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("l"))
    return sums.select(*by, "cell", (F.log2(F.col("t").cast("double")) - F.col("l") / F.col("t")).alias("entropy"))


def cell_features(pixels: DataFrame, by: list[str], channels: list[str], least: int = 10) -> DataFrame:
    """Image features of the labelled pixels: centres without outliers, the patch size from nearest-neighbour distances, statistics of each patch.

    Outliers are looked for only in images of more than `least` cells, and by the distance of ten neighbours; the patch is as wide as twice the mean
    nearest-neighbour distance over all images, rounded.
    """
    cells = stage(centroids(pixels, by).select(*by, F.col("label").alias("cell"), "x", "y"))
    many = cells.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > least).select(*by)
    odd = outliers(cells.join(many, by), by)
    cells = stage(cells.join(odd.select("cell"), "cell", "left_anti"))
    half = context_sizes(cells, by).agg(F.avg("mean").alias("m")).first()["m"]  # one number
    parts = stage(patches(cells, pixels, max(1, round(half or 1)), by))
    return cells.join(patch_stats(parts, by, channels), [*by, "cell"]).join(patch_entropy(parts, by, channels[0]), [*by, "cell"])


def nearest_cell(pixels: DataFrame, cells: DataFrame, reach: float, by: list[str]) -> DataFrame:
    """(pixel, cell, d): the nearest cell of each pixel within reach, a raster of the cells' territories. pixels: (pixel, by..., row, col); cells: (cell, by..., x, y)."""
    at = pixels.select(F.col("pixel").alias("cell"), *by, F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    found = nearest_spot(at, cells.select(F.col("cell").alias("spot"), *by, "x", "y"), reach, by)
    return found.select(F.col("cell").alias("pixel"), F.col("spot").alias("cell"), "d")


def painted(pixels: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """(by..., row, col, value): each labelled pixel with its cell's value; pixels of cells without one stay out. values: (by..., label, value)."""
    return pixels.filter("label > 0").join(values.select(*by, "label", "value"), [*by, "label"]).select(*by, "row", "col", "value")


def at_least(paint: DataFrame, least: float, strict: bool = False, unify: bool = True) -> DataFrame:
    """Painted pixels from the threshold on, or above it if strict; unify: with the value 1. Null values stay out, and NaN counts as largest."""
    kept = paint.filter(F.col("value") > least if strict else F.col("value") >= least)
    return kept.withColumn("value", F.lit(1.0)) if unify else kept


def sampled_painting(pixels: DataFrame, values: DataFrame, by: list[str], more: float = 2.0, seed: int = 0) -> DataFrame:
    """(by..., gene, label, row, col, value): a share of each cell's pixels for each gene, `more` times the place of its value in the gene's range within `by`, at most all.

    values: (by..., label, gene, value) without nulls. A gene of one value paints all pixels, or none where it is 0. Draws depend on the seed and the pixel.
    """
    sizes = pixels.filter("label > 0").groupBy(*by, "label").agg(F.count("*").alias("_size"))
    ranged = with_groups(values, [*by, "gene"], F.min("value").alias("_l"), F.max("value").alias("_u"))
    place = F.when(F.col("_u") > F.col("_l"), (F.col("value") - F.col("_l")) / (F.col("_u") - F.col("_l")))
    share = F.least(F.coalesce(place, F.when(F.col("_u") == 0, 0.0).otherwise(1.0)) * more, F.lit(1.0))
    wanted = ranged.join(sizes, [*by, "label"]).withColumn("_n", F.floor(F.col("_size") * share)).filter("_n > 0")
    drawn = pixels.select(*by, "label", "row", "col").join(wanted.select(*by, "label", "gene", "value", "_n"), [*by, "label"])
    order = F.row_number().over(Window.partitionBy(*by, "label", "gene").orderBy(F.xxhash64(F.lit(seed), "gene", "row", "col"), "row", "col"))  # a cell's pixels
    return drawn.withColumn("_o", order).filter("_o <= _n").select(*by, "gene", "label", "row", "col", "value")


def only_cytoplasm(cell_pixels: DataFrame, nucleus_pixels: DataFrame, by: list[str]) -> DataFrame:
    """Pixels of cells that no nucleus covers."""
    return cell_pixels.filter("label > 0").join(nucleus_pixels.filter("label > 0"), [*by, "row", "col"], "left_anti")


def color_limit(setting: float | str | None, values: DataFrame, value: str, low: bool) -> float:
    """End of a colour range: the data's own for None, a percentile for `pNN`, else the number within the data's range."""
    ends = values.agg(F.min(value).alias("l"), F.max(value).alias("u")).first()
    if setting is None:
        return ends["l"] if low else ends["u"]
    if isinstance(setting, str):
        return quantiles(values, [], value, {"q": float(setting.lstrip("p")) / 100}).first()["q"]
    return min(max(setting, ends["l"]), ends["u"])


def limits(values: DataFrame, by: list[str], value: str, low: float, high: float) -> DataFrame:
    """(by..., vmin, vmax) as percentiles of each group."""
    return quantiles(values, by, value, {"vmin": low, "vmax": high})


def sampled(pixels: DataFrame, share: Column, key: list[str], seed: int) -> DataFrame:
    """Pixels drawn with a probability of their own, the same in each run."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return pixels.filter(u < share)
