"""Polygons from drawing files: JSON shapes with SVG paths or rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuegrid.operators.spatial import resampled

_SHAPE = "struct<type: string, path: string, x0: double, y0: double, x1: double, y1: double>"


def clean_keys(m: Column) -> Column:
    """Keys of a map without what stands before their last dot. Two keys that become equal are an error of the map."""
    return F.transform_keys(m, lambda k, _: F.element_at(F.split(k, r"\."), -1))


def polygon_from_path(path: Column) -> Column:
    """Vertices (x, y) of `Mx,yLx,y...Z`, closed: the first vertex comes again at the end."""
    numbers = F.regexp_extract_all(path, F.lit(r"([-+0-9.eE]+),([-+0-9.eE]+)"), F.lit(0))
    points = F.transform(numbers, lambda p: F.struct(F.split(p, ",")[0].try_cast("double").alias("x"), F.split(p, ",")[1].try_cast("double").alias("y")))
    return F.when(F.size(points) > 0, F.concat(points, F.slice(points, 1, 1)))


def polygon_from_rect(shape: Column) -> Column:
    """Five vertices of a rectangle; null where a corner is missing."""
    corner = lambda x, y: F.struct(shape[x].alias("x"), shape[y].alias("y"))
    whole = shape["x0"].isNotNull() & shape["x1"].isNotNull() & shape["y0"].isNotNull() & shape["y1"].isNotNull()
    return F.when(whole, F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0")))


def polygons(df: DataFrame, json: str, scale: float = 1.0) -> DataFrame:
    """`df` without the JSON, with one row (place, ring) a shape that is a path or a rectangle; coordinates are divided by the scale.

    Both forms of the file are read: {"shapes": [{"type": ..., "path": ...}, ...]}, and one edited shape with keys such as "shapes[0].path". A
    text that is no such JSON gives no rows.
    """
    listed = F.from_json(json, f"struct<shapes: array<{_SHAPE}>>")["shapes"]
    edited = clean_keys(F.from_json(json, "map<string, string>"))
    one = F.struct(F.lit(None).cast("string").alias("type"), F.try_element_at(edited, F.lit("path")).alias("path"), *(F.try_element_at(edited, F.lit(k)).try_cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")))
    shapes = F.coalesce(listed, F.array(one))
    rows = df.withColumn("_shapes", shapes).select(*[c for c in df.columns if c != json], F.posexplode("_shapes").alias("place", "_shape"))
    ring = F.coalesce(polygon_from_path(F.col("_shape.path")), polygon_from_rect(F.col("_shape")))
    scaled = F.transform(ring, lambda p: F.struct((p["x"] / scale).alias("x"), (p["y"] / scale).alias("y")))
    return rows.withColumn("ring", scaled).filter("ring is not null").drop("_shape")


def first_polygon(df: DataFrame, json: str, by: list[str], points: int = 100, scale: float = 1.0) -> DataFrame:
    """(by..., k, x, y): the first path or rectangle of each drawing as evenly spaced points along it. A drawing without one has no rows."""
    rings = polygons(df.select(*by, json), json, scale)
    first = rings.groupBy(*by).agg(F.min_by("ring", "place").alias("ring"))
    return resampled(first.select(*by, F.posexplode("ring").alias("place", "p")).select(*by, "place", "p.x", "p.y"), by, points)
