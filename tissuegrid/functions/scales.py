"""Small expressions over scale factors, names and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Diameter of a capture spot.
SPOT_MICRONS = 65.0


def microns_per_pixel(spot_diameter: Column, scale: Column | None = None, microns: float = SPOT_MICRONS) -> Column:
    """Size of a pixel of the full image, or of one scaled down by `scale`; null where the diameter is missing."""
    known = F.when(~F.isnan(spot_diameter) & (spot_diameter > 0), spot_diameter)
    return microns / known / (F.lit(1.0) if scale is None else F.when(~F.isnan(scale) & (scale > 0), scale))


def in_order_of(names: Column, reference: Column) -> Column:
    """Names that the reference list has, in its order; the whole reference where it has none of them."""
    kept = F.filter(reference, lambda n: F.array_contains(names, n))
    return F.when(F.size(kept) > 0, kept).otherwise(reference)


def without(a: Column, b: Column) -> Column:
    """Elements of the first list that the second lacks, each once, in order."""
    return F.array_except(a, b)


def flattened(lists: Column) -> Column:
    """Distinct elements of a list of lists."""
    return F.array_distinct(F.flatten(lists))


def with_symbols(df: DataFrame, gene: str, symbols: DataFrame, symbol: str = "symbol") -> DataFrame:
    """`df` with the symbol of each gene, the identifier where there is none. symbols: (gene, symbol), one row a gene."""
    found = df.join(symbols.select(F.col("gene").alias("_gene"), F.col("symbol").alias("_symbol")), F.col(gene) == F.col("_gene"), "left")
    return found.withColumn(symbol, F.coalesce("_symbol", F.col(gene).cast("string"))).drop("_gene", "_symbol")


def pathway_columns(names: list[str]) -> list[str]:
    """Column names of more than two parts between dashes, without the last, which is the total."""
    return [n for n in names if len(n.split("-")) > 2][:-1]
