"""Diffusion of expression over a transition table, with the anti-shrinking step, on entries (cell, gene, value) without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuegrid.common import discard, stage, with_groups
from tissuegrid.operators import blocks


def step(entries: DataFrame, transition: DataFrame) -> DataFrame:
    """One product of the transition table with stored entries. For many products use `diffuse`, which moves blocks of genes."""
    met = transition.join(entries.withColumnRenamed("cell", "src"), "src")
    return met.groupBy(F.col("dst").alias("cell"), "gene").agg(F.sum(F.col("t") * F.col("value")).alias("value"))


def stabilize(new: DataFrame, reference: DataFrame) -> DataFrame:
    """Give each gene of `new` the spread of `reference`: both are scaled by their quantile ranges, values of one rank are averaged, and the result
    is put back into the reference's range. Ranks stay; tied values get the mean of their targets. Both must have the same cells and genes; an absent entry is 0.

    The range is from the quantile 5 / n to 1 - 5 / n over n cells, or the extremes of up to 10 cells. A gene whose range is empty in the reference becomes
    that one value. Without cells or genes the result is empty.
    """
    genes, n_genes = blocks.genes_of(reference)
    tiles = blocks.tiles_of(reference.select("cell"))
    if not n_genes or not tiles.n:
        return reference.limit(0).select("cell", "gene", F.col("value").cast("double").alias("value"))
    a, b = (stage(blocks.runs_of(x, genes, n_genes, tiles)) for x in (new, reference))
    done = blocks.aligned(a, blocks.sorted_runs(b, tiles.n), tiles.n)
    return blocks.entries_of(blocks.packed(a, blocks.targets(done), tiles, n_genes), genes)


def diffuse(entries: DataFrame, transition: DataFrame, iterations: int, frames: list[int] = [], stabilized: bool = True, spot_of: DataFrame | None = None, keep: float = 0.8, near: DataFrame | None = None) -> dict[int, DataFrame]:  # noqa: B006
    """Iterate the product with the transition table; each result is stabilised against the iteration before. Frames asked for (the last if none) by
    iteration, as entries of every row of the table and every gene, zeros included.

    entries: (cell, gene, value), absent ones being 0; cells that are no row of the table drop out. spot_of: (cell, spot); then the last iteration is
    rescaled towards the first one's spot means. near: (cell, keys...) that put related cells together (see `blocks.tiles_of`). Every iteration is
    written to the shared folder, so that plans stay short and a lost executor costs one iteration, and the one before is deleted.
    """
    transition = stage(transition)
    genes, n_genes = blocks.genes_of(entries)
    tiles = blocks.tiles_of(entries, near, transition)
    wanted = set(frames or [iterations])
    if not n_genes or not tiles.n:
        return {k: entries.limit(0).select("cell", "gene", F.col("value").cast("double").alias("value")) for k in wanted}
    runs = stage(blocks.runs_of(entries, genes, n_genes, tiles))
    goal = blocks.aligned_start(runs, tiles.n) if stabilized else None
    first, out = None, {}
    for k in range(1, iterations + 1):
        source = blocks.packed(runs, blocks.targets(goal) if goal is not None and k > 1 else None, tiles, n_genes)
        after = stage(blocks.multiplied(source, tiles, n_genes))
        reached = blocks.aligned(after, blocks.order(goal), tiles.n) if stabilized else None
        if goal is not None:
            discard(goal)
        discard(runs)
        runs, goal = after, reached
        if k in wanted or (spot_of is not None and k in (1, iterations)):
            rows = stage(blocks.packed(runs, blocks.targets(goal) if stabilized else None, tiles, n_genes))
            first = rows if k == 1 else first
            values = blocks.entries_of(rows, genes)
            if k == iterations and spot_of is not None:
                values = stage(rescale_mean(values, blocks.entries_of(first, genes), spot_of, keep))
            if k in wanted:
                out[k] = values
    discard(runs, *([goal] if goal is not None else []), tiles.edges, tiles.links, transition)
    return out


def frames_to_write(iterations: int, every: int) -> list[int]:
    """The iterations that are kept: every `every`-th."""
    return list(range(every, iterations + 1, every))


def rescale_mean(entries: DataFrame, reference: DataFrame, spot_of: DataFrame, scale: float = 0.8) -> DataFrame:
    """x - scale (mean of x over the spot - reference)."""
    placed = entries.join(spot_of, "cell")
    mean = with_groups(placed, ["spot", "gene"], F.avg("value").alias("_mean"))
    ref = reference.select("cell", "gene", F.col("value").alias("_ref"))
    return mean.join(ref, ["cell", "gene"]).select("cell", "gene", (F.col("value") - scale * (F.col("_mean") - F.col("_ref"))).alias("value"))


def neighbour_stats(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """(cell, gene, mean, std) over the neighbours of a cell, by edge weight; rounding never makes the variance negative."""
    met = edges.select(F.col("i").alias("cell"), "j", "w").join(entries.select(F.col("cell").alias("j"), "gene", "value"), "j")
    sums = met.groupBy("cell", "gene").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("value")).alias("s"), F.sum(F.col("w") * F.col("value") ** 2).alias("q"))
    mean = F.col("s") / F.col("w")
    return sums.select("cell", "gene", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("w") - mean * mean, F.lit(0.0))).alias("std"))


def smooth(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean over a cell and its neighbours; edges (i, j) need no weights."""
    own = entries.select(F.col("cell").alias("i"), F.col("cell").alias("j")).distinct()
    met = edges.select("i", "j").unionByName(own).join(entries.withColumnRenamed("cell", "j"), "j")
    return met.groupBy(F.col("i").alias("cell"), "gene").agg(F.avg("value").alias("value"))


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in (0, 1) that depends on the seed and the keys only, whatever the partitions are."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal number of the seed and the keys."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(6.283185307179586 * uniform(seed + 1_000_003, *keys))


def sample(entries: DataFrame, edges: DataFrame, seed: int, scale: float = 1.0, steps: int = 1) -> DataFrame:
    """A draw for each entry from the mean and deviation of its neighbours, the noise averaged over `steps` draws; negative values become 0."""
    noise = sum(normal(seed + k, "cell", "gene") for k in range(steps)) / steps
    return neighbour_stats(entries, edges).select("cell", "gene", F.greatest(F.col("mean") + F.col("std") * noise * scale, F.lit(0.0)).alias("value"))

