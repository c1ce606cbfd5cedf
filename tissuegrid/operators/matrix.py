"""Matrices as tables: wide columns of features, or (row, gene, value) entries whose zeros are absent."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuegrid.common import ordinals, quantiles, stage, union, with_groups


def standardize(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(v - mean) / population deviation of each column, within groups; a constant column becomes 0. Null values stay null."""
    stats = [f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return with_groups(df, list(by), *stats).withColumns(scaled).select(*df.columns)


def minmax(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(v - min) / (max - min); a constant column becomes 0."""
    stats = [f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("l", F.min), ("u", F.max))]
    width = lambda c: F.col(f"_u_{c}") - F.col(f"_l_{c}")
    scaled = {c: (F.col(c) - F.col(f"_l_{c}")) / F.when(width(c) > 0, width(c)).otherwise(1.0) for c in columns}
    return with_groups(df, list(by), *stats).withColumns(scaled).select(*df.columns)


def quantile_range(df: DataFrame, column: str, by: Sequence[str], low: float, high: float, names: tuple[str, str] = ("ql", "qu")) -> DataFrame:
    """Two exact quantiles of each group, linearly interpolated."""
    return quantiles(df, list(by), column, {names[0]: low, names[1]: high})


def robust_scaled(v: Column, low: Column, high: Column) -> Column:
    """The quantile range becomes -1 to 1; where it is empty, the distance from it."""
    return F.when(low == high, v - high).otherwise((v - low) / F.when(low == high, F.lit(1.0)).otherwise(high - low) * 2 - 1)


def robust_restored(t: Column, low: Column, high: Column) -> Column:
    """The way back into a range; an empty range gives its one value."""
    return 0.5 * (t + 1) * (high - low) + low


def normalized(entries: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Entries over the sum of absolute values of their row (or gene): 0 where that is 0."""
    total = with_groups(entries, [by], F.sum(F.abs(value)).alias("_total"))
    return total.withColumn(value, F.when(F.col("_total") > 0, F.col(value) / F.col("_total")).otherwise(0.0)).select(*entries.columns)


def log_normalized(entries: DataFrame, row: str, value: str = "value", target: float | None = None) -> DataFrame:
    """ln(1 + v / row total * target); the target is the median of the positive row totals if not given."""
    totals = entries.groupBy(row).agg(F.sum(value).alias("_total")).filter("_total > 0")
    goal = quantiles(totals, [], "_total", {"_goal": 0.5}) if target is None else totals.agg(F.lit(float(target)).alias("_goal"))
    scaled = entries.join(totals, row).crossJoin(F.broadcast(goal))
    return scaled.withColumn(value, F.log1p(F.col(value) / F.col("_total") * F.col("_goal"))).select(*entries.columns)


def scaled_genes(entries: DataFrame, gene: str, rows: int, limit: float, value: str = "value") -> DataFrame:
    """Stored entries as z-scores with the sample deviation over all `rows` rows, absent zeros included, clipped above at `limit`."""
    s, q = F.sum(value).alias("_s"), F.sum(F.col(value) ** 2).alias("_q")
    mean = F.col("_s") / rows
    deviation = F.sqrt(F.greatest((F.col("_q") - rows * mean * mean) / (rows - 1), F.lit(0.0)))
    z = (F.col(value) - mean) / F.when(deviation > 0, deviation).otherwise(1.0)
    return with_groups(entries, [gene], s, q).withColumn(value, F.least(z, F.lit(float(limit)))).select(*entries.columns)


def sparsity(entries: DataFrame, row: str, gene: str) -> DataFrame:
    """One row (rows, genes, stored, sparsity) of the matrix spanned by the rows and genes that occur."""
    sizes = entries.agg(F.count_distinct(row).alias("rows"), F.count_distinct(gene).alias("genes"), F.count("*").alias("stored"))
    return sizes.withColumn("sparsity", 1 - F.col("stored") / (F.col("rows") * F.col("genes")))


def dropout_ratio(entries: DataFrame, gene: str, rows: int, value: str = "value") -> DataFrame:
    """Share of zeros of each gene among `rows` rows."""
    return entries.groupBy(gene).agg((1 - F.count_if(F.col(value) != 0) / rows).alias("dropout"))


def divided(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """a / b on the entries that b has (not 0); 0 where a has none."""
    right = b.filter(F.col(value) != 0).withColumnRenamed(value, "_b")
    return right.join(a, keys, "left").select(*keys, (F.coalesce(F.col(value), F.lit(0.0)) / F.col("_b")).alias(value))


def cosine(a: DataFrame, b: DataFrame, row: str, gene: str, value: str = "value") -> DataFrame:
    """Cosine of each gene's columns in two matrices; absent entries are 0, a zero column gives null."""
    both = a.withColumnRenamed(value, "_a").join(b.withColumnRenamed(value, "_b"), [row, gene], "full")
    x, y = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    sums = both.groupBy(gene).agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    return sums.select(gene, F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("cosine"))


def relative_distance(a: DataFrame, b: DataFrame, row: str, gene: str, value: str = "value") -> DataFrame:
    """|a - b| / |a| of each gene."""
    both = a.withColumnRenamed(value, "_a").join(b.withColumnRenamed(value, "_b"), [row, gene], "full")
    x, y = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    return both.groupBy(gene).agg(F.try_divide(F.sqrt(F.sum((x - y) ** 2)), F.sqrt(F.sum(x * x))).alias("distance"))


def error_share(a: DataFrame, b: DataFrame, row: str, gene: str, rows: int, value: str = "value") -> DataFrame:
    """Root mean square error of b over the mean of a, by gene, over `rows` rows."""
    both = a.withColumnRenamed(value, "_a").join(b.withColumnRenamed(value, "_b"), [row, gene], "full")
    x, y = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    return both.groupBy(gene).agg(F.try_divide(F.sqrt(F.sum((x - y) ** 2) / rows), F.sum(x) / rows).alias("cv"))


def blocks_joined(gene_block: DataFrame, reduced_block: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Two blocks of results on one gene axis; where both have an entry, the gene block's holds."""
    both = reduced_block.withColumnRenamed(value, "_r").join(gene_block.withColumnRenamed(value, "_g"), keys, "full")
    return both.select(*keys, F.coalesce("_g", "_r").alias(value))


def residuals(entries: DataFrame, row: str, gene: str, value: str = "value") -> DataFrame:
    """Residuals of each gene's stored entries after a linear fit on the logarithm of the row totals."""
    with_t = with_groups(entries, [row], F.log(F.sum(value)).alias("_t"))
    fit = with_groups(with_t, [gene], F.regr_slope(value, "_t").alias("_k"), F.regr_intercept(value, "_t").alias("_c"))
    return fit.withColumn(value, F.col(value) - (F.col("_c") + F.col("_k") * F.col("_t"))).select(*entries.columns)


def stabilized_variance(entries: DataFrame, gene: str, rows: int, value: str = "value") -> DataFrame:
    """ln(v + 1 / (2 phi)) with the least-squares phi of variance = mean + phi mean^2 over the genes, zeros included in the moments."""
    moments = entries.groupBy(gene).agg((F.sum(value) / rows).alias("m"), ((F.sum(F.col(value) ** 2) - F.sum(value) ** 2 / rows) / (rows - 1)).alias("s2"))
    phi = moments.agg((F.sum((F.col("s2") - F.col("m")) * F.col("m") ** 2) / F.sum(F.col("m") ** 4)).alias("_phi"))
    return entries.crossJoin(F.broadcast(phi)).withColumn(value, F.log(F.col(value) + 1 / (2 * F.col("_phi")))).select(*entries.columns)


def pearson_with_group(df: DataFrame, id: str, columns: Sequence[str], member: Column) -> DataFrame:
    """(id, r): mean correlation of each row's vector with the vectors of the rows for which `member` holds.

    A mean of correlations is the dot product with the mean of the members' unit vectors, so one row of sums replaces all pairs.
    A constant vector correlates with nothing (null), and doesn't count among the members.
    """
    n = len(columns)
    mean = sum(F.col(c) for c in columns) / n
    centred = df.select(id, F.coalesce(member, F.lit(False)).alias("_in"), *(F.col(c) - mean for c in columns)).toDF(id, "_in", *columns)
    norm = F.sqrt(sum(F.col(c) ** 2 for c in columns))
    unit = centred.withColumn("_norm", norm).select(id, "_in", *(F.try_divide(F.col(c), F.when(F.col("_norm") > 0, F.col("_norm"))).alias(c) for c in columns))
    goal = unit.filter("_in").agg(*(F.avg(c).alias(f"_g{c}") for c in columns))
    return unit.crossJoin(F.broadcast(goal)).select(id, sum(F.col(c) * F.col(f"_g{c}") for c in columns).alias("r"))


def component_scores(df: DataFrame, id: str, columns: Sequence[str], k: int) -> DataFrame:
    """Principal components of the centred columns: (id, pc1..pck); the loading of largest size of each component is positive."""
    from pyspark.ml.feature import PCA, VectorAssembler

    centred = standardize_mean(df, columns)
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(centred)
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] > 0 else -1.0 for j in range(k)]
    return centred.select(id, *(sum(F.col(c) * float(loadings[i, j] * signs[j]) for i, c in enumerate(columns)).alias(f"pc{j + 1}") for j in range(k)))


def standardize_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    means = df.agg(*(F.avg(c).alias(f"_m{c}") for c in columns))
    return df.crossJoin(F.broadcast(means)).withColumns({c: F.col(c) - F.col(f"_m{c}") for c in columns}).select(*df.columns)


def entry_components(entries: DataFrame, row: str, k: int) -> DataFrame:
    """Principal components of entries (row, gene, value), absent ones being 0: (row, pc1..pck) of the centred columns; the loading of largest size is positive.

    A row is one vector of all genes; the covariance of the genes is summed up over the rows. Up to 65,535 genes. Fewer than k genes or no rows are an error.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    genes = stage(ordinals(entries.select("gene").distinct(), [], ["gene"], "_at"))
    n = genes.count()
    listed = entries.join(genes, "gene").groupBy(row).agg(F.collect_list("_at").alias("_at"), F.collect_list("value").alias("_v"))  # a row's genes

    def run(batches):
        for batch in batches:
            for part in (batch.slice(lo, 256) for lo in range(0, batch.num_rows, 256)):
                full = np.zeros((part.num_rows, n))
                at, v = part.column("_at"), part.column("_v")
                of = np.repeat(np.arange(part.num_rows), np.diff(at.offsets.to_numpy()))
                full[of, at.flatten().to_numpy()] = v.flatten().to_numpy(zero_copy_only=False)
                ends = pa.array(np.arange(0, full.size + 1, n, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(row), pa.ListArray.from_arrays(ends, pa.array(full.reshape(-1)))], [row, "_x"])

    kind = entries.schema[row].dataType.simpleString()
    vectors = stage(listed.mapInArrow(run, f"`{row}` {kind}, _x array<double>")).select(row, array_to_vector("_x").alias("_x"))
    model = PCA(k=k, inputCol="_x", outputCol="_p").fit(vectors)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] > 0 else -1.0 for j in range(k)]
    parts = model.transform(vectors).select(row, vector_to_array("_p").alias("_p")).select(row, *((F.col("_p")[j] * signs[j]).alias(f"pc{j + 1}") for j in range(k)))
    return standardize_mean(stage(parts), [f"pc{j + 1}" for j in range(k)])


def integrated(parts: dict[str, DataFrame], k: int, target: float = 10_000.0) -> DataFrame:
    """(source, cell, pc1..pck) of several matrices on their common genes: clipped at 0, log-normalised, put together, reduced."""
    genes = None
    for df in parts.values():
        genes = df.select("gene").distinct() if genes is None else genes.intersect(df.select("gene"))
    genes, frames = stage(genes), []
    for source, df in parts.items():
        kept = df.join(genes, "gene").withColumn("value", F.greatest("value", F.lit(0.0)))
        frames.append(log_normalized(kept, "cell", target=target).withColumn("source", F.lit(source)))
    both = stage(union(frames).withColumn("key", F.concat_ws(":", "source", F.col("cell").cast("string"))))
    scores = entry_components(both.select("key", "gene", "value"), "key", k)
    return both.select("key", "source", "cell").distinct().join(scores, "key").drop("key")


def bisecting(df: DataFrame, id: str, columns: Sequence[str], k: int, seed: int = 1) -> DataFrame:
    """(id, cluster) of a divisive hierarchy cut at k clusters."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(df)
    return BisectingKMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(vectors).transform(vectors).select(id, "cluster")


def k_means(df: DataFrame, id: str, columns: Sequence[str], k: int, seed: int = 1) -> DataFrame:
    """(id, cluster) of k-means over the columns."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(df)
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(vectors).transform(vectors).select(id, "cluster")



def masked(entries: DataFrame, mask: Column) -> DataFrame:
    """Entries without those that the mask names, and without stored zeros. A null mask keeps the entry."""
    return entries.filter(~F.coalesce(mask, F.lit(False)) & (F.col("value") != 0))


def stored(rows: DataFrame, cell: str, columns: list[str]) -> DataFrame:
    """(cell, gene, value) of a dense table: one entry for each value that is neither null nor 0."""
    return rows.unpivot(cell, [F.col(c) for c in columns], "gene", "value").withColumnRenamed(cell, "cell").filter("value <> 0")
