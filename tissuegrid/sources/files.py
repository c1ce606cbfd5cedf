"""Readers and writers of the files that cell-level analyses exchange."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tissuegrid.common import ordinals, stage
from tissuegrid.params import Params


def read_features(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """CSV of cell features with a header whose first column is the label: (label, x, y, names...), read by the given schema without a scan."""
    schema = "label long, x double, y double" + "".join(f", `{n}` double" for n in names)
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def join_external(features: DataFrame, external: DataFrame, key: str = "label") -> DataFrame:
    """All rows of `features` with the columns of `external` beside them; a name both have gets the suffixes _default and _external."""
    both = [c for c in features.columns if c in external.columns and c != key]
    a = features.withColumnsRenamed({c: f"{c}_default" for c in both})
    return a.join(external.withColumnsRenamed({c: f"{c}_external" for c in both}), key, "left")


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """A file of one name a line without header; blank lines don't count."""
    return spark.read.text(path).select(F.trim("value").alias("gene")).filter("gene <> ''")


def read_cell_list(spark: SparkSession, path: str) -> DataFrame:
    """(cell) of a file without header: what stands before the first tab of each line; lines with nothing there don't count, repeated cells stay."""
    return spark.read.text(path).select(F.split("value", "\t")[0].alias("cell")).filter("cell <> ''")


def read_nuclei(spark: SparkSession, path: str) -> DataFrame:
    """(label, x, y) of a table of segmented objects."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.col("ObjectNumber").cast("long").alias("label"), F.col("AreaShape_Center_X").cast("double").alias("x"), F.col("AreaShape_Center_Y").cast("double").alias("y"))


def read_wide(spark: SparkSession, path: str, keys: int, row: str = "cell", value: str = "value") -> DataFrame:
    """A tab-separated table of some key columns and one column a cell, as (keys..., cell, value)."""
    wide = spark.read.csv(path, sep="\t", header=True)
    names = wide.columns
    numbers = wide.select(*names[:keys], *(F.col(f"`{c}`").try_cast("double").alias(c) for c in names[keys:]))
    return numbers.unpivot(names[:keys], [F.col(f"`{c}`") for c in names[keys:]], row, value)


def write_wide(entries: DataFrame, path: str, keys: list[str], cells: list[str], row: str = "cell", value: str = "value") -> None:
    """The way back, for a bounded list of cells."""
    entries.groupBy(*keys).pivot(row, cells).agg(F.first(value)).write.csv(path, sep="\t", header=True)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(file, cell_id, cell_type) of prediction files: their first line is a header whatever it says, and lines without two fields don't count."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="", schema="cell_id string, cell_type string")
    return rows.select(F.col("_metadata.file_path").alias("file"), "cell_id", "cell_type").filter("cell_type is not null")


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.select("cell_id", "cell_type").write.csv(path, sep="\t", header=True)


def write_matrix_market(entries: DataFrame, folder: str) -> None:
    """Folders matrix, genes and barcodes of text: coordinates from 1 in the order of the gene and cell names, the matrix after its two header lines.

    The header is the first part file by its order; concatenating the parts in order gives one file.
    """
    genes = stage(ordinals(entries.select("gene").distinct(), [], ["gene"], "g"))
    cells = stage(ordinals(entries.select("cell").distinct(), [], ["cell"], "c"))
    stored = stage(entries.filter("value <> 0"))
    sizes = f"{genes.count()} {cells.count()} {stored.count()}"
    body = stored.join(genes, "gene").join(cells, "cell").select(F.lit(1).alias("o"), (F.col("c") + 1).alias("c"), (F.col("g") + 1).alias("g"), F.concat_ws(" ", (F.col("g") + 1).cast("string"), (F.col("c") + 1).cast("string"), F.col("value").cast("string")).alias("value"))
    head = entries.sparkSession.createDataFrame([(0, 0, 0, "%%MatrixMarket matrix coordinate real general"), (0, 0, 1, sizes)], body.schema)
    head.unionByName(body).orderBy("o", "c", "g").select("value").write.text(f"{folder}/matrix")
    genes.orderBy("g").select(F.col("gene").cast("string")).write.text(f"{folder}/genes")
    cells.orderBy("c").select(F.col("cell").cast("string")).write.text(f"{folder}/barcodes")


def read_matrix_market(spark: SparkSession, folder: str) -> DataFrame:
    """(g, c, value) with coordinates from 1; entries without a value, as patterns have them, count as 1.

    The line of sizes is the first line of the first file that is no comment; it alone is left out, whatever stands in it.
    """
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")).filter(~F.startswith("value", F.lit("%")) & (F.trim("value") != ""))
    first = lines.agg(F.min(F.struct("file", "at")).alias("f"), F.count("*").alias("n")).first()
    if not first["n"]:
        return spark.createDataFrame([], "g long, c long, value double")
    leading = (F.col("file") == first["f"]["file"]) & (F.col("at") == first["f"]["at"])
    # Lines of one split keep their order; only those of the first one are numbered.
    head = lines.filter(leading).withColumn("o", F.monotonically_increasing_id())
    head = head.withColumn("o", F.row_number().over(Window.orderBy("o"))).filter("o > 1").select("value")
    part = F.split(F.trim("value"), r"\s+")
    return lines.filter(~leading).select("value").unionByName(head).select(part[0].cast("long").alias("g"), part[1].cast("long").alias("c"), F.coalesce(F.get(part, 2).cast("double"), F.lit(1.0)).alias("value"))


def write_frames(frames: dict[int, DataFrame], path: str) -> None:
    """Diffused expression by iteration, as a table partitioned by it."""
    for k, df in sorted(frames.items()):
        df.withColumn("iteration", F.lit(k)).write.mode("append").partitionBy("iteration").parquet(path)


def read_frame(spark: SparkSession, path: str, iteration: int) -> DataFrame:
    """One iteration; the others' files are not opened."""
    return spark.read.parquet(path).filter(F.col("iteration") == iteration).drop("iteration")


def read_params(spark: SparkSession, path: str) -> Params:
    return Params.from_json("\n".join(r["value"] for r in spark.read.text(path).collect()))  # a small file of settings


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, col, value) of the entries other than 0 of arrays saved by numpy (.npy), or of sparse ones saved in compressed rows (.npz).

    A file is decoded in one task, in slices of rows; each is one image or one matrix.
    """

    def entries(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held = np.load(io.BytesIO(content), allow_pickle=False)
        if isinstance(held, np.ndarray):
            for lo in range(0, len(held), 1024):
                row, col = np.nonzero(held[lo : lo + 1024])
                yield row + lo, col, held[lo : lo + 1024][row, col]
        else:
            pointers = held["indptr"]
            row = np.repeat(np.arange(len(pointers) - 1), np.diff(pointers))
            ok = held["data"] != 0
            yield row[ok], held["indices"][ok], held["data"][ok]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                for row, col, value in entries(content):
                    yield pd.DataFrame({"file": file, "row": row.astype("int64"), "col": col.astype("int64"), "value": value.astype("float64")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row long, col long, value double")


def read_annotated(spark: SparkSession, path: str):
    """HDF5 containers of annotated matrices need h5py, which is optional; convert them to the tables of this package where it is installed."""
    try:
        import h5py
    except ImportError as missing:
        raise ImportError("reading HDF5 containers needs the package h5py") from missing
    with h5py.File(path) as f:
        x = f["X"]
        names = {k: [v.decode() if isinstance(v, bytes) else v for v in f[k][f[k].attrs.get("_index", "_index")][:]] for k in ("obs", "var")}
        rows = []
        if isinstance(x, h5py.Group):
            pointers, indices, data = x["indptr"][:], x["indices"][:], x["data"][:]
            row = np.repeat(np.arange(len(pointers) - 1), np.diff(pointers))
        else:
            row, indices = np.nonzero(x[:])
            data = x[:][row, indices]
        rows = pd.DataFrame({"cell": np.array(names["obs"])[row], "gene": np.array(names["var"])[indices], "value": data.astype(float)})
    return spark.createDataFrame(rows, "cell string, gene string, value double")
