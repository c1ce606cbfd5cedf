"""Expression in blocks of genes, for operators that go over all cells and genes many times.

Cells are put into tiles: a tile is the rows of the transition table that one task multiplies. A row of data is

* a packed row (cell, block, v): the values of a cell for the genes of one block, zeros included, or
* a run row (tile, at, n, u, c, inv, marks, low, high): the values of one gene for the cells of a tile: the distinct ones in ascending order, how often each
  occurs, the place of each cell's value among them, some order statistics, and the smallest and largest values.

Long vectors are binary columns of doubles or of 32-bit integers, which Spark, Arrow and Parquet copy as they are. So joins and shuffles move arrays, never single entries, and a step ships a cell's values once to each tile that has an edge from it. Values of a gene
are ranked in buckets of value ranges, so no task holds more than about CHUNK values, whatever the number of cells; a value that many cells share is one run a tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissuegrid.common import discard, ordinals, stage, usable

#: Genes of a block; edges of a tile, about; edges of one row that one task takes; values of a gene that one task ranks.
WIDTH, EDGES, ROW, CHUNK = 128, 40_000, 200_000, 262_144
#: Smallest and largest values that quantile ranges need.
ENDS = 6


@dataclass(frozen=True)
class Tiles:
    """cells: (cell, tile, pos); lists: (tile, cells); edges: (tile, pos, n, src, t); links: (tile, src); cut: (tile, home, pos) of tiles that hold a part of one row."""

    cells: DataFrame
    lists: DataFrame
    edges: DataFrame | None
    links: DataFrame | None
    cut: DataFrame | None
    n: int


def _pack(rows: list[np.ndarray], kind: str) -> pa.Array:
    """A binary column of vectors; f8: doubles, i4: 32-bit integers."""
    flat = np.ascontiguousarray(np.concatenate(rows) if rows else np.zeros(0), kind)
    ends = np.cumsum([0, *(len(r) for r in rows)], dtype=np.int64) * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])


def _unpack(column, kind: str) -> list[np.ndarray]:
    """The way back; null gives an empty vector."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not len(column):
        return []
    kind = np.dtype(kind)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // kind.itemsize
    data = column.buffers()[2]
    flat = np.frombuffer(data, kind, int(ends[-1])) if data is not None else np.zeros(0, kind)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    """A column of short lists of doubles, which Spark's functions can read."""
    ends = np.cumsum([0, *(len(r) for r in rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0), pa.float64()))


def _numbers(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _each(n: int) -> Column:
    """One row for each number from 0 to n - 1."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def tiles_of(cells: DataFrame, near: DataFrame | None = None, transition: DataFrame | None = None) -> Tiles:
    """Tiles of the cells (cell), or of the rows of a transition table (dst, src, t).

    near: (cell, key columns...); cells of like keys share a tile, so that fewer values are shipped. Results don't depend on it.
    """
    if transition is None:
        rows = cells.select("cell", F.lit(1).alias("degree")).distinct()
    else:
        rows = transition.groupBy(F.col("dst").alias("cell")).agg(F.count("*").alias("degree"))
    keys = [c for c in near.columns if c != "cell"] if near is not None else []
    if near is not None:
        rows = rows.join(near, "cell", "left")
    rows = stage(rows)
    total = rows.agg(F.count("*").alias("n"), F.sum("degree").alias("edges"), F.max("degree").alias("most")).first()
    n = total["n"]
    height = max(1, min(4096, EDGES * n // max(total["edges"] or 1, 1)))
    placed = ordinals(rows, [], [*keys, "cell"], "_place")
    of = stage(placed.select("cell", F.floor(F.col("_place") / height).cast("long").alias("tile"), (F.col("_place") % height).cast("int").alias("pos"), "degree"))
    discard(rows)
    lists = of.groupBy("tile").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cell"))), lambda s: s["cell"]).alias("cells"))  # `height` cells each
    lists = stage(lists)
    if transition is None:
        return Tiles(of, lists, None, None, None, n)
    sizes = lists.select("tile", F.size("cells").alias("n"))
    edges = transition.join(of.withColumnRenamed("cell", "dst"), "dst").join(sizes, "tile")
    cut = None
    if (total["most"] or 0) > ROW:
        # Rows of very many edges get tiles of their own, as many as they need; what these give is added up afterwards.
        big = edges.filter(F.col("degree") > ROW)
        big = stage(big.withColumn("part", F.pmod(F.xxhash64("src"), F.ceil(F.col("degree") / ROW)).cast("int")))
        names = big.select(F.col("tile").alias("home"), "pos", "part").distinct()
        cut = stage(names.withColumn("tile", -F.row_number().over(Window.orderBy("home", "pos", "part")).cast("long")))  # one row for each ROW edges
        parts = big.withColumnRenamed("tile", "home").join(cut, ["home", "pos", "part"]).select("tile", F.lit(0).alias("pos"), F.lit(1).alias("n"), "src", "t")
        alive = of.filter(F.col("degree") > ROW).join(sizes, "tile").select("tile", "pos", "n", F.col("cell").alias("src"), F.lit(0.0).alias("t"))
        small = edges.filter(F.col("degree") <= ROW).select("tile", "pos", "n", "src", "t")
        edges = small.unionByName(parts).unionByName(alive)
    else:
        edges = edges.select("tile", "pos", "n", "src", "t")
    edges = stage(edges)
    return Tiles(of, lists, edges, stage(edges.select("tile", "src").distinct()), cut, n)


def genes_of(entries: DataFrame) -> tuple[DataFrame, int]:
    """(gene, at): the genes in their order, and how many there are."""
    genes = stage(ordinals(entries.select("gene").distinct(), [], ["gene"], "at"))
    return genes, genes.count()


RUNS = "tile long, at long, n long, u binary, c binary, inv binary, marks array<double>, low array<double>, high array<double>"
_MARKS = 16


def _runs(tiles: list[int], ats: list[int], columns: list[np.ndarray]) -> pa.Table:
    """Run rows of columns."""
    parts = [np.unique(v, return_inverse=True, return_counts=True) for v in columns]
    ends = [np.repeat(u, np.minimum(c, ENDS)) for u, _, c in parts]
    marks = [u[((np.arange(_MARKS) + 0.5) * len(u) / _MARKS).astype(int)] for u, _, _ in parts]
    return pa.table(
        {
            "tile": pa.array(tiles, pa.int64()), "at": pa.array(ats, pa.int64()), "n": pa.array([len(v) for v in columns], pa.int64()), "u": _pack([p[0] for p in parts], "f8"),
            "c": _pack([p[2] for p in parts], "i4"), "inv": _pack([p[1] for p in parts], "i4"), "marks": _lists(marks), "low": _lists([e[:ENDS] for e in ends]), "high": _lists([e[-ENDS:] for e in ends]),
        }
    )


def runs_of(entries: DataFrame, genes: DataFrame, n_genes: int, tiles: Tiles) -> DataFrame:
    """Run rows of entries (cell, gene, value); an entry that is absent, null or NaN is 0. Each (cell, gene) occurs once."""
    met = entries.filter(usable("value")).join(genes, "gene").join(tiles.cells.select("cell", "tile", "pos"), "cell")
    held = met.select("tile", F.floor(F.col("at") / WIDTH).alias("block"), "at", "pos", F.col("value").cast("double").alias("value"))
    every = tiles.lists.select("tile", F.size("cells").alias("n"), _each(-(-n_genes // WIDTH)).alias("block"))

    def run(key, size, rows):
        n, first = size["n"][0].as_py(), key[1].as_py() * WIDTH
        v = np.zeros((min(WIDTH, n_genes - first), n))
        v[_numbers(rows["at"]) - first, _numbers(rows["pos"])] = _numbers(rows["value"])
        return _runs([key[0].as_py()] * len(v), list(range(first, first + len(v))), list(v + 0.0))

    return every.groupBy("tile", "block").cogroup(held.groupBy("tile", "block")).applyInArrow(run, RUNS)


def ranges(rows: DataFrame, n: int, low: str, high: str) -> DataFrame:
    """(at, low, high): the quantiles 5 / n and 1 - 5 / n of each gene, or the extremes of up to 10 values, from the ends of its parts."""
    part = F.pmod(F.xxhash64(*[c for c in ("tile", "piece", "start") if c in rows.columns]), F.lit(1024))
    first = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, ENDS).alias(c)
    last = lambda c: F.reverse(F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list(c)))), 1, ENDS)).alias(c)
    ends = rows.groupBy("at", part.alias("_part")).agg(first("low"), last("high")).groupBy("at").agg(first("low"), last("high"))
    if n <= 10:
        return ends.select("at", F.col("low")[0].alias(low), F.element_at("high", -1).alias(high))
    share = 5 / n  # the places are 5 - 5 / n and n - 6 + 5 / n
    l4, l5, h0, h1 = F.col("low")[4], F.col("low")[5], F.col("high")[0], F.col("high")[1]
    return ends.select("at", (l4 + (l5 - l4) * (1 - share)).alias(low), (h0 + (h1 - h0) * share).alias(high))


def _scaled(v: np.ndarray, low: float, high: float) -> np.ndarray:
    return v - high if low == high else (v - low) / (high - low) * 2 - 1


def _pieces(runs: tuple[np.ndarray, np.ndarray], start: int, chunk: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs that begin at rank `start`, cut where ranks are multiples of the chunk: (piece, start, values, counts)."""
    u, c = runs
    ends = start + np.cumsum(c)
    begins = ends - c
    for piece in range(start // chunk, (int(ends[-1]) - 1) // chunk + 1):
        lo, hi = max(piece * chunk, start), min((piece + 1) * chunk, int(ends[-1]))
        some = (ends > lo) & (begins < hi)
        yield piece, lo, u[some], np.minimum(ends[some], hi) - np.maximum(begins[some], lo)


def _ranked(runs: DataFrame, reference: DataFrame | None, n: int) -> DataFrame:
    """Rank the values of each gene and map them to their targets: rows of kind 0 (tile, at, bucket, u = targets of the tile's runs) and of kind 1, the
    targets in ascending order as (at, piece, start, u, c, low, high). Without a reference the targets are the values themselves.
    """
    buckets = -(-n // CHUNK)
    per = max(1, CHUNK // max(n, 1)) if buckets == 1 else 1  # genes of one task
    lot = F.floor(F.col("at") / per)
    none = F.lit(None)
    if buckets == 1:
        split = runs.select(lot.alias("lot"), F.lit(0).alias("bucket"), "at", F.lit(0).alias("kind"), F.col("tile").alias("key"), "u", "c")
        begin = runs.select("at").distinct().select("at", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("before"), F.lit(n).cast("long").alias("m"))
    else:
        # Bounds from a few order statistics of each tile; they balance the buckets, and any bounds give the same result.
        marks = runs.select("at", F.explode("marks").alias("x"))
        bounds = marks.groupBy("at").agg(F.percentile_approx("x", [k / buckets for k in range(1, buckets)], 10_000).alias("bounds"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tile, at = _numbers(batch.column("tile")), _numbers(batch.column("at"))
                keys, us, cs = [], [], []
                for i, (u, c, b) in enumerate(zip(_unpack(batch.column("u"), "f8"), _unpack(batch.column("c"), "i4"), batch.column("bounds").to_pylist(), strict=True)):
                    cuts = [0, *np.searchsorted(u, np.unique(b)), len(u)]
                    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        if hi > lo:
                            keys.append((at[i], k, tile[i], c[lo:hi].sum())), us.append(u[lo:hi]), cs.append(c[lo:hi])
                a, k, t, m = np.array(keys, np.int64).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(k.astype(np.int32)), pa.array(t), pa.array(m), _pack(us, "f8"), _pack(cs, "i4")], ["at", "bucket", "key", "m", "u", "c"])

        split = stage(runs.select("tile", "at", "u", "c").join(bounds, "at").mapInArrow(cut, "at long, bucket int, key long, m long, u binary, c binary"))
        sizes = split.groupBy("at", "bucket").agg(F.sum("m").alias("m"))
        up = Window.partitionBy("at").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        begin = stage(sizes.select("at", "bucket", F.coalesce(F.sum("m").over(up), F.lit(0)).alias("before"), "m"))
        split = split.select(lot.alias("lot"), "bucket", "at", F.lit(0).alias("kind"), "key", "u", "c")
    ends = begin
    if reference is not None:
        ends = begin.join(ranges(runs, n, "al", "au"), "at").join(ranges(reference, n, "bl", "bu"), "at")
    else:
        ends = begin.select("*", *(F.lit(v).alias(k) for k, v in (("al", -1.0), ("au", 1.0), ("bl", -1.0), ("bu", 1.0))))
    told = ends.select(lot.alias("lot"), "bucket", "at", F.lit(2).alias("kind"), F.col("before").alias("key"), none.cast("binary").alias("u"), none.cast("binary").alias("c"), F.array("al", "au", "bl", "bu").alias("range"))
    rows = split.withColumn("range", none.cast("array<double>")).unionByName(told)
    if reference is not None:
        wanted = begin.select("at", "bucket", F.explode(F.sequence(F.floor(F.col("before") / CHUNK), F.floor((F.col("before") + F.col("m") - 1) / CHUNK))).alias("piece"))
        there = reference.select("at", "piece", "start", "u", "c").join(wanted, ["at", "piece"])
        rows = rows.unionByName(there.select(lot.alias("lot"), "bucket", "at", F.lit(1).alias("kind"), F.col("start").alias("key"), "u", "c", none.cast("array<double>").alias("range")))
    aligned, chunk = reference is not None, CHUNK

    def run(table):
        bucket, at, kind, key = (_numbers(table[c]) for c in ("bucket", "at", "kind", "key"))
        us, cs = _unpack(table["u"], "f8"), _unpack(table["c"], "i4")
        of: dict[int, list[int]] = {}
        for i, a in enumerate(at):
            of.setdefault(int(a), []).append(i)
        out = {k: [] for k in ("kind", "tile", "at", "bucket", "piece", "start")}
        lists = {k: [] for k in ("u", "c", "low", "high")}
        empty = np.zeros(0)

        def put(values, *arrays):
            for k, v in zip(out, values, strict=True):
                out[k].append(v)
            for k, v in zip(lists, arrays, strict=True):
                lists[k].append(v)

        for a, some in of.items():
            mine = [i for i in some if kind[i] == 0]
            told = next(i for i in some if kind[i] == 2)
            before, (al, au, bl, bu) = int(key[told]), table["range"][told].as_py()
            u, inv = np.unique(np.concatenate([us[i] for i in mine]), return_inverse=True)
            c = np.bincount(inv, weights=np.concatenate([cs[i] for i in mine]), minlength=len(u)).astype(np.int64)
            target = u
            if aligned:
                last = before + np.cumsum(c)
                first = last - c
                ref = sorted((i for i in some if kind[i] == 1), key=lambda i: key[i])
                y, yc = _scaled(np.concatenate([us[i] for i in ref]), bl, bu), np.concatenate([cs[i] for i in ref])
                edges = key[ref[0]] + np.concatenate([[0], np.cumsum(yc)])
                lo, hi = np.searchsorted(edges, first, "right") - 1, np.searchsorted(edges, last - 1, "right") - 1
                mean = y[lo]
                across = np.flatnonzero(hi > lo)  # equal values whose ranks hold several targets get their mean
                if len(across):
                    sums = np.concatenate([[0.0], np.cumsum(y * yc)])
                    upto = lambda r, j: sums[j] + (r - edges[j]) * y[j]
                    mean = mean.copy()
                    mean[across] = (upto(last[across], hi[across]) - upto(first[across], lo[across])) / c[across]
                target = 0.5 * ((_scaled(u, al, au) + mean) / 2 + 1) * (bu - bl) + bl
            at_ = 0
            for i in mine:
                put((0, int(key[i]), a, int(bucket[i]), None, None), target[inv[at_ : at_ + len(us[i])]], empty, empty, empty)
                at_ += len(us[i])
            for piece, start, pu, pc in _pieces((target, c), before, chunk):
                ends = np.repeat(pu, np.minimum(pc, ENDS))
                put((1, None, a, int(bucket[told]), piece, start), pu, pc, ends[:ENDS], ends[-ENDS:])
        kinds = {"kind": pa.int32(), "tile": pa.int64(), "at": pa.int64(), "bucket": pa.int32(), "piece": pa.int64(), "start": pa.int64()}
        vectors = {"u": _pack(lists["u"], "f8"), "c": _pack(lists["c"], "i4"), "low": _lists(lists["low"]), "high": _lists(lists["high"])}
        return pa.table({k: pa.array(out[k], t) for k, t in kinds.items()} | vectors)

    schema = "kind int, tile long, at long, bucket int, piece long, start long, u binary, c binary, low array<double>, high array<double>"
    return rows.groupBy("lot", "bucket").applyInArrow(run, schema)


def targets(ranked: DataFrame) -> DataFrame:
    return ranked.filter("kind = 0").select("tile", "at", "bucket", "u")


def order(ranked: DataFrame) -> DataFrame:
    return ranked.filter("kind = 1").select("at", "piece", "start", "u", "c", "low", "high")


def sorted_runs(runs: DataFrame, n: int) -> DataFrame:
    """The values of each gene in ascending order, as a reference for `aligned`."""
    return order(aligned_start(runs, n))


def aligned_start(runs: DataFrame, n: int) -> DataFrame:
    """What `aligned` would give had the values been their own targets."""
    return stage(_ranked(runs, None, n))


def aligned(runs: DataFrame, reference: DataFrame, n: int) -> DataFrame:
    """Every value averaged with the value of its rank in the reference, both scaled by their quantile ranges, and put into the reference's range.

    reference: `order` of an alignment before, or `sorted_runs`. The result goes to `targets` and `order`.
    """
    return stage(_ranked(runs, reference, n))


def packed(runs: DataFrame, goal: DataFrame | None, tiles: Tiles, n_genes: int) -> DataFrame:
    """Packed rows of run rows, with their targets if given in place of their values."""
    block = F.floor(F.col("at") / WIDTH).alias("block")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    mine = runs.select("tile", block, F.lit(0).alias("kind"), "at", none("bucket", "int"), none("u", "binary") if goal is not None else F.col("u"), "inv", none("cells", "array<long>"))
    cells = tiles.lists.select("tile", _each(-(-n_genes // WIDTH)).alias("block"), F.lit(2).alias("kind"), none("at", "long"), none("bucket", "int"), none("u", "binary"), none("inv", "binary"), "cells")
    rows = mine.unionByName(cells)
    if goal is not None:
        rows = rows.unionByName(goal.select("tile", block, F.lit(1).alias("kind"), "at", "bucket", "u", none("inv", "binary"), none("cells", "array<long>")))
    mapped = goal is not None

    def run(key, table):
        kind, at, bucket = (table[c].to_numpy() for c in ("kind", "at", "bucket"))
        us, invs = _unpack(table["u"], "f8"), _unpack(table["inv"], "i4")
        first = key[1].as_py() * WIDTH
        cells = table["cells"][int(np.flatnonzero(kind == 2)[0])].values
        v = np.zeros((len(cells), min(WIDTH, n_genes - first)))
        parts: dict[int, list] = {}
        for i in np.flatnonzero(kind == 1):
            parts.setdefault(int(at[i]), []).append((bucket[i], us[i]))
        for i in np.flatnonzero(kind == 0):
            a = int(at[i])
            u = us[i] if not mapped else np.concatenate([p[1] for p in sorted(parts[a], key=lambda p: p[0])])
            v[:, a - first] = u[invs[i]]
        return pa.table({"cell": cells, "block": pa.array(np.full(len(cells), key[1].as_py())), "v": _pack(list(v), "f8")})

    return rows.groupBy("tile", "block").applyInArrow(run, "cell long, block long, v binary")


def _weighted(pos: np.ndarray, t: np.ndarray, at: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Row sums of t times the rows `at` of v by pos, in slices of edges that keep the products small."""
    out = np.zeros((n, v.shape[1]))
    by = np.argsort(pos, kind="stable")
    for lo in range(0, len(by), 16_384):
        some = by[lo : lo + 16_384]
        p = pos[some]
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        out[p[starts]] += np.add.reduceat(t[some, None] * v[at[some]], starts, axis=0)
    return out


def multiplied(values: DataFrame, tiles: Tiles, n_genes: int) -> DataFrame:
    """Run rows of the product of the transition table with packed rows. A row of the table counts the cells that have values, others as 0."""
    edges = tiles.edges.select("*", _each(-(-n_genes // WIDTH)).alias("block"))
    shipped = values.withColumnRenamed("cell", "src").join(tiles.links, "src").select("tile", "block", "src", "v")
    whole = tiles.cut is None

    def run(key, e, x):
        tile, first = key[0].as_py(), key[1].as_py() * WIDTH
        width = min(WIDTH, n_genes - first)
        n = int(e["n"][0].as_py()) if e.num_rows else 0
        out = np.zeros((n, width))
        if n and x.num_rows:
            held = _numbers(x["src"])
            v = np.concatenate(_unpack(x["v"], "f8")).reshape(-1, width)
            by = np.argsort(held)
            src = _numbers(e["src"])
            at = np.minimum(np.searchsorted(held[by], src), len(held) - 1)
            ok = held[by][at] == src
            out = _weighted(_numbers(e["pos"])[ok], _numbers(e["t"])[ok], by[at[ok]], v, n)
        rows = list(np.ascontiguousarray(out.T)) if n else []
        ats = list(range(first, first + len(rows)))
        if whole:
            return _runs([tile] * len(rows), ats, rows)
        return pa.table({"tile": pa.array([tile] * len(rows), pa.int64()), "at": pa.array(ats, pa.int64()), "v": _pack(rows, "f8"), "x": pa.array([float(r[0]) for r in rows], pa.float64())})

    both = edges.groupBy("tile", "block").cogroup(shipped.groupBy("tile", "block"))
    if whole:
        return both.applyInArrow(run, RUNS)
    columns = stage(both.applyInArrow(run, "tile long, at long, v binary, x double"))
    sums = columns.filter("tile < 0").join(tiles.cut, "tile").groupBy(F.col("home").alias("tile"), "at", "pos").agg(F.sum("x").alias("x"))
    late = sums.groupBy("tile", "at").agg(F.collect_list(F.struct("pos", "x")).alias("late"))  # a tile's cells at most
    met = columns.filter("tile >= 0").select("tile", "at", "v").join(late, ["tile", "at"], "left").select("tile", "at", "v", F.col("late.pos").alias("pos"), F.col("late.x").alias("x"))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v, pos, x in zip(_unpack(batch.column("v"), "f8"), batch.column("pos").to_pylist(), batch.column("x").to_pylist(), strict=True):
                v = v.copy()
                if pos:
                    v[pos] += x
                rows.append(v)
            yield from _runs(batch.column("tile").to_pylist(), batch.column("at").to_pylist(), rows).to_batches()

    return met.mapInArrow(added, RUNS)


def entries_of(rows: DataFrame, genes: DataFrame) -> DataFrame:
    """(cell, gene, value) of packed rows, zeros included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                held = _unpack(part.column("v"), "f8")
                sizes = [len(v) for v in held]
                at = np.concatenate([b * WIDTH + np.arange(k) for b, k in zip(_numbers(part.column("block")), sizes, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(_numbers(part.column("cell")), sizes)), pa.array(at), pa.array(np.concatenate(held))], ["cell", "at", "value"])

    return rows.mapInArrow(run, "cell long, at long, value double").join(genes, "at").select("cell", "gene", "value")
