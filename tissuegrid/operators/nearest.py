"""k nearest rows of every row, by shards of the space.

Shards are the cells of a k-d tree, whose cut planes are fitted on a bounded sample, and cut a second time, each by a sample of its own, where there are
more of them than that sample tells apart; every vector lies in one of them. Equal vectors are one node, for
which the smallest identifiers stand, so that copies cost nothing. A query first looks into its own shard; the distance it finds there, or a
distance given as limit, tells exactly which other shards may hold something nearer. What happens inside a shard is up to a kernel: the one here compares all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissuegrid.common import stage, usable

#: Distance between the codes of different blocks, and the largest distance of one search.
APART, FAR = 1e12, 1e11
#: Rows of the largest sample that comes to the driver for cut planes (some 40 MB), and sampled rows for each shard.
MOST, EACH = 500_000, 8
HIT = "query long, node long, d2 double"


@dataclass(frozen=True)
class Shards:
    """size: vectors of a shard, about; chunk: queries of one shard that one task takes.

    sample: rows the first cut planes are fitted on, about; EACH for each shard if that is more, up to MOST.
    """

    size: int = 1024
    sample: int = 50_000
    chunk: int = 50_000


class Tree:
    """Cut planes in flat arrays. Leaf numbers are stored as negative children."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis, self.cut, self.left, self.right, self.leaves = [], [], [], [], 0
        self.root = self._grow(sample, leaves)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, sample: np.ndarray, leaves: int) -> int:
        if leaves < 2 or len(sample) < 2:
            return self._leaf()
        axis = int(np.argmax(np.var(sample, axis=0)))
        x = sample[:, axis]
        cut = float(np.quantile(x, (leaves // 2) / leaves, method="lower"))
        if cut == x.max():
            cut = float(x[x < cut].max(initial=-np.inf))
        if not np.isfinite(cut):  # all values are equal
            return self._leaf()
        above = float(x[x > cut].min())
        cut += (above - cut) / 2  # midway between two values, so that neither lies on the plane
        low = x <= cut
        share = min(leaves - 1, max(1, round(leaves * low.mean())))
        at = len(self.axis)
        self.axis.append(axis), self.cut.append(cut), self.left.append(0), self.right.append(0)
        self.left[at] = self._grow(sample[low], share)
        self.right[at] = self._grow(sample[~low], leaves - share)
        return at

    def visits(self, vectors: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf whose cell comes within the radius of the row's vector; radius 0 gives its own leaf."""
        rows, leaves = [], []
        todo = [(self.root, np.arange(len(vectors)), np.zeros_like(vectors))]
        while todo:
            node, some, off = todo.pop()
            if not len(some):
                continue
            if node < 0:
                rows.append(some)
                leaves.append(np.full(len(some), -node - 1))
                continue
            axis, cut = self.axis[node], self.cut[node]
            x = vectors[some, axis]
            for child, gap in ((self.left[node], np.maximum(x - cut, 0)), (self.right[node], np.where(x <= cut, np.maximum(cut - x, 5e-324), 0))):
                o = off.copy()
                o[:, axis] = np.maximum(o[:, axis], gap)
                d = np.sqrt(np.einsum("nd,nd->n", o, o))
                go = (o.max(axis=1) == 0) | ((d <= radius[some]) & (radius[some] > 0))
                todo.append((child, some[go], o[go]))
        return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(leaves or [np.zeros(0, int)])


    def arrays(self) -> dict[str, list]:
        return {"axis": self.axis, "cut": self.cut, "left": self.left, "right": self.right}

    @classmethod
    def of(cls, root: int, leaves: int, axis: list[int], cut: list[float], left: list[int], right: list[int]) -> Tree:
        tree = cls.__new__(cls)
        tree.root, tree.leaves, tree.axis, tree.cut, tree.left, tree.right = root, leaves, axis, cut, left, right
        return tree


def matrix(column, width: int) -> np.ndarray:
    """A column of lists of one length as an array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def lists(rows: np.ndarray, kind) -> pa.ListArray:
    rows = np.ascontiguousarray(rows)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.reshape(-1), kind))


class Exact:
    """Compares each query with all vectors of the shard, as they are: nothing is built beforehand.

    A kernel that builds something has `rows(table, width)`, which gets the rows (shard, node, block, v) of a shard and gives rows of its `schema`.
    `seconds` is about what a row costs in a shard of the size.
    """

    schema = None

    def seconds(self, size: int) -> float:
        return 5e-8 * size

    def search(self, index: pa.Table, asked: np.ndarray, block: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, node, squared distance); the query's own node is left out."""
        index = index.sort_by("node")
        node, of, held = index["node"].to_numpy(), index["block"].to_numpy(), matrix(index["v"], vectors.shape[1])
        out = []
        for lo in range(0, len(asked), 256):
            some = slice(lo, lo + 256)
            diff = vectors[some, None, 1:] - held[None, :, 1:]
            d2 = np.einsum("qnd,qnd->qn", diff, diff)
            d2[(block[some, None] != of[None]) | (asked[some, None] == node[None])] = np.inf
            if d2.shape[1] > k:
                d2[d2 > np.partition(d2, k - 1, axis=1)[:, k - 1 : k]] = np.inf
            row, col = np.nonzero(np.isfinite(d2))
            d = d2[row, col]
            by = np.lexsort((col, d, row))
            row, col, d = row[by], col[by], d[by]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            ok = place < k
            out.append((row[ok] + lo, node[col[ok]], d[ok]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _seen(tree: Tree, v: np.ndarray, radius: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): the leaves a row has to look into, and whether a leaf is the row's own; `own` tells which rows lie in the tree at all."""
    row, leaf = tree.visits(v, radius)
    own_row, own_leaf = tree.visits(v, np.zeros(len(v)))
    home = np.full(len(v), -1)
    home[own_row] = own_leaf
    if own is not None:
        home[~own] = -1
    return row, leaf, leaf == home[row]


@dataclass(frozen=True)
class Forest:
    """A tree, and trees that cut its leaves again: (leaf, base, root, leaves, axis, cut, left, right), `base` being the number of the first of its leaves."""

    top: Tree
    below: DataFrame | None
    leaves: int

    @classmethod
    def fit(cls, heads: DataFrame, width: int, n: int, shards: Shards) -> Forest:
        wanted = -(-n // shards.size)
        first = min(wanted, max(1, MOST // EACH))
        step = max(1, n // min(MOST, max(shards.sample, EACH * first)))
        sample = heads.filter(F.pmod(F.xxhash64("node"), F.lit(step)) == 0).select("v").limit(2 * MOST).toArrow()
        top = Tree(matrix(sample["v"], width), first)
        if first == wanted:
            return cls(top, None, top.leaves)
        every = max(1, shards.size // EACH)
        some = heads.filter(F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(every)) == 0).select(F.col("node").alias("query"), "block", "v")

        def fitted(table):
            tree = Tree(matrix(table["v"], width), max(1, round(table.num_rows * every / shards.size)))
            return pa.Table.from_pylist([{"leaf": table["leaf"][0].as_py(), "root": tree.root, "leaves": tree.leaves, **tree.arrays()}], pa.schema([("leaf", pa.int32()), ("root", pa.int32()), ("leaves", pa.int32()), ("axis", pa.list_(pa.int32())), ("cut", pa.list_(pa.float64())), ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32()))]))

        trees = _routed(some, top, width, 0.0, True).groupBy("leaf").applyInArrow(fitted, "leaf int, root int, leaves int, axis array<int>, cut array<double>, left array<int>, right array<int>")
        # A leaf without a sampled row stays whole.
        spark = heads.sparkSession
        all_ = spark.range(top.leaves).select(F.col("id").cast("int").alias("leaf")).join(trees, "leaf", "left").withColumns({"root": F.coalesce("root", F.lit(-1)), "leaves": F.coalesce("leaves", F.lit(1))})
        upto = F.sum("leaves").over(Window.orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1))  # MOST / EACH rows at most
        below = stage(all_.withColumn("base", F.coalesce(upto, F.lit(0)).cast("int")))
        return cls(top, below, below.agg(F.sum("leaves").alias("n")).first()["n"])

    def visited(self, frame: DataFrame, width: int, limit: float, first: bool) -> DataFrame:
        """(shard, query, block, v): the shards a query has to look into. In a second search `r` is the distance found, and its own shard is left out."""
        routed = _routed(frame, self.top, width, limit, first)
        if self.below is None:
            return routed.filter("not home" if not first else "true").select(F.col("leaf").alias("shard"), "query", "block", "v")

        def run(key, rows, trees):
            if not rows.num_rows:
                return pa.table({"shard": pa.array([], pa.int32()), "query": rows["query"], "block": rows["block"], "v": rows["v"]})
            of = trees.to_pylist()[0]
            tree = Tree.of(of["root"], of["leaves"], *(of[c] or [] for c in ("axis", "cut", "left", "right")))
            v = matrix(rows["v"], width)
            row, leaf, home = _seen(tree, v, rows["r"].to_numpy(), rows["home"].to_numpy())
            if not first:
                row, leaf = row[~home], leaf[~home]
            take = pa.array(row)
            return pa.table({"shard": pa.array(leaf + of["base"], pa.int32()), "query": rows["query"].take(take), "block": rows["block"].take(take), "v": lists(v[row], pa.float64())})

        # Rows of a leaf come in parts of a bounded number.
        part = F.pmod(F.xxhash64("query"), F.lit(16)).cast("int")
        rows = routed.withColumn("part", part).groupBy("leaf", "part")
        trees = self.below.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15)))).groupBy("leaf", "part")
        return rows.cogroup(trees).applyInArrow(run, "shard int, query long, block long, v array<double>")


def _routed(frame: DataFrame, tree: Tree, width: int, limit: float, first: bool) -> DataFrame:
    """(leaf, query, block, v, r, home): the leaves of the tree that a query has to look into, its distance, and whether the leaf is its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), width)
            if not len(v):
                continue
            radius = np.full(len(v), limit) if first else np.minimum(batch.column("r").to_numpy(zero_copy_only=False), FAR)
            row, leaf, home = _seen(tree, v, radius, None)
            if len(row):
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), batch.column("query").take(take), batch.column("block").take(take), lists(v[row], pa.float64()), pa.array(radius[row]), pa.array(home)], ["leaf", "query", "block", "v", "r", "home"])

    return frame.mapInArrow(run, "leaf int, query long, block long, v array<double>, r double, home boolean")


def _tasks(spark, leaves: int, rows: int, shards: Shards, kernel) -> int:
    """A shard is little data but much work, so shards are put together by work, not by their bytes: a task gets one shard, or some seconds of smaller work."""
    by_work = int(rows * kernel.seconds(shards.size) / 2)
    return max(spark.sparkContext.defaultParallelism, min(3 * leaves, by_work, 20_000))  # three for a shard, so that few tasks get two long ones


def _search(index: DataFrame, queries: DataFrame, shards: Shards, width: int, k: int, limit: float, kernel, tasks: int) -> DataFrame:
    """Queries (a staged table) of a shard are cut into chunks, so that no task gets more than about shards.chunk of them; the shard goes to each chunk."""
    if queries.isEmpty():
        return queries.sparkSession.createDataFrame([], HIT)
    chunks = queries.groupBy("shard").agg(F.ceil(F.count("*") / shards.chunk).cast("int").alias("chunks"))
    asked = queries.join(chunks, "shard").withColumn("chunk", F.pmod(F.xxhash64("query"), "chunks").cast("int")).drop("chunks")
    held = index.join(chunks, "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def run(rows: pa.Table, of: pa.Table) -> pa.Table:
        row, node, d2 = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
        query = of["query"].to_numpy()
        if rows.num_rows and of.num_rows:
            row, node, d2 = kernel.search(rows, query, of["block"].to_numpy(), matrix(of["v"], width), k)
            ok = np.sqrt(d2) <= limit
            row, node, d2 = row[ok], node[ok], d2[ok]
        return pa.table({"query": pa.array(query[row], pa.int64()), "node": pa.array(node, pa.int64()), "d2": pa.array(d2, pa.float64())})

    held, asked = (x.repartition(tasks, "shard", "chunk").groupBy("shard", "chunk") for x in (held, asked))
    return stage(held.cogroup(asked).applyInArrow(run, HIT))


def nearest(df: DataFrame, id: str, dimensions: list[Column | str], k: int, block: list[str] = [], queries: Column | None = None, limit: float | None = None, shards: Shards = Shards(), kernel=None) -> DataFrame:  # noqa: B006
    """(query, neighbour, distance, rank): the `k` rows nearest to each query row, equal distances by the smaller id; Euclidean distance.

    id: a long, unique. dimensions: double expressions, within +-1e10. block: only rows that agree in these columns are neighbours. Rows with a null id, a
    null block column, or a null or NaN dimension take no part; a repeated row counts once. queries: a condition on `df` that picks the query rows
    (all by default); they are searched for among all rows. limit: only neighbours within this distance. Rows equal in all
    dimensions are neighbours at distance 0. Fewer than k other rows give fewer neighbours; an empty table gives none. Other columns are ignored.
    The result is exact with the default kernel.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark, kernel, width = df.sparkSession, kernel or Exact(), len(dimensions) + 1
    names = [f"d{i}" for i in range(width - 1)]
    columns = [(F.col(c) if isinstance(c, str) else c).cast("double").alias(x) for c, x in zip(dimensions, names, strict=True)]
    rows = df.dropna(subset=[id, *block]).select(F.col(id).cast("long").alias("id"), (F.xxhash64(*block) if block else F.lit(0).cast("long")).alias("block"), *columns, (F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))).alias("asked"))
    for x in names:
        rows = rows.filter(usable(x)).withColumn(x, F.col(x) + F.lit(0.0))  # -0.0 is 0.0
    rows = rows.distinct()
    code = F.pmod("block", F.lit(1 << 16)) * APART
    vector = F.array((code if block else F.lit(0.0)).alias("code"), *names)
    # One node for all rows of one vector: its smallest k + 1 ids are all that can be among anyone's k nearest.
    low = rows.withColumn("o", F.row_number().over(Window.partitionBy("block", *names).orderBy("id"))).filter(F.col("o") <= k + 1)
    heads = low.groupBy("block", *names).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    heads = stage(heads.select(F.col("ids")[0].alias("node"), "block", vector.alias("v"), "ids"))
    members = rows.filter("asked").select("id", "block", vector.alias("v")).join(heads.select("block", "v", "node"), ["block", "v"]).select("id", "node")
    members = members if queries is None else stage(members)
    n = heads.count()
    if n == 0:
        return spark.createDataFrame([], "query long, neighbour long, distance double, rank int")
    forest = Forest.fit(heads, width, n, shards)

    as_query = heads.select(F.col("node").alias("query"), "block", "v")
    tasks = _tasks(spark, forest.leaves, n, shards, kernel)
    placed = stage(forest.visited(as_query, width, 0.0, True))
    index = placed.select(F.col("shard").alias("shard"), F.col("query").alias("node"), F.col("block").alias("block"), F.col("v").alias("v"))
    if kernel.schema:
        index = stage(index.repartition(tasks, "shard").groupBy("shard").applyInArrow(lambda t: kernel.rows(t, width), kernel.schema))
    asked = as_query
    if queries is not None:
        some = members.select(F.col("node").alias("query")).distinct()
        asked, placed = asked.join(some, "query", "left_semi"), stage(placed.join(some, "query", "left_semi"))
    endless = limit is None
    first = placed if endless else stage(forest.visited(asked, width, limit, True))
    hits = _search(index, first, shards, width, k, FAR if endless else limit, kernel, tasks)
    best = Window.partitionBy("query").orderBy("d2", "node")
    if endless and forest.leaves > 1:
        found = hits.withColumn("o", F.row_number().over(best)).filter(F.col("o") <= k).groupBy("query").agg(F.max("d2").alias("d2"), F.count("*").alias("n"))
        radius = F.when(F.col("n") == k, F.sqrt("d2") * (1 + 1e-12) + 1e-300)  # with fewer than k found, look everywhere
        known = asked.join(found.select("query", radius.alias("r")), "query", "left").withColumn("r", F.coalesce("r", F.lit(FAR)))
        hits = hits.unionByName(_search(index, stage(forest.visited(known, width, 0.0, False)), shards, width, k, FAR, kernel, tasks))
    hits = hits.withColumn("o", F.row_number().over(best)).filter(F.col("o") <= k)
    # From nodes to rows: the candidates of a node are its own smallest ids and those of its neighbours.
    near = hits.join(heads.select("node", "ids"), "node").select(F.col("query").alias("node"), "d2", "ids")
    own = heads.select("node", F.lit(0.0).alias("d2"), "ids")
    listed = own.unionByName(near).select("node", F.explode(F.transform("ids", lambda i: F.struct(F.col("d2").alias("d2"), i.alias("id")))).alias("c"))
    listed = listed.withColumn("o", F.row_number().over(Window.partitionBy("node").orderBy("c"))).filter(F.col("o") <= k + 1)
    listed = listed.groupBy("node").agg(F.sort_array(F.collect_list("c")).alias("cs"))  # k + 1 entries at most
    others = F.slice(F.filter("cs", lambda c: c["id"] != F.col("query")), 1, k)
    each = members.withColumnRenamed("id", "query").join(listed, "node").select("query", F.posexplode(others).alias("o", "c"))
    return each.select("query", F.col("c.id").alias("neighbour"), F.sqrt("c.d2").alias("distance"), (F.col("o") + 1).alias("rank"))
