"""The k most similar vectors of every vector: a small-world graph per shard of the space, the shards' results merged.

The graph of a shard is stored as flat neighbour arrays, one row a node, and searched by all queries that reach the shard.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tissuegrid.llm.hnsw import Graph
from tissuegrid.operators.nearest import Shards, lists, matrix
from tissuegrid.operators.nearest import nearest as by_shards


@dataclass(frozen=True)
class SmallWorld:
    """links: neighbours of a node on the upper layers, twice as many on the lowest; beams: nodes kept while building and searching."""

    links: int = 8
    build_beam: int = 32
    search_beam: int = 32

    schema = "shard int, place int, node long, block long, v array<double>, near array<int>, upper array<int>"

    def seconds(self, size: int) -> float:
        return 1.0  # every shard is worth tasks of its own

    def rows(self, table: pa.Table, width: int) -> pa.Table:
        """Build the graph of a shard: one row a node with its place, vector and neighbour arrays."""
        node, block, vectors = table["node"].to_numpy(), table["block"].to_numpy(), matrix(table["v"], width)
        by = np.argsort(node * np.int64(-7046029254386353131), kind="stable")  # an order that has nothing to do with the vectors
        node, block, vectors = node[by], block[by], vectors[by]
        graph = Graph.build(vectors, self.links, self.build_beam)
        higher = [np.concatenate([layer[i] for layer in graph.layers[1:] if i < len(layer)]) for i in range(len(graph.layers[1]) if len(graph.layers) > 1 else 0)]
        upper = [u.tolist() for u in higher] + [[]] * (len(node) - len(higher))
        columns = [pa.array(np.full(len(node), table["shard"][0].as_py()), pa.int32()), pa.array(np.arange(len(node)), pa.int32()), pa.array(node), pa.array(block)]
        columns += [lists(vectors, pa.float64()), lists(graph.layers[0], pa.int32()), pa.array(upper, pa.list_(pa.int32()))]
        return pa.Table.from_arrays(columns, ["shard", "place", "node", "block", "v", "near", "upper"])

    def _graph(self, index: pa.Table, width: int) -> Graph:
        layers = [matrix(index["near"], 2 * self.links)]
        flat = [np.array(u, np.int32).reshape(-1, self.links) for u in index["upper"].to_pylist() if u]
        for level in range(max(map(len, flat), default=0)):
            layers.append(np.array([u[level] for u in flat if len(u) > level], np.int32))
        return Graph(matrix(index["v"], width), layers)

    def search(self, index: pa.Table, asked: np.ndarray, block: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        index = index.sort_by("place")
        graph, node, of = self._graph(index, vectors.shape[1]), index["node"].to_numpy(), index["block"].to_numpy()
        by = np.argsort(node)
        at = by[np.minimum(np.searchsorted(node, asked, sorter=by), len(node) - 1)]
        ids, d2 = graph.search(vectors, k + 1, self.search_beam, np.where(node[at] == asked, at, -1))
        row, col = np.nonzero(ids >= 0)
        found, d2 = ids[row, col], d2[row, col]
        ok = (node[found] != asked[row]) & (of[found] == block[row])
        return row[ok], node[found[ok]], d2[ok]


def nearest(df: DataFrame, id: str, dimensions: list[Column | str], k: int, queries: Column | None = None, limit: float | None = None, shard: int = 8192, graph: SmallWorld = SmallWorld()) -> DataFrame:
    """(query, neighbour, distance, rank): the `k` rows nearest to each query row, as `tissuegrid.operators.nearest.nearest` defines it.

    The search within a shard is approximate (a share of some thousandths of the neighbours may be missed), distances are exact.
    """
    return by_shards(df, id, dimensions, k, queries=queries, limit=limit, shards=Shards(size=shard), kernel=graph)
