"""A hierarchical navigable small-world graph over the vectors of one shard, as flat arrays, for many queries at once.

Nodes are numbered so that every layer is a prefix: layer 0 holds all nodes, layer l about 1 / SHRINK of those of layer l - 1. A layer is one array
(nodes, links) of neighbour numbers, -1 where there is none. Insertion and search work on batches: all queries of a batch take a step together.
"""

from __future__ import annotations

import numpy as np

SHRINK, SEEDS, BATCH = 12, 128, 2048
#: Entries of the table of nodes seen by the queries of a batch; batches over larger graphs are smaller.
SEEN = 1 << 25


def _batch(n: int) -> int:
    return max(64, min(BATCH, SEEN // max(1, n)))


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...d,...d->...", d, d)


def _beam(vectors, links, queries, entry, ef, steps=4):
    """The `ef` nearest nodes that are reached from the entries, by distance: (numbers, squared distances), -1 and inf where there are fewer."""
    q = len(queries)
    ids = np.full((q, ef), -1, np.int32)
    dist = np.full((q, ef), np.inf)
    done = np.ones((q, ef), bool)
    entry = entry.reshape(q, -1)[:, :ef]
    first = np.where(entry >= 0, _square(vectors[entry], queries[:, None]), np.inf)
    if entry.shape[1] > 1:  # the same entry twice counts once
        by = np.argsort(entry, axis=1, kind="stable")
        entry, first = np.take_along_axis(entry, by, 1), np.take_along_axis(first, by, 1)
        first[:, 1:][entry[:, 1:] == entry[:, :-1]] = np.inf
    by = np.argsort(first, axis=1)
    entry, first = np.take_along_axis(entry, by, 1), np.take_along_axis(first, by, 1)
    n = entry.shape[1]
    ids[:, :n] = np.where(np.isfinite(first), entry, -1)
    dist[:, :n], done[:, :n] = first, ~np.isfinite(first)
    active = np.flatnonzero(~done.all(axis=1))
    take = min(steps, ef)
    seen = np.zeros((q, len(links) + 1), bool)  # the last column takes what is absent
    seen[:, -1] = True
    np.put_along_axis(seen, ids[:, :n].astype(np.int64), True, 1)
    while len(active):
        a_ids, a_dist, a_done = ids[active], dist[active], done[active]
        at = np.argsort(a_done, axis=1, kind="stable")[:, :take]  # the nearest not yet expanded
        nodes = np.where(np.take_along_axis(a_done, at, 1), -1, np.take_along_axis(a_ids, at, 1))
        np.put_along_axis(a_done, at, True, 1)
        new = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(active), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        some = ~seen[active[:, None], new]
        rows = np.nonzero(some)[0]
        seen[active[rows], new[some]] = True
        d = np.full(new.shape, np.inf)
        d[some] = _square(vectors[new[some]], queries[active[rows]])
        d[d >= a_dist[:, -1:]] = np.inf
        all_d = np.concatenate([a_dist, d], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
        dist[active] = np.take_along_axis(all_d, best, 1)
        fresh = np.concatenate([a_ids, new], axis=1)
        ids[active] = np.where(np.isfinite(dist[active]), np.take_along_axis(fresh, best, 1), -1)
        done[active] = np.take_along_axis(np.concatenate([a_done, ~np.isfinite(d)], axis=1), best, 1)
        active = active[~done[active].all(axis=1)]
    return ids, dist


def _chosen(vectors, ids, dist, m):
    """Of candidates sorted by distance, `m` that lie in different directions: each nearer to the node than to those chosen before; then the nearest others."""
    b, c = ids.shape
    of = vectors[ids]
    norm = np.einsum("bcd,bcd->bc", of, of)
    pair = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(of, of.transpose(0, 2, 1))
    nearest, count = np.full((b, c), np.inf), np.zeros(b, int)
    keep = np.zeros((b, c), bool)
    for j in range(c):
        k = np.isfinite(dist[:, j]) & (dist[:, j] < nearest[:, j]) & (count < m)
        keep[:, j] = k
        count += k
        nearest[k] = np.minimum(nearest[k], pair[k, j])
    rank = np.argsort(np.where(keep, 0, 1) + np.where(np.isfinite(dist), 0, 2), axis=1, kind="stable")[:, :m]
    out = np.where(np.isfinite(np.take_along_axis(dist, rank, 1)), np.take_along_axis(ids, rank, 1), -1)
    return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1).astype(np.int32)


def _add_back(vectors, links, batch, chosen):
    """Links from the chosen neighbours back to the nodes of the batch; a full list is chosen anew."""
    m = links.shape[1]
    to, back = chosen.reshape(-1), np.repeat(batch, m)
    ok = to >= 0
    to, back = to[ok], back[ok]
    d = _square(vectors[to], vectors[back])
    by = np.lexsort((d, to))
    to, back = to[by], back[by]
    starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    place = np.arange(len(to)) - np.repeat(starts, np.diff(np.r_[starts, len(to)]))
    nodes = to[starts]
    new = np.full((len(nodes), m), -1, np.int32)
    row = np.repeat(np.arange(len(nodes)), np.diff(np.r_[starts, len(to)]))
    fits = place < m
    new[row[fits], place[fits]] = back[fits]
    for lo in range(0, len(nodes), BATCH):
        some = nodes[lo : lo + BATCH]
        ids = np.concatenate([links[some], new[lo : lo + BATCH]], axis=1)
        dist = np.where(ids >= 0, _square(vectors[ids], vectors[some][:, None]), np.inf)
        order = np.argsort(ids, axis=1, kind="stable")  # a link that is there already counts once
        sorted_ids, sorted_d = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        sorted_d[:, 1:][sorted_ids[:, 1:] == sorted_ids[:, :-1]] = np.inf
        order = np.argsort(sorted_d, axis=1, kind="stable")
        links[some] = _chosen(vectors, np.take_along_axis(sorted_ids, order, 1), np.take_along_axis(sorted_d, order, 1), m)


class Graph:
    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers

    @classmethod
    def build(cls, vectors: np.ndarray, m: int = 10, ef: int = 40) -> Graph:
        """vectors come in random order: layer l takes the first of them."""
        n = len(vectors)
        sizes = [n]
        while sizes[-1] > 4 * SEEDS:
            sizes.append(max(SEEDS, sizes[-1] // SHRINK))
        graph = cls(vectors, [])
        for level in range(len(sizes) - 1, -1, -1):
            size, width = sizes[level], 2 * m if level == 0 else m
            links = np.full((size, width), -1, np.int32)
            seeds = min(size, SEEDS)
            d = _square(vectors[:seeds, None], vectors[None, :seeds])
            np.fill_diagonal(d, np.inf)
            near = np.argsort(d, axis=1, kind="stable")[:, : min(ef, max(1, seeds - 1))].astype(np.int32)
            links[:seeds] = _chosen(vectors, near, np.take_along_axis(d, near, 1), width)
            start = seeds
            while start < size:
                end = min(size, start + min(start, _batch(start)))
                batch = np.arange(start, end, dtype=np.int32)
                queries = vectors[batch]
                if graph.layers and len(graph.layers[0]) <= start:
                    entry = graph._descend(queries, 0)
                else:
                    entry = np.argmin(_square(queries[:, None], vectors[None, :seeds]), axis=1).astype(np.int32)[:, None]
                ids, dist = _beam(vectors, links[:start], queries, entry, ef)
                inside = np.empty((len(batch), len(batch)))
                for lo in range(0, len(batch), 256):
                    inside[lo : lo + 256] = _square(queries[lo : lo + 256, None], queries[None])
                np.fill_diagonal(inside, np.inf)
                peers = min(ef, len(batch) - 1)
                if peers > 0:
                    near = np.argpartition(inside, peers - 1, axis=1)[:, :peers]
                    ids = np.concatenate([ids, batch[near]], axis=1)
                    dist = np.concatenate([dist, np.take_along_axis(inside, near, 1)], axis=1)
                by = np.argsort(dist, axis=1, kind="stable")[:, :ef]
                chosen = _chosen(vectors, np.take_along_axis(ids, by, 1), np.take_along_axis(dist, by, 1), width)
                links[batch] = chosen
                _add_back(vectors, links, batch, chosen)
                start = end
            graph.layers.insert(0, links)
        return graph

    def _descend(self, queries: np.ndarray, lowest: int) -> np.ndarray:
        """For each query the nearest nodes found on the layers from the top down to `lowest` of those that are built."""
        seeds = min(SEEDS, len(self.layers[-1]))
        entry = np.argmin(_square(queries[:, None], self.vectors[None, :seeds]), axis=1).astype(np.int32)[:, None]
        for links in self.layers[lowest:][::-1]:
            entry, _ = _beam(self.vectors, links, queries, entry, 4, 2)
        return entry

    def search(self, queries: np.ndarray, k: int, ef: int, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, squared distances) of the k nearest nodes found; home: the query's own node or -1, from which the search starts too."""
        out_i, out_d = np.full((len(queries), k), -1, np.int32), np.full((len(queries), k), np.inf)
        size = _batch(len(self.vectors))
        for lo in range(0, len(queries), size):
            q = queries[lo : lo + size]
            entry = self._descend(q, 1) if len(self.layers) > 1 else np.zeros((len(q), 1), np.int32)
            if home is not None:
                entry = np.concatenate([home[lo : lo + size, None].astype(np.int32), entry], axis=1)
            ids, dist = _beam(self.vectors, self.layers[0], q, entry, max(ef, k))
            out_i[lo : lo + size], out_d[lo : lo + size] = ids[:, :k], dist[:, :k]
        return out_i, out_d
