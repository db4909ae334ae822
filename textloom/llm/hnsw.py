"""A hierarchical navigable small-world graph over unit vectors, kept in flat neighbour arrays.

Nodes are renumbered by level, highest first, so layer L holds the nodes 0 .. size[L] - 1 and each
layer is one array of neighbours. Nodes enter a layer in batches: a batch searches the graph built
so far with a beam (all queries of the batch at once), sees its own members by one matrix product,
links to diverse neighbours, and is linked back. The forward links of a node stay; its other
places go to the closest nodes that link to it.
"""

from __future__ import annotations

import numpy as np

FORWARD, BACKWARD = 8, 8
BUILD_BEAM, BATCH = 24, 1024
#: A batch's table of visited nodes has at most this many entries.
SEEN = 1 << 25


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, step: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the ``beam`` nodes found for each query, in no order; -1 for none.

    Each round expands the ``step`` best nodes of every query that has not been expanded.
    """
    m, n = len(q), len(x)
    width = links.shape[1]
    ids = np.full((m, beam), -1, dtype=np.int32)
    sims = np.full((m, beam), -2.0, dtype=np.float32)
    fresh = np.zeros((m, beam), dtype=bool)
    seen = np.full((m, n), -1, dtype=np.int16)
    ids[:, 0] = entry
    sims[:, 0] = np.einsum("md,md->m", x[entry], q)
    fresh[:, 0] = True
    seen[np.arange(m), entry] = 0
    step = min(step, beam)
    column = np.arange(step * width, dtype=np.int16)
    live = np.arange(m)
    while len(live):
        s = np.where(fresh[live], sims[live], -3.0)
        top = np.argpartition(-s, step - 1, axis=1)[:, :step] if step < beam else np.tile(np.arange(beam), (len(live), 1))
        good = np.take_along_axis(s, top, axis=1) > -2.0
        some = good.any(axis=1)
        if not some.all():
            live, top, good = live[some], top[some], good[some]
            if not len(live):
                break
        row = live[:, None]
        fresh[row, top] = False
        near = links[ids[row, top]].reshape(len(live), -1).copy()
        near[~np.repeat(good, width, axis=1)] = -1
        ok = near >= 0
        ok &= seen[row, near] < 0
        r, c = np.nonzero(ok)
        node = near[r, c]
        seen[live[r], node] = column[c]
        first = seen[live[r], node] == column[c]  # one of the equal nodes of a round is kept
        r, c, node = r[first], c[first], node[first]
        value = np.full(near.shape, -2.0, dtype=np.float32)
        value[r, c] = np.einsum("md,md->m", x[node], q[live[r]])
        all_ids = np.concatenate([ids[live], near], axis=1)
        all_sims = np.concatenate([sims[live], value], axis=1)
        all_fresh = np.concatenate([fresh[live], value > -2.0], axis=1)
        keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[live] = np.take_along_axis(all_ids, keep, axis=1)
        sims[live] = np.take_along_axis(all_sims, keep, axis=1)
        fresh[live] = np.take_along_axis(all_fresh, keep, axis=1)
    ids[sims <= -2.0] = -1
    return ids, sims


def diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates up to ``most``: those closer to the query than to any taken one."""
    order = np.argsort(-sims, axis=1)[:, : 2 * most]
    ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
    v = x[ids]
    between = v @ v.transpose(0, 2, 1)
    m, k = ids.shape
    taken = np.zeros((m, k), dtype=bool)
    out = np.full((m, most), -1, dtype=np.int32)
    count = np.zeros(m, dtype=np.int64)
    for i in range(k):
        close = (between[:, i, :] > sims[:, i : i + 1]) & taken
        take = (ids[:, i] >= 0) & (count < most) & ~close.any(axis=1)
        taken[:, i] = take
        out[take, count[take]] = ids[take, i]
        count += take
    for i in range(k):  # places left go to the nearest of the rest
        take = (ids[:, i] >= 0) & (count < most) & ~taken[:, i]
        out[take, count[take]] = ids[take, i]
        count += take
    return out


class Hnsw:
    """``order[i]`` is the given row of node i; ``layers[0]`` is the bottom."""

    def __init__(self, vectors: np.ndarray, seed: int = 1, beam: int = BUILD_BEAM):
        n = len(vectors)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(FORWARD)).astype(int)
        level = np.minimum(level, max(0, int(np.log(max(n, 1)) / np.log(FORWARD)) - 1))
        self.order = np.argsort(-level, kind="stable")
        self.x = np.ascontiguousarray(vectors[self.order], dtype=np.float32)
        level = level[self.order]
        self.layers: list[np.ndarray] = []
        if n == 0:
            return
        below: np.ndarray | None = None
        for at in range(int(level.max()), -1, -1):
            below = self._layer(int((level >= at).sum()), below, beam)
            self.layers.insert(0, below)

    def _layer(self, n: int, above: np.ndarray | None, beam: int) -> np.ndarray:
        links = np.full((n, FORWARD + BACKWARD), -1, dtype=np.int32)
        done = 0
        if above is not None:
            done = len(above)
            links[:done] = above
        while done < n:
            size = min(n - done, max(64, min(done, BATCH, SEEN // n)))
            q = self.x[done : done + size]
            own = q @ q.T
            np.fill_diagonal(own, -2.0)
            if done:
                ids, sims = self._search(q, beam, links[:done], self.x[:done])
            else:
                ids, sims = np.empty((size, 0), dtype=np.int32), np.empty((size, 0), dtype=np.float32)
            k = min(beam, size - 1)
            if k > 0:
                mates = np.argpartition(-own, k - 1, axis=1)[:, :k]
                ids = np.concatenate([ids, (mates + done).astype(np.int32)], axis=1)
                sims = np.concatenate([sims, np.take_along_axis(own, mates, axis=1)], axis=1)
            if ids.shape[1]:
                chosen = diverse(self.x, ids, sims, FORWARD)
                links[done : done + size, : chosen.shape[1]] = chosen
                self._link_back(links, np.arange(done, done + size), chosen)
            done += size
        return links

    def _link_back(self, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
        """Offers each new link's target the new node for its backward places."""
        src = np.repeat(new, chosen.shape[1])
        dst = chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        hit = np.unique(dst)
        old = links[hit, FORWARD:]
        a, b = np.nonzero(old >= 0)
        dst, src = np.concatenate([dst, hit[a]]), np.concatenate([src, old[a, b]])
        sim = np.einsum("md,md->m", self.x[src], self.x[dst])
        order = np.lexsort((-sim, dst))
        dst, src = dst[order], src[order]
        start = np.searchsorted(dst, hit)
        rank = np.arange(len(dst)) - np.repeat(start, np.diff(np.append(start, len(dst))))
        keep = rank < BACKWARD
        links[hit, FORWARD:] = -1
        links[dst[keep], FORWARD + rank[keep]] = src[keep]

    def _search(self, q: np.ndarray, beam: int, links: np.ndarray | None = None, x: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros(len(q), dtype=np.int64)
        upper = self.layers if links is not None else self.layers[1:]
        for layer in reversed(upper):
            ids, _ = beam_search(self.x[: len(layer)], layer, q, entry, 1)
            entry = ids[:, 0].astype(np.int64)
        return beam_search(self.x if x is None else x, self.layers[0] if links is None else links, q, entry, beam)

    def search(self, queries: np.ndarray, k: int, beam: int, rows_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, similarities) of the ``k`` nearest rows found for each query, nearest first; -1
        for none. ``rows_of``: the rows that the queries are, where the index holds them; their
        search begins at themselves instead of at the top.
        """
        node_of = None
        if rows_of is not None:
            node_of = np.empty(len(self.order), dtype=np.int64)
            node_of[self.order] = np.arange(len(self.order))
        k = min(k, len(self.x))
        rows = np.full((len(queries), k), -1, dtype=np.int64)
        sims = np.full((len(queries), k), -2.0, dtype=np.float32)
        step = max(64, min(BATCH, SEEN // max(len(self.x), 1)))
        for at in range(0, len(queries), step) if k else ():
            q = np.ascontiguousarray(queries[at : at + step], dtype=np.float32)
            if node_of is None:
                ids, s = self._search(q, max(beam, k))
            else:
                ids, s = beam_search(self.x, self.layers[0], q, node_of[rows_of[at : at + step]], max(beam, k))
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            got = np.take_along_axis(ids, best, axis=1)
            rows[at : at + step] = np.where(got >= 0, self.order[np.maximum(got, 0)], -1)
            sims[at : at + step] = np.take_along_axis(s, best, axis=1)
        return rows, sims
