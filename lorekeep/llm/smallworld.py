"""A hierarchical navigable small-world graph over unit vectors, in flat neighbour arrays.

Everything runs over whole batches of vectors: insertion takes ``BATCH`` vectors at a time
(they meet each other by one matrix product, the rest of the graph by search), and a search
advances all its queries by one step at a time.
"""

from __future__ import annotations

import numpy as np

LINKS = 16
BATCH = 1024
WIDTH = 32


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k greatest of each row, greatest first."""
    k = min(k, sims.shape[1])
    part = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.broadcast_to(np.arange(k), sims.shape)
    order = np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, order, 1)


class SmallWorld:
    """``x``: unit vectors, one row each. Node numbers are row numbers."""

    def __init__(self, x: np.ndarray, links: int = LINKS, width: int = WIDTH, seed: int = 1):
        self.x, self.links, self.width = np.ascontiguousarray(x, np.float32), links, width
        n = len(x)
        order = np.random.default_rng(seed).permutation(n)
        # a node of every `links` rises one layer; the top layer is small enough to be looked at whole
        self.layers: list[np.ndarray] = []
        tops = []
        size = n
        while size > 2 * BATCH or not tops:
            tops.append(size)
            size = max(1, size // links)
        tops.append(min(size, 256) if n > 256 else n)
        self.top = order[: tops[-1]]
        for size in reversed(tops[:-1]):
            self._build(order[:size])

    def _build(self, nodes: np.ndarray) -> None:
        near = np.full((len(self.x), self.links), -1, np.int32)
        self.layers.insert(0, near)
        done = 0
        while done < len(nodes):
            new = nodes[done : done + BATCH]
            own = self.x[new] @ self.x[new].T
            np.fill_diagonal(own, -2)
            best = _top(own, self.links)
            ids, sims = new[best], np.take_along_axis(own, best, 1)
            if done:
                found, theirs = self.search(self.x[new], self.width, upper=True)
                ids, sims = np.concatenate([found, ids], 1), np.concatenate([theirs, sims], 1)
            ids, sims = self._select(ids, sims, self.links)
            near[new] = ids
            self._link_back(near, new, ids, sims)
            done += len(new)

    def _select(self, ids: np.ndarray, sims: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """At most m of the candidates of each row: first those nearer to the row than to any chosen before, then the nearest."""
        rows = len(ids)
        order = _top(np.where(ids >= 0, sims, -2), min(ids.shape[1], 2 * m))
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        twin = np.zeros(ids.shape, bool)  # met twice, or nobody
        for j in range(1, ids.shape[1]):
            twin[:, j] = (ids[:, :j] == ids[:, j : j + 1]).any(1)
        twin |= (ids < 0) | (sims <= -2)
        vectors = self.x[np.maximum(ids, 0)]
        among = vectors @ vectors.transpose(0, 2, 1)
        chosen = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            closest = np.where(chosen[:, :j], among[:, j, :j], -2).max(1) if j else np.full(rows, -2.0)
            chosen[:, j] = ~twin[:, j] & (closest < sims[:, j])
        rank = np.where(twin, 1e6, np.where(chosen, 0, 1e3)) + np.arange(ids.shape[1])
        pick = np.argsort(rank, axis=1, kind="stable")[:, :m]
        keep = np.take_along_axis(rank, pick, 1) < 1e6
        ids, sims = np.where(keep, np.take_along_axis(ids, pick, 1), -1), np.where(keep, np.take_along_axis(sims, pick, 1), -2)
        if ids.shape[1] < m:
            ids = np.pad(ids, ((0, 0), (0, m - ids.shape[1])), constant_values=-1)
            sims = np.pad(sims, ((0, 0), (0, m - sims.shape[1])), constant_values=-2)
        return ids.astype(np.int32), sims

    def _link_back(self, near: np.ndarray, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        to, by, sim = ids.ravel(), np.repeat(new, ids.shape[1]).astype(np.int32), sims.ravel()
        real = to >= 0
        to, by, sim = to[real], by[real], sim[real]
        order = np.lexsort((-sim, to))
        to, by, sim = to[order], by[order], sim[order]
        targets, first, counts = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, counts)
        width = min(int(place.max()) + 1, self.links) if len(to) else 0
        if not width:
            return
        row = np.repeat(np.arange(len(targets)), counts)
        fits = place < width
        coming, coming_sims = np.full((len(targets), width), -1, np.int32), np.full((len(targets), width), -2, np.float32)
        coming[row[fits], place[fits]], coming_sims[row[fits], place[fits]] = by[fits], sim[fits]
        old = near[targets]
        old_sims = np.where(old >= 0, (self.x[np.maximum(old, 0)] @ self.x[targets][:, :, None])[:, :, 0], -2)
        near[targets] = self._select(np.concatenate([old, coming], 1), np.concatenate([old_sims, coming_sims], 1), self.links)[0]

    def search(self, q: np.ndarray, k: int, upper: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of (nearly) the k nearest of each query; -1 where there are fewer."""
        out_ids, out_sims = [], []
        for at in range(0, len(q), BATCH):
            part = np.ascontiguousarray(q[at : at + BATCH], np.float32)
            sims = part @ self.x[self.top].T
            best = _top(sims, 4)
            ids, sims = self.top[best].astype(np.int32), np.take_along_axis(sims, best, 1)
            for depth in range(len(self.layers) - 1, -1, -1):
                ids, sims = self._walk(part, self.layers[depth], ids, sims, max(k, self.width) if depth == 0 else 8)
            ids, sims = ids[:, :k], sims[:, :k]
            if ids.shape[1] < k:
                ids = np.pad(ids, ((0, 0), (0, k - ids.shape[1])), constant_values=-1)
                sims = np.pad(sims, ((0, 0), (0, k - sims.shape[1])), constant_values=-2)
            out_ids.append(ids)
            out_sims.append(sims)
        return np.concatenate(out_ids), np.concatenate(out_sims)

    def _walk(self, q: np.ndarray, near: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int, at_once: int = 3) -> tuple[np.ndarray, np.ndarray]:
        rows = len(q)
        pad = max(0, width - ids.shape[1])
        ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)[:, :width]
        sims = np.pad(sims, ((0, 0), (0, pad)), constant_values=-2)[:, :width].astype(np.float32)
        seen = np.zeros((rows, len(self.x)), bool)
        held = ids >= 0
        seen[np.nonzero(held)[0], ids[held]] = True
        left = held.copy()  # held but not yet expanded
        active = np.arange(rows)
        while len(active):
            turn = np.where(left[active], sims[active], -3)
            pick = _top(turn, at_once)
            real = np.take_along_axis(turn, pick, 1) > -3
            nodes = np.where(real, np.take_along_axis(ids[active], pick, 1), 0)
            left[active[:, None], pick] = False
            reached = np.where(real[:, :, None], near[nodes], -1).reshape(len(active), -1)
            r, c = np.nonzero(reached >= 0)
            to, who = reached[r, c], active[r]
            fresh = ~seen[who, to]
            r, c, to, who = r[fresh], c[fresh], to[fresh], who[fresh]
            seen[who, to] = True
            new = np.full(reached.shape, -2, np.float32)
            new[r, c] = np.einsum("ij,ij->i", self.x[to], q[who])
            # the same node may have been reached twice in one step
            key = who.astype(np.int64) * len(self.x) + to
            once = np.zeros(len(key), bool)
            once[np.unique(key, return_index=True)[1]] = True
            new[r[~once], c[~once]] = -2
            all_sims, all_ids = np.concatenate([sims[active], new], 1), np.concatenate([ids[active], reached], 1)
            all_left = np.concatenate([left[active], new > -2], 1)
            best = _top(all_sims, width)
            sims[active] = np.take_along_axis(all_sims, best, 1)
            ids[active] = np.where(sims[active] > -2, np.take_along_axis(all_ids, best, 1), -1)
            left[active] = np.take_along_axis(all_left, best, 1) & (sims[active] > -2)
            active = active[left[active].any(1)]
        return ids, sims

    def arrays(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Vectors, top nodes and the neighbour array of each layer: all that a search needs."""
        return self.x, np.asarray(self.top, np.int32), self.layers

    @classmethod
    def of_arrays(cls, x: np.ndarray, top: np.ndarray, layers: list[np.ndarray], width: int = WIDTH) -> "SmallWorld":
        """A graph from its arrays, as it was."""
        graph = cls.__new__(cls)
        graph.x, graph.top, graph.layers, graph.width, graph.links = x, top, layers, width, layers[0].shape[1]
        return graph
