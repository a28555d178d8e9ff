"""Hierarchical navigable small-world graph of one shard, in flat arrays.

The graph is built by batches of insertions: every vector of a batch walks
the graph as it stands, in lockstep with the others of its batch, so that one
step of all walks is a handful of numpy calls and no Python runs per vector.
Nodes are numbered in insertion order with those of the upper layers first,
so a layer is a prefix of the node numbers.

Per node there are two flat rows of neighbour numbers: ``near`` holds the
nearest nodes met so far (kept exact under insertion on either side) and
``far`` holds links chosen for direction, so that dense groups stay joined to
the rest of the shard.
"""

from __future__ import annotations

import numpy as np

SCAN = 512  # the uppermost layer has at most this many nodes and is scanned by one matrix product; those below are walked


def _unique_rows(cand: np.ndarray, stamp: np.ndarray, base: int) -> np.ndarray:
    """Mask of the first place of each number in a row of ``cand``; -1 never counts."""
    b, m = cand.shape
    rows = np.arange(b)[:, None]
    pos = base + np.arange(m, dtype=stamp.dtype)[None, :]
    stamp[rows, cand] = pos
    return (stamp[rows, cand] == pos) & (cand >= 0)


class Graph:
    """One shard's graph over unit vectors ``x``.

    ``near``/``near_sim`` give for each row of ``x`` its nearest rows and their
    cosines, nearest first; free places hold -1 and -2.0.
    """

    def __init__(
        self,
        x: np.ndarray,
        k: int = 5,
        links: int = 8,
        ef: int = 20,
        width: int = 4,
        ratio: int = 16,
        batch: int = 1024,
        down: int = 2,
        seed: int = 7,
    ):
        n, self.dim = x.shape
        self.down = down
        self.k, self.links, self.ef, self.width, self.ratio = max(k, links), links, max(ef, k + 1), width, ratio
        self.order = np.random.default_rng(seed).permutation(n)
        self.x = np.ascontiguousarray(x[self.order], dtype=np.float32)
        self.n, self.batch = n, batch
        self.near = np.full((n, self.k), -1, np.int32)
        self.near_sim = np.full((n, self.k), -2.0, np.float32)
        self.far = np.full((n, links), -1, np.int32)
        self.layers: list[tuple[int, np.ndarray]] = []
        self._stamp, self._tick = np.zeros((1, 1), np.int32), 1
        if n:
            self._build()

    # -- building --------------------------------------------------------------
    def _build(self) -> None:
        sizes = [self.n]
        while sizes[-1] > SCAN and sizes[-1] // self.ratio > 1:
            sizes.append(sizes[-1] // self.ratio)
        if len(sizes) == 1 and self.n > self.ratio * 8:
            sizes.append(max(64, self.n // self.ratio))
        first = min(self.n, max(256, sizes[-1]))
        for a in range(0, first, self.batch):
            self._link(a, min(first, a + self.batch), *self._scan(a, min(first, a + self.batch), first))
        if len(sizes) > 1:
            self.layers.append((sizes[-1], np.empty((0, 0), np.int32)))
        for size in reversed(sizes[1:-1]):
            # a walked upper layer keeps its links; the layers below go on from them
            self._insert(first, size)
            self.layers.insert(0, (size, np.concatenate([self.near[:size], self.far[:size]], 1)))
            first = size
        self._insert(first, self.n)
        self._join_near(self.n)

    def _insert(self, a: int, n: int) -> None:
        while a < n:
            b = min(n, a + min(self.batch, max(256, a // 2)))
            ids, sims = self.search(self.x[a:b], upto=a)
            own = self.x[a:b] @ self.x[a:b].T
            np.fill_diagonal(own, -2.0)
            take = min(self.links, b - a)
            p = np.argpartition(-own, take - 1, axis=1)[:, :take]
            ids = np.concatenate([ids, (p + a).astype(np.int32)], 1)
            sims = np.concatenate([sims, np.take_along_axis(own, p, 1)], 1)
            self._link(a, b, ids, sims)
            a = b

    def _scan(self, a: int, b: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
        s = self.x[a:b] @ self.x[:upto].T
        s[np.arange(b - a), np.arange(a, b)] = -2.0
        take = min(self.ef, upto)
        p = np.argpartition(-s, take - 1, axis=1)[:, :take]
        return p.astype(np.int32), np.take_along_axis(s, p, 1)

    def _link(self, a: int, b: int, ids: np.ndarray, sims: np.ndarray) -> None:
        """Give the nodes a..b their links among ``ids`` and the links back."""
        ids = np.where(sims > -1.5, ids, -1)
        top = np.argsort(-sims, axis=1, kind="stable")[:, : self.ef]
        ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
        w = min(self.k, ids.shape[1])
        self.near[a:b, :w], self.near_sim[a:b, :w] = ids[:, :w], np.where(ids[:, :w] >= 0, sims[:, :w], -2.0)
        # far: in order of nearness, what is nearer to the node than to any link chosen before
        v = self.x[np.maximum(ids, 0)]
        between = v @ v.transpose(0, 2, 1)
        chosen = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            chosen[:, j] = (ids[:, j] >= 0) & ~(chosen[:, :j] & (between[:, j, :j] > sims[:, j, None])).any(1)
        rank = np.cumsum(chosen, 1) - 1
        r, c = np.nonzero(chosen & (rank < self.links))
        self.far[a + r, rank[r, c]] = ids[r, c]
        r, c = np.nonzero(ids >= 0)
        self._back(ids[r, c], (a + r).astype(np.int32), sims[r, c])

    def _back(self, dst: np.ndarray, src: np.ndarray, sim: np.ndarray) -> None:
        """Offer src to dst's rows: into ``near`` if near enough, else a free place of ``far``."""
        free = (self.far[dst, -1] < 0) | (sim > self.near_sim[dst, -1])
        dst, src, sim = dst[free], src[free], sim[free]
        if not len(dst):
            return
        o = np.lexsort((-sim, dst))
        dst, src, sim = dst[o], src[o], sim[o]
        start = np.r_[True, dst[1:] != dst[:-1]]
        at = np.maximum.accumulate(np.where(start, np.arange(len(dst)), 0))
        rank, row = np.arange(len(dst)) - at, np.cumsum(start) - 1
        node = dst[start]
        m = self.k
        keep = rank < m
        new_i = np.full((len(node), m), -1, np.int32)
        new_s = np.full((len(node), m), -2.0, np.float32)
        new_i[row[keep], rank[keep]], new_s[row[keep], rank[keep]] = src[keep], sim[keep]
        # a pair met before, on the other side of the same batch, is no second link
        known = (new_i[:, :, None] == self.near[node][:, None, :]).any(2)
        new_s[known] = -2.0
        all_i = np.concatenate([self.near[node], new_i], 1)
        all_s = np.concatenate([self.near_sim[node], new_s], 1)
        top = np.argsort(-all_s, axis=1, kind="stable")
        all_i, all_s = np.take_along_axis(all_i, top, 1), np.take_along_axis(all_s, top, 1)
        all_i[all_s < -1.5] = -1
        self.near[node], self.near_sim[node] = all_i[:, :m], all_s[:, :m]
        # what falls out of near takes the free places of far
        used = (self.far[node] >= 0).sum(1)
        r, c = np.nonzero((all_i[:, m:] >= 0) & (used[:, None] + np.arange(all_i.shape[1] - m) < self.links))
        self.far[node[r], used[r] + c] = all_i[r, m + c]

    def _join_near(self, n: int) -> None:
        """One round of meeting the neighbours' neighbours: mends what a later insertion hid."""
        w = min(self.k, 6)
        for a in range(0, n, self.batch):
            b = min(n, a + self.batch)
            near = self.near[a:b, :w]
            cand = np.where(near[:, :, None] >= 0, self.near[np.maximum(near, 0)][:, :, :w], -1).reshape(b - a, -1)
            cand[cand == np.arange(a, b)[:, None]] = -1
            cand[(cand[:, :, None] == self.near[a:b][:, None, :]).any(2)] = -1
            sims = self._sims(self.x[a:b], cand)
            sims[~self._first(cand)] = -2.0
            all_i = np.concatenate([self.near[a:b], cand], 1)
            all_s = np.concatenate([self.near_sim[a:b], sims], 1)
            top = np.argsort(-all_s, axis=1, kind="stable")[:, : self.k]
            self.near[a:b], self.near_sim[a:b] = np.take_along_axis(all_i, top, 1), np.take_along_axis(all_s, top, 1)
            self.near[a:b][self.near_sim[a:b] < -1.5] = -1

    # -- walking ---------------------------------------------------------------
    def _marks(self, b: int) -> None:
        if self._stamp.shape[0] < b or self._stamp.shape[1] < self.n + 1 or self._tick > 1 << 30:
            self._stamp, self._tick = np.zeros((max(b, self.batch), self.n + 1), np.int32), 1

    def _first(self, cand: np.ndarray) -> np.ndarray:
        b, m = cand.shape
        self._marks(b)
        base, self._tick = self._tick, self._tick + m
        return _unique_rows(cand, self._stamp[:b], base)

    def _sims(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.matmul(self.x[np.maximum(ids, 0)], q[:, :, None])[:, :, 0]

    def _entries(self, q: np.ndarray, upto: int) -> np.ndarray:
        """Where the walk of layer 0 begins: down the upper layers to their nearest nodes."""
        if not self.layers:
            return np.zeros((len(q), 1), np.int32)
        at = None
        for size, links in reversed(self.layers):
            size = min(size, upto)
            if not links.size:
                groups = min(4, size)
                cut = size // groups
                s = (q @ self.x[: cut * groups].T).reshape(len(q), groups, cut)
                at = (s.argmax(2) + np.arange(groups) * cut).astype(np.int32)
            else:
                at, _ = self._walk(q, at, links, self.down, 1)
        return at

    def _walk(self, q: np.ndarray, at: np.ndarray, links: np.ndarray | None, ef: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walks of all rows of q in lockstep; ``width`` nodes are opened a step."""
        b = len(q)
        self._marks(b)
        begun = self._tick
        ids = np.full((b, ef), -1, np.int32)
        sims = np.full((b, ef), -2.0, np.float32)
        opened = np.zeros((b, ef), bool)
        rows = np.arange(b)
        fresh, s = at, self._sims(q, at)
        while len(rows):
            pos = self._tick + np.arange(fresh.shape[1], dtype=np.int32)[None, :]
            self._tick += fresh.shape[1]
            r = rows[:, None]
            old = self._stamp[r, fresh]
            unseen = (old < begun) & (fresh >= 0)
            self._stamp[r, fresh] = np.where(unseen, pos, old)
            ok = unseen & (self._stamp[r, fresh] == pos)
            if s is None:
                s = self._sims(q[rows], fresh)
            s = np.where(ok, s, -2.0)
            all_s = np.concatenate([sims[rows], s], 1)
            top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            all_i = np.concatenate([ids[rows], fresh], 1)
            all_o = np.concatenate([opened[rows], np.zeros(fresh.shape, bool)], 1)
            i, s, o = (np.take_along_axis(z, top, 1) for z in (all_i, all_s, all_o))
            key = np.where(o | (s < -1.5), -3.0, s)
            w = min(width, ef)
            nxt = np.argpartition(-key, w - 1, axis=1)[:, :w]
            go = np.take_along_axis(key, nxt, 1) > -2.5
            np.put_along_axis(o, nxt, True, 1)
            ids[rows], sims[rows], opened[rows] = i, s, o
            alive = go.any(1)
            rows, i, nxt, go = rows[alive], i[alive], nxt[alive], go[alive]
            if not len(rows):
                break
            node = np.take_along_axis(i, nxt, 1)
            near = np.concatenate([self.near[node], self.far[node]], 2) if links is None else links[node]
            fresh = np.where(go[:, :, None], near, -1).reshape(len(rows), -1)
            s = None
        return np.where(sims > -1.5, ids, -1), sims

    def search(self, q: np.ndarray, upto: int | None = None, ef: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nodes near each row of q and their cosines, unordered, -1 where none."""
        q = np.ascontiguousarray(q, np.float32)
        if not self.n:
            return np.full((len(q), 1), -1, np.int32), np.full((len(q), 1), -2.0, np.float32)
        return self._walk(q, self._entries(q, upto or self.n), None, ef or self.ef, self.width)

    # -- results ---------------------------------------------------------------
    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """For each row of the given ``x``: numbers of its nearest rows (-1: none) and the cosines."""
        ids, sims = np.empty_like(self.near), np.empty_like(self.near_sim)
        ids[self.order] = np.where(self.near >= 0, self.order[np.maximum(self.near, 0)], -1)
        sims[self.order] = self.near_sim
        return ids, sims
