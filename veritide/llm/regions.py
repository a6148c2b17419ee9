"""Exact Jaccard joins of one region of the Jaccard metric space within a task.

Every region has a pivot. Distances from it decide which members are linked to it and which pairs the
triangle inequality rules out. A region of more than LEAF members gets further pivots: they split
it into Voronoi cells, and a member also joins every cell whose pivot is at most 2r farther than
its nearest (a neighbour within r could live there). Cells are joined recursively, each with pivots
of its own; where the windows hold nearly everything, members are tested one by one against those
that the pivots' distances and the sizes leave possible. Jaccard tests are exact integer comparisons.
"""

from __future__ import annotations

import numpy as np

FEW, LEAF, PIVOTS, DEPTH, EPS = 5, 16, 8, 6, 1e-9


class Group:
    """Sets of one region, as sorted arrays, and the union-find over their links.

    hints (same hint: linked already) and active (only pairs with an active member need a test) come
    from the levels above. cells counts the Voronoi cells made by depth.
    """

    def __init__(self, sets: list[np.ndarray], percent: int, hints: list[int | None] | None = None, active: np.ndarray | None = None):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.offs = np.concatenate([[0], np.cumsum(self.sizes)])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        _, self.flat = np.unique(flat, return_inverse=True)
        self.mark = np.zeros(int(self.flat.max()) + 1 if len(self.flat) else 1, dtype=np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(self.flat, kind="stable")
        self.holders = owner[order]
        self.spread = np.bincount(self.flat, minlength=len(self.mark))
        self.begin = np.cumsum(self.spread) - self.spread
        self.percent, self.r = percent, 1 - percent / 100
        self.parent = list(range(len(sets)))
        self.active = np.ones(len(sets), dtype=bool) if active is None else active
        self.cells: dict[int, int] = {}
        seen: dict[int, int] = {}
        for i, h in enumerate(hints or ()):
            if h is not None:
                self.union(seen.setdefault(h, i), i)

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def roots(self, ids: np.ndarray) -> np.ndarray:
        return np.array([self.find(int(i)) for i in ids], dtype=np.int64)

    def common(self, p: int, ids: np.ndarray) -> np.ndarray:
        """Shared elements of p and each of ids: by the holders of p's elements, or by looking through ids, as is shorter."""
        own = self.flat[self.offs[p] : self.offs[p + 1]]
        size, spread = self.sizes[ids], self.spread[own]
        if spread.sum() < size.sum():
            ends = np.cumsum(spread)
            at = np.arange(ends[-1]) + np.repeat(self.begin[own] - (ends - spread), spread)
            return np.bincount(self.holders[at], minlength=len(self.sizes))[ids]
        self.mark[own] = 1
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offs[ids] - (ends - size), size)
        total = np.concatenate([[0], np.cumsum(self.mark[self.flat[at]])])
        self.mark[own] = 0
        return total[ends] - total[ends - size]

    def measure(self, p: int, ids: np.ndarray) -> np.ndarray:
        """Distances of ids from p; every link found on the way is kept."""
        both = self.common(p, ids)
        union = self.sizes[p] + self.sizes[ids] - both
        for i in ids[100 * both >= self.percent * union]:
            self.union(p, int(i))
        return 1 - both / union

    def open(self, ids: np.ndarray) -> bool:
        """Can a test among ids still join components?"""
        return bool(self.active[ids].any()) and len(np.unique(self.roots(ids))) > 1

    def join(self, ids: np.ndarray, depth: int = 0) -> None:
        """Every link among ids that an active member has is within one component afterwards. The first of ids is the first pivot."""
        far, picks, p = np.full(len(ids), np.inf), [], 0
        for _ in range(1 if len(ids) <= LEAF else PIVOTS):
            picks.append(self.measure(int(ids[p]), ids))
            far = np.minimum(far, picks[-1])
            p = int(np.argmax(far))
            if far[p] <= self.r:
                break  # every member is linked to a pivot
        if not self.open(ids):
            return
        dist = np.array(picks)
        if len(picks) == 1 or depth >= DEPTH:
            return self.search(ids, dist)
        nearest, least = dist.argmin(axis=0), dist.min(axis=0)
        window = dist <= least + 2 * self.r + EPS
        inside = [window[j] | (nearest == j) for j in range(len(dist)) if (nearest == j).any()]
        if sum(int(x.sum()) ** 2 for x in inside) > 0.7 * len(ids) ** 2:
            return self.search(ids, dist)  # the windows hold nearly everything: no cell shrinks
        self.cells[depth] = self.cells.get(depth, 0) + len(inside)
        for x in inside:
            if self.open(ids[x]):
                self.join(ids[x], depth + 1)

    def search(self, ids: np.ndarray, dist: np.ndarray) -> None:
        """Tests each member against those of other components that sizes and pivots leave possible."""
        order = np.argsort(self.sizes[ids], kind="stable")
        ids, dist = ids[order], dist[:, order]
        size, active = self.sizes[ids], self.active[ids]
        root = self.roots(ids)
        for i in range(len(ids) - 1):
            to = int(np.searchsorted(size, size[i] * 100 // self.percent, side="right"))
            if to <= i + 1:
                continue
            near = (root[i + 1 : to] != root[i]) & (active[i] | active[i + 1 : to])
            if near.any():
                near &= (np.abs(dist[:, i + 1 : to] - dist[:, i : i + 1]) <= self.r + EPS).all(axis=0)
            if not near.any():
                continue
            others = ids[i + 1 : to][near]
            both = self.common(int(ids[i]), others)
            hit = 100 * both >= self.percent * (size[i] + self.sizes[others] - both)
            linked = others[hit]
            if len(linked):
                joined = np.unique(np.append(root[i + 1 : to][near][hit], root[i]))
                for x in linked:
                    self.union(int(ids[i]), int(x))
                root[np.isin(root, joined)] = self.find(int(ids[i]))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets have in common."""
    both = np.concatenate([a, b])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def few(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """linked() for a handful of sets: distances from the first, then the pairs that these leave possible."""
    root, size, from_first = list(range(len(sets))), [len(s) for s in sets], [0.0]
    for j in range(1, len(sets)):
        for i in range(j):
            if root[i] == root[j] and i or i and abs(from_first[i] - from_first[j]) > 1 - percent / 100 + EPS:
                continue
            both = 0 if i and 100 * min(size[i], size[j]) < percent * max(size[i], size[j]) else shared(sets[i], sets[j])
            union = size[i] + size[j] - both
            if i == 0:
                from_first.append(1 - both / union)
            if 100 * both >= percent * union:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return np.array(root, dtype=np.int64)


def linked(sets: list[np.ndarray], percent: int, hints: list[int | None] | None = None, active: np.ndarray | None = None) -> np.ndarray:
    """For each set the first index of its component under 100 * |x & y| >= percent * |x | y|; the first set is the region's pivot.

    Members of one hint count as linked; of pairs without an active member, only some are tested. Sets must not be empty.
    """
    if len(sets) <= FEW and active is None and not any(h is not None for h in hints or ()):
        return few(sets, percent)
    g = Group(sets, percent, hints, active)
    everything = np.arange(len(sets))
    if len(sets) > 1 and g.open(everything):
        g.join(everything)
    return g.roots(everything)
