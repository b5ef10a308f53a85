"""Exact Jaccard join of the sets in one region of the metric space, in memory.

Pivots create Voronoi cells. With d = 1 - Jaccard, a set whose nearest pivot is i
can only be linked (d <= eps) into the cell of pivot j if d(x, j) <= d(x, i) + 2 eps,
so exactly those sets are replicated into cell j as its halo. Cells are joined
recursively. Where pivots no longer separate anything, sets are eliminated one by
one: each is held against those that the distances to all earlier pivots, the
sizes and the links already known leave over.

Links are returned as a spanning forest: a pair that is known to be connected
isn't looked at again, so a group of n copies gives n - 1 links, not n * n.
"""

from __future__ import annotations

import numpy as np

NUMERATOR, DENOMINATOR = 80, 100
EPS = 1 - NUMERATOR / DENOMINATOR
SLACK = 1e-9
LEAF, PIVOTS = 24, 6


class Region:
    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.ends = np.cumsum(self.sizes)
        self.codes = codes
        self.mark = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
        self.root = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def own(self, x: int) -> np.ndarray:
        return self.codes[self.ends[x] - self.sizes[x] : self.ends[x]]

    def compare(self, pivot: int, others: np.ndarray) -> np.ndarray:
        """Distances from the pivot; links what is near enough."""
        if len(others) == 0:
            return np.empty(0)
        self.mark[self.own(pivot)] = 1
        sizes = self.sizes[others]
        if len(others) == len(self.sizes):
            held, starts = self.mark[self.codes], self.ends - self.sizes
        else:
            starts = np.cumsum(sizes) - sizes
            held = self.mark[np.concatenate([self.own(x) for x in others])]
        inter = np.add.reduceat(held, starts)
        self.mark[self.own(pivot)] = 0
        union = sizes + self.sizes[pivot] - inter
        for x in others[DENOMINATOR * inter >= NUMERATOR * union]:
            a, b = self.find(pivot), self.find(int(x))
            if a != b:
                self.root[a] = b
                self.links.append((pivot, int(x)))
        return 1 - inter / union

    def join(self, core: np.ndarray, halo: np.ndarray) -> None:
        """Finds all links with an end in the core and the other in core or halo."""
        members = np.concatenate([core, halo])
        if len(members) <= LEAF or len(core) <= 2:
            return self.eliminate(core, halo, np.empty((len(members), 0)))
        pivots = core[np.unique(np.linspace(0, len(core) - 1, min(PIVOTS, 2 + len(core) // LEAF)).astype(int))]
        to = np.stack([self.compare(int(p), members) for p in pivots], axis=1)
        near = to.argmin(axis=1)
        least = to[np.arange(len(members)), near]
        in_core = np.arange(len(members)) < len(core)
        done = np.isin(members, pivots)  # held against everyone
        cells = []
        for j in range(len(pivots)):
            inside = (near == j) & in_core & ~done
            around = ~inside & ~done & (to[:, j] <= least + 2 * EPS + SLACK)
            cells.append((np.flatnonzero(inside), np.flatnonzero(around)))
        if max(len(a) + len(b) for a, b in cells) > 0.7 * len(members):
            keep = np.flatnonzero(~done)
            inner = keep[keep < len(core)]
            outer = keep[keep >= len(core)]
            return self.eliminate(members[inner], members[outer], to[np.concatenate([inner, outer])])
        for inside, around in cells:
            if len(inside):
                self.join(members[inside], members[around])
        return None

    def eliminate(self, core: np.ndarray, halo: np.ndarray, to: np.ndarray) -> None:
        members = np.concatenate([core, halo])
        sizes = self.sizes[members]
        for i in range(len(core)):
            x = int(members[i])
            n = sizes[i]
            left = np.arange(i + 1, len(members))
            left = left[(DENOMINATOR * np.minimum(sizes[left], n) >= NUMERATOR * np.maximum(sizes[left], n))]
            if to.shape[1]:
                left = left[(np.abs(to[left] - to[i]) <= EPS + SLACK).all(axis=1)]
            if len(left):
                mine = self.find(x)
                others = np.array([m for m in members[left].tolist() if self.find(m) != mine], np.int64)
                self.compare(x, others)


def join_region(sets: list[np.ndarray], pivot: int | None = None, known: list | None = None) -> tuple[list[tuple[int, int]], np.ndarray | None, list[int]]:
    """Spanning links of the region, each set's distance to the pivot, and each set's component.

    Sets with the same ``known``, unless it is None, are connected already.
    """
    region = Region(sets)
    first: dict = {}
    for x, label in enumerate(known or ()):
        if label is not None:
            region.root[region.find(x)] = region.find(first.setdefault(label, x))
    everyone = np.arange(len(sets))
    to = None
    if pivot is not None:
        to = region.compare(pivot, everyone)
        loose = [x for x in range(len(sets)) if x != pivot and region.find(x) != region.find(pivot)]
        # Sets tied to the pivot are connected; only pairs with a loose set are open, inside its window.
        if loose:
            low, high = to[loose].min() - EPS - SLACK, to[loose].max() + EPS + SLACK
            held = set(loose)
            halo = [x for x in range(len(sets)) if x not in held and x != pivot and low <= to[x] <= high]
            region.join(np.array(loose), np.array(halo, np.int64))
    else:
        region.join(everyone, np.empty(0, np.int64))
    return region.links, to, [region.find(x) for x in range(len(sets))]
