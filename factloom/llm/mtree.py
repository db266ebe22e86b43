"""An M-tree of integer vectors, in pages, and best-first search for the largest inner products.

Inner products become distances: with m2 the largest squared length, a vector x gets one more component sqrt(m2 - x.x) and
a query q a zero, so that d(q, x)^2 = q.q + m2 - 2 q.x. Scores are computed exactly; distances only decide what need not
be looked at, with a margin for their rounding.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: Entries of a page, and how many children a page of others gets at most.
PAGE, FANOUT = 128, 16
#: Of the largest length: far more than rounding takes from a distance.
MARGIN = 1e-6


@dataclass
class Page:
    """Entries with their distances `own` to the page's router and their covering radii (0 for objects). keys are child
    pages or, in a leaf, objects, for which `least` breaks ties."""

    leaf: bool
    vectors: np.ndarray
    own: np.ndarray
    radii: np.ndarray
    keys: np.ndarray
    least: np.ndarray


def lifted(x: np.ndarray, m2: float) -> np.ndarray:
    """Vectors with the component that turns inner products into distances."""
    x = x.astype(np.float64)
    return np.c_[x, np.sqrt(np.maximum(0.0, m2 - np.einsum("ij,ij->i", x, x)))]


def apart(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(x - to).sum(axis=1))


def grow(vectors: np.ndarray, keys: np.ndarray, least: np.ndarray, m2: float, page: int = PAGE, fanout: int = FANOUT) -> tuple[list[Page], int, float]:
    """pages (children before parents, the root last), the root's router (a row) and its covering radius, of all rows."""
    x, pages = lifted(vectors, m2), []

    def build(rows: np.ndarray) -> tuple[int, int, float]:
        middle = x[rows].mean(axis=0)
        if len(rows) <= page:
            router = rows[np.argmin(apart(x[rows], middle))]
            own = apart(x[rows], x[router])
            pages.append(Page(True, vectors[rows], own, np.zeros(len(rows)), keys[rows], least[rows]))
            return len(pages) - 1, router, float(own.max())
        n = min(fanout, -(-len(rows) // page) + 1)
        seeds = rows[np.linspace(0, len(rows) - 1, n).astype(int)]
        near = np.argmin([apart(x[rows], x[s]) for s in seeds], axis=0)
        groups = [rows[near == i] for i in range(n)]
        if max(map(len, groups)) > 0.9 * len(rows):  # hardly told apart: by distance from the middle
            groups = np.array_split(rows[np.argsort(apart(x[rows], middle), kind="stable")], n)
        children = [build(g) for g in groups if len(g)]
        heads = np.array([r for _, r, _ in children])
        router = heads[np.argmin(apart(x[heads], middle))]
        radii = np.array([r for _, _, r in children])
        pages.append(Page(False, vectors[heads], apart(x[heads], x[router]), radii, np.array([p for p, _, _ in children], np.int64), np.zeros(len(heads), np.int64)))
        return len(pages) - 1, router, float(apart(x[rows], x[router]).max())

    _, router, radius = build(np.arange(len(vectors)))
    return pages, int(router), radius


class Search:
    """Queries over the pages of one tree. computed counts the distances and scores that were worked out."""

    def __init__(self, pages: list[Page], radius: float, m2: int, k: int, exact: type = np.float64):
        self.pages, self.radius, self.m2, self.k, self.exact, self.computed = pages, radius, m2, k, exact, 0
        self.margin = MARGIN * m2**0.5 + MARGIN

    def reach(self, q2: int, score: int | None) -> float:
        """The distance beyond which nothing scores as much."""
        return np.inf if score is None else max(0.0, float(q2 + self.m2 - 2 * score)) ** 0.5 + self.margin

    def run(self, query: np.ndarray, to_root: float, at_least: int | None = None) -> list[tuple[int, int, int]]:
        """(score, least, key) of the k best objects by score, then least; only those that score at_least, where given.
        to_root: the query's distance to the root's router."""
        q, q2 = query.astype(self.exact), int(query.astype(object) @ query.astype(object)) if len(query) else 0
        best: list[tuple[int, int, int]] = []
        limit = self.reach(q2, at_least)
        heap = [(max(0.0, to_root - self.radius), len(self.pages) - 1, to_root)]
        while heap:
            low, number, d = heapq.heappop(heap)
            if low > limit:
                break
            p = self.pages[number]
            # |d(q, router) - d(entry, router)| bounds d(q, entry) from below before it is computed.
            rows = np.flatnonzero(np.abs(d - p.own) <= p.radii + limit)
            if not len(rows):
                continue
            self.computed += len(rows)
            scores = p.vectors[rows].astype(self.exact, copy=False) @ q
            if not p.leaf:
                far = np.sqrt(np.maximum(0.0, q2 + self.m2 - 2.0 * scores))
                lows = np.maximum(0.0, far - p.radii[rows])
                for i in np.flatnonzero(lows <= limit):
                    heapq.heappush(heap, (float(lows[i]), int(p.keys[rows[i]]), float(far[i])))
                continue
            floor = best[-1][0] if len(best) == self.k else at_least
            good = rows if floor is None else rows[scores >= floor]
            if not len(good):
                continue
            own = [(int(s), int(p.least[i]), int(p.keys[i])) for s, i in zip(scores if floor is None else scores[scores >= floor], good)]
            best = heapq.nsmallest(self.k, best + own, key=lambda b: (-b[0], b[1], b[2]))
            if len(best) == self.k:
                limit = min(limit, self.reach(q2, best[-1][0]))
        return best
