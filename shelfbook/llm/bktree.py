"""Burkhard-Keller trees over 64-bit fingerprints: a child hangs at its Hamming distance from the parent.

Trees of many shards are built and searched together, level by level, with whole arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDEST = 65  # distances of 64-bit fingerprints are 0 to 64


class Forest:
    """One tree per shard. ``points`` of a shard are distinct; ``shards`` is ascending."""

    def __init__(self, points: np.ndarray, shards: np.ndarray):
        self.points = points
        self.root = np.searchsorted(shards, shards)  # the first point of its shard
        parent = np.full(len(points), -1)
        edge = np.zeros(len(points), np.int64)
        rest = np.flatnonzero(self.root != np.arange(len(points)))
        at = self.root[rest]
        while len(rest):
            away = np.bitwise_count(points[rest] ^ points[at]).astype(np.int64)
            _, first, group = np.unique(at * WIDEST + away, return_index=True, return_inverse=True)
            child = rest[first]  # the first comer takes the edge, the others go down it
            parent[child], edge[child] = at[first], away[first]
            below = child[group] != rest
            rest, at = rest[below], child[group][below]
        # Children by (parent, distance), so that a range of distances is a run of this list.
        self.children = np.flatnonzero(parent >= 0)
        place = parent[self.children] * WIDEST + edge[self.children]
        self.children = self.children[np.argsort(place, kind="stable")]
        self.place = np.sort(place)

    def within(self, radius: int, step: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, point) of one shard at most ``radius`` apart, every point being a query once."""
        for first in range(0, len(self.points), step):
            todo = [(np.arange(first, min(first + step, len(self.points))), None)]
            while todo:
                query, node = todo.pop()
                node = self.root[query] if node is None else node
                away = np.bitwise_count(self.points[query] ^ self.points[node]).astype(np.int64)
                near = (away <= radius) & (query > node)
                yield query[near], node[near]
                # Only edges whose distance differs from the query's by the radius at most can lead to a hit.
                low = np.searchsorted(self.place, node * WIDEST + np.maximum(away - radius, 0))
                high = np.searchsorted(self.place, node * WIDEST + np.minimum(away + radius, WIDEST - 1), "right")
                many = high - low
                ends = np.cumsum(many)
                query = np.repeat(query, many)
                node = self.children[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many - low, many)]
                todo += [(query[i : i + step], node[i : i + step]) for i in range(0, len(query), step)]

    def stars(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Links (point, smallest point of its group) that join all points within ``radius`` of each other."""
        label = np.arange(len(self.points))
        for a, b in self.within(radius):
            while len(a):  # merge the groups of the two ends until every pair agrees
                a, b = label[a], label[b]
                apart = a != b
                a, b = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
                np.minimum.at(label, a, b)
                while not np.array_equal(label, label[label]):
                    label = label[label]
        order = np.lexsort((self.points, label))
        _, first, group = np.unique(label[order], return_index=True, return_inverse=True)
        least = self.points[order][first][group]
        linked = self.points[order] != least
        return self.points[order][linked], least[linked]
