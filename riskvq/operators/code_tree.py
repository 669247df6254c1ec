"""Exact nearest codes through a metric tree (M1, T3).

The codes of a codebook are split in halves along the line between two far
codes until a part has at most ``LEAF`` of them; every part keeps its centre and
radius.  By the triangle inequality a code of a part lies no closer to a row
than the distance to the part's centre less the radius.  Rows of a batch are
searched together: each row first descends to a home leaf, which bounds its k-th
best distance; then parts are visited from the root, each with the rows whose
bound it can still beat.  In a leaf a matrix product ranks codes, and the ones
that could enter the k best are measured exactly, so results, ties included
(lower ``code_id`` first), equal those of measuring every code.

The search starts from distances already known, so a codebook in several parts
is searched one part after the other (``large_codebook``).
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need numpy, not this package

LEAF = 48


class CodeTree:
    """Codes ``w`` (K x D) with ids (K) in a binary tree of balls."""

    def __init__(self, ids: np.ndarray, w: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(w))
        self.low, self.high, self.child, centres = [], [], [], []
        todo = [(0, len(w), -1)]
        while todo:  # every node before its children; the left one directly after it
            a, b, parent = todo.pop()
            node = len(self.low)
            if parent >= 0:
                self.child[parent].append(node)
            part = w[self.order[a:b]]
            centre = part.mean(axis=0) if len(part) else np.zeros(w.shape[1])
            self.low.append(a)
            self.high.append(b)
            self.child.append([])
            centres.append(centre)
            if b - a > leaf:
                from_centre = ((part - centre) ** 2).sum(axis=1)
                one = part[from_centre.argmax()]
                other = part[((part - one) ** 2).sum(axis=1).argmax()]
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(part @ (other - one), mid)]
                todo += [(a + mid, b, node), (a, a + mid, node)]
        self.centres = np.array(centres).reshape(len(centres), -1)
        self.w, self.ids = w[self.order], ids[self.order]
        self.norms = np.einsum("kd,kd->k", self.w, self.w)
        self.radius = np.array([np.sqrt(((self.w[a:b] - c) ** 2).sum(axis=1)).max() if b > a else 0.0
                                for a, b, c in zip(self.low, self.high, self.centres, strict=True)])
        self.slack = 64.0 * max(w.shape[1], 1) * np.finfo(np.float64).eps  # rounding of squared distances, generous
        self.evaluations = 0

    def _to_centre(self, x: np.ndarray, node: int) -> np.ndarray:
        self.evaluations += len(x)
        return np.sqrt(((x - self.centres[node]) ** 2).sum(axis=1))

    def _scan(self, node: int, rows: np.ndarray, x: np.ndarray, xx: np.ndarray, dist: np.ndarray, ids: np.ndarray,
              places: np.ndarray) -> None:
        """Let the codes of a leaf compete for the k best of the rows."""
        a, b = self.low[node], self.high[node]
        self.evaluations += len(rows) * (b - a)
        rough = xx[rows, None] - 2.0 * (x[rows] @ self.w[a:b].T) + self.norms[None, a:b]
        allowed = dist[rows, -1] + self.slack * (xx[rows] + self.norms[a:b].max())
        near = rough <= allowed[:, None]
        some = near.any(axis=1)
        rows, near = rows[some], near[some]
        if not len(rows):
            return
        exact = np.full(near.shape, np.inf)
        r, c = np.nonzero(near)
        diff = x[rows[r]] - self.w[a + c]
        exact[r, c] = np.einsum("nd,nd->n", diff, diff)
        d = np.concatenate([dist[rows], exact], axis=1)
        own = np.broadcast_to(self.ids[a:b], near.shape)
        i = np.concatenate([ids[rows], own], axis=1)
        p = np.concatenate([places[rows], np.broadcast_to(self.order[a:b], near.shape)], axis=1)
        best = np.lexsort((i, d), axis=1)[:, :dist.shape[1]]
        dist[rows], ids[rows] = np.take_along_axis(d, best, axis=1), np.take_along_axis(i, best, axis=1)
        places[rows] = np.take_along_axis(p, best, axis=1)

    def search(self, x: np.ndarray, dist: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        """Improve the k best of each row in place: squared distances (ascending), ids and positions in ``w``."""
        if not len(x) or not len(self.w):
            return
        xx = np.einsum("nd,nd->n", x, x)
        home = np.empty(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.child[node]:
                home[rows] = node
                self._scan(node, rows, x, xx, dist, ids, places)
                continue
            left, right = self.child[node]
            closer = self._to_centre(x[rows], left) <= self._to_centre(x[rows], right)
            todo += [(c, part) for c, part in ((left, rows[closer]), (right, rows[~closer])) if len(part)]
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.child[node]:
                rows = rows[home[rows] != node]
            if not len(rows):
                continue
            least = self._to_centre(x[rows], node) - self.radius[node]
            reach = np.sqrt(dist[rows, -1])
            scale = np.sqrt(xx[rows]) + self.radius[node] + np.sqrt(self.norms.max())
            rows = rows[least <= reach + 1e-12 * scale + np.sqrt(self.slack) * 1e-3 * scale]
            if self.child[node]:
                todo += [(c, rows) for c in self.child[node]]
            elif len(rows):
                self._scan(node, rows, x, xx, dist, ids, places)


def no_codes(n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The state of a search before its first codes."""
    return np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)


# Rows that show whether a tree spares enough, and the share of distances from which measuring all is as fast.
PROBE_ROWS, PROBE_SHARE = 512, 0.25


def tree_finder(labels: np.ndarray, w: np.ndarray, k: int, within_class: bool, plain=None):
    """``find(x, row_labels)`` of ``nearest.make_finder``, by a tree over all codes or one for each class.

    With ``plain``, a finder that measures every code, the first rows are a
    probe: where balls overlap so much that the tree spares little (vectors
    without clusters in many dimensions), the rest goes to ``plain``.  Both give
    the same rows.
    """
    ids = np.arange(len(w))
    classes = np.unique(labels) if within_class else [None]
    trees = []
    for c in classes:
        own = ids if c is None else np.flatnonzero(labels == c)
        trees.append((c, CodeTree(own, w[own])))
    choice = {"plain": False, "probed": 0}

    def by_tree(x, lr):
        dist, best, places = no_codes(len(x), k)
        for c, tree in trees:
            rows = np.arange(len(x)) if c is None else np.flatnonzero(lr == c)
            state = dist[rows], best[rows], places[rows]
            tree.search(x[rows], *state)
            dist[rows], best[rows] = state[0], state[1]
        return np.where(np.isfinite(dist), best, 0), dist

    def find(x, lr):
        if plain is None:
            return by_tree(x, lr)
        parts, start = [], 0
        while start < len(x) or not parts:
            probing = choice["probed"] < PROBE_ROWS
            end = min(len(x), start + PROBE_ROWS) if probing else len(x)
            part = x[start:end], None if lr is None else lr[start:end]
            parts.append((plain if choice["plain"] else by_tree)(*part))
            if probing:
                choice["probed"] += end - start
                asked = sum(tree.evaluations for _, tree in trees)
                choice["plain"] = asked > PROBE_SHARE * choice["probed"] * len(w)
            start = end
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    return find
