"""BK-trees over 64-bit fingerprints, a forest at a time.

A child hangs at its Hamming distance to the parent; a query within radius r
that is d away from a node follows only the edges d - r .. d + r. Trees are
built level by level and searched with all queries at once, as arrays.
"""

from __future__ import annotations

import numpy as np

AT_ONCE = 1 << 20  # (query, node) pairs held at once


def build(prints: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Child index and sort key (parent * 65 + edge) of every node but the roots.

    ``prints`` are distinct within a tree, and the items of a tree lie together; the first is its root.
    """
    first = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if len(tree) else np.zeros(0, np.int64)
    at = np.repeat(first, np.diff(np.r_[first, len(tree)]))
    left = np.setdiff1d(np.arange(len(tree)), first, assume_unique=True)
    children, keys = [], []
    while len(left):
        key = at[left] * 65 + np.bitwise_count(prints[left] ^ prints[at[left]])
        found, where, which = np.unique(key, return_index=True, return_inverse=True)
        placed = left[where]  # the first of each edge becomes the child, the others go below it
        children.append(placed)
        keys.append(found)
        at[left] = placed[which]
        left = left[at[left] != left]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.concatenate(keys)
    order = np.argsort(key)
    return np.concatenate(children)[order], key[order]


def near(prints: np.ndarray, tree: np.ndarray, radius: int):
    """Yields arrays (a, b) of indexes, b < a, for all pairs of a tree within the radius."""
    children, keys = build(prints, tree)
    first = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if len(tree) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, len(tree)])
    many = np.repeat(sizes > 1, sizes)
    start = np.arange(len(tree))[many]
    work = [(start, np.repeat(first, sizes)[many])]
    while work:
        query, node = work.pop()
        if len(query) > AT_ONCE:
            half = len(query) // 2
            work += [(query[:half], node[:half]), (query[half:], node[half:])]
            continue
        older = node < query  # below a node all are younger than it
        query, node = query[older], node[older]
        if not len(query):
            continue
        d = np.bitwise_count(prints[query] ^ prints[node]).astype(np.int64)
        hit = d <= radius
        if hit.any():
            yield query[hit], node[hit]
        low = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0))
        n = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), "right") - low
        total = int(n.sum())
        if total:
            query = np.repeat(query, n)
            spot = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            work.append((query, children[spot]))


class Groups:
    """Union-find over indexes; the smallest index of a group is its root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, a, b) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)
