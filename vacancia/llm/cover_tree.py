"""A cover tree over a block of integer points, kept as arrays, and nearest entries found by whole subtrees.

A node has a centre, the radius of its points around it, and the points themselves as a range of the tree's order. The
children of a node of radius R take its points within R / 2 of their centres; the first child has the node's own centre,
every further one a point that no earlier child took. Equal points are one point with a weight. Cumulative sums over the
order give the weight and the sum of any subtree at once.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

#: Points of a node that isn't divided.
LEAF = 12


@dataclass
class Tree:
    points: np.ndarray  # distinct, in the tree's order
    weights: np.ndarray
    place: np.ndarray  # of each given point in that order
    centre: np.ndarray  # of a node: the point at this place
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray  # the first child; -1 for a leaf
    children: np.ndarray

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: v.astype(np.int32) if k in ("points", "weights", "place") else v for k, v in vars(self).items()})
        return out.getvalue()


def unpacked(packed: bytes) -> Tree:
    with np.load(io.BytesIO(packed)) as found:
        return Tree(**{k: found[k].astype(np.int64) if found[k].dtype == np.int32 else found[k] for k in found.files})


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, exact."""
    out = np.zeros((len(a), len(b)), np.int64)
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return out


def build(given: np.ndarray) -> Tree:
    """The tree of the rows of an integer matrix, of at least one row; its width may be 0."""
    points, inverse, weights = np.unique(given, axis=0, return_inverse=True, return_counts=True) if given.shape[1] else (given[:1], np.zeros(len(given), np.int64), np.array([len(given)]))
    order = np.arange(len(points))
    centre, radius, start, end, child, children = [0], [0.0], [0], [len(points)], [], []
    for node in iter(range(1 << 62)):  # nodes are appended as they are found
        if node == len(centre):
            break
        lo, hi = start[node], end[node]
        own = order[lo:hi]
        rest = own[own != centre[node]]
        squares = ((points[rest] - points[centre[node]]) ** 2).sum(axis=1)
        radius[node] = float(np.sqrt(squares.max())) if len(rest) else 0.0
        if hi - lo <= LEAF:
            child.append(-1)
            children.append(0)
            continue
        first, within = len(centre), (radius[node] / 2) ** 2
        near = squares <= within
        groups, rest = [np.concatenate([[centre[node]], rest[near]])], rest[~near]
        while len(rest):
            near = ((points[rest] - points[rest[0]]) ** 2).sum(axis=1) <= within
            groups.append(rest[near])
            rest = rest[~near]
        at = lo
        for group in groups:
            order[at : at + len(group)] = group
            centre.append(int(group[0]))
            radius.append(0.0)
            start.append(at)
            at += len(group)
            end.append(at)
        child.append(first)
        children.append(len(groups))
    back = np.empty(len(points), np.int64)
    back[order] = np.arange(len(points))
    of = lambda x: np.array(x, np.int64)
    return Tree(points[order], weights[order], back[inverse.ravel()], back[of(centre)], np.array(radius), of(start), of(end), of(child), of(children))


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def nearest(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest of ``entries`` (ties: the lowest index) as whole subtrees and points: entry, start, end of ranges.

    An entry is out for a subtree if even its point nearest to the entry is farther than the best entry is from its farthest
    point. What has one entry left is settled, the others descend; points of leaves are compared exactly.
    """
    nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(nodes):
        far = np.sqrt(_squares(tree.points[tree.centre[nodes]], entries))
        reach = np.where(open_, far, np.inf).min(axis=1) + 2 * tree.radius[nodes]
        open_ = open_ & (far <= (reach * (1 + 1e-9) + 1e-9)[:, None])  # rounding may keep an entry, never lose one
        settled = open_.sum(axis=1) == 1
        found.append((open_[settled].argmax(axis=1), tree.start[nodes[settled]], tree.end[nodes[settled]]))
        nodes, open_ = nodes[~settled], open_[~settled]
        leaf = tree.child[nodes] < 0
        if leaf.any():
            count = (tree.end - tree.start)[nodes[leaf]]
            points, still = _ranges(tree.start[nodes[leaf]], count), np.repeat(open_[leaf], count, axis=0)
            exact = np.where(still, _squares(tree.points[points], entries), np.iinfo(np.int64).max)
            found.append((exact.argmin(axis=1), points, points + 1))
        nodes, open_ = nodes[~leaf], open_[~leaf]
        count = tree.children[nodes]
        nodes, open_ = _ranges(tree.child[nodes], count), np.repeat(open_, count, axis=0)
    entry, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    return entry, start, end


def totals(tree: Tree, entries: np.ndarray) -> np.ndarray:
    """For each entry its weight and, behind it, the sum of its points: differences of cumulative sums."""
    weighted = np.column_stack([tree.weights, tree.weights[:, None] * tree.points])
    cumulative = np.concatenate([np.zeros((1, weighted.shape[1]), np.int64), weighted.cumsum(axis=0)])
    entry, start, end = nearest(tree, entries)
    out = np.zeros((len(entries), weighted.shape[1]), np.int64)
    np.add.at(out, entry, cumulative[end] - cumulative[start])
    return out


def codes(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each given point and the squared distance to it."""
    entry, start, end = nearest(tree, entries)
    of_point = np.empty(len(tree.points), np.int64)
    of_point[_ranges(start, end - start)] = np.repeat(entry, end - start)
    squares = ((tree.points - entries[of_point]) ** 2).sum(axis=1)
    return of_point[tree.place], squares[tree.place]
