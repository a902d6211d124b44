"""A multiway hyperplane tree with distance ranges between siblings, in numpy.

A node has several split points; each row goes to its nearest one, so subtrees are parted by
hyperplanes. For every split point and every sibling subtree the node stores the least and the greatest
distance that occurs between them. A query that looks for distances within a window (an annulus around
it) knows its distance to each split point, and a subtree goes when for one of them the stored range,
moved by that distance, misses the window. Leaves are compared in full.

Scores are inner products. Rows get one more component, the square root of what their squared length
lacks of the greatest one; queries get 0 there. Then all rows are equally long, and the squared distance
between a query q and a row x is greatest + |q|^2 - 2 (q . x): windows of scores are windows of
distances, the higher the score the nearer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: No score at all; below every real one.
NONE = -(1 << 62)
#: Distances are compared with this much room, so that rounding never loses a row.
ROOM = 1e-9


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows: by floating point where that is exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**52:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


@dataclass
class Node:
    points: np.ndarray
    size: np.ndarray
    lift: np.ndarray
    children: list  # a node, or the number of a leaf
    least: np.ndarray = field(default=None)
    most: np.ndarray = field(default=None)


def lift(squared: np.ndarray, greatest: int) -> np.ndarray:
    return np.sqrt(np.maximum(0, greatest - squared).astype(float))


def from_points(node: Node, rows: np.ndarray, greatest: int) -> np.ndarray:
    """Distances of rows to the split points of a node."""
    size = lengths(rows)
    flat = size[:, None] + node.size - 2 * products(rows, node.points)
    extra = lift(size, greatest)[:, None] - node.lift
    return np.sqrt(np.maximum(0.0, flat + extra * extra))


def from_queries(node: Node, queries: np.ndarray, size: np.ndarray, greatest: int) -> np.ndarray:
    """Distances of queries, whose further component is 0, to the split points."""
    return np.sqrt(np.maximum(0, greatest + size[:, None] - 2 * products(queries, node.points)).astype(float))


def split_points(rows: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows far apart from each other: each next one is farthest from those before."""
    size = lengths(rows)
    chosen = [0]
    nearest = size + size[0] - 2 * products(rows, rows[:1])[:, 0]
    while len(chosen) < count:
        far = int(nearest.argmax())
        if nearest[far] <= 0:
            break  # all others equal a chosen one
        chosen.append(far)
        nearest = np.minimum(nearest, size + size[far] - 2 * products(rows, rows[far : far + 1])[:, 0])
    return rows[chosen]


def new_node(points: np.ndarray, greatest: int) -> Node:
    size = lengths(points)
    m = len(points)
    return Node(
        points, size, lift(size, greatest), [None] * m, np.full((m, m), np.inf), np.full((m, m), -np.inf)
    )


def build(sample: np.ndarray, greatest: int, fanout: int, depth: int) -> tuple[Node | int, int]:
    """A tree over the sample, ranges still empty: (root, number of leaves)."""
    leaves = 0

    def grow(rows: np.ndarray, below: int) -> Node | int:
        nonlocal leaves
        points = split_points(rows, fanout) if below and len(rows) > fanout else rows[:0]
        if len(points) < 2:
            leaves += 1
            return leaves - 1
        node = new_node(points, greatest)
        near = from_points(node, rows, greatest).argmin(axis=1)
        node.children = [grow(rows[near == j], below - 1) for j in range(len(points))]
        return node

    return grow(sample, depth), leaves


def nodes(root: Node | int) -> list[Node]:
    """All nodes, a parent before its children, in a fixed order."""
    found, waiting = [], [root]
    while waiting:
        node = waiting.pop(0)
        if isinstance(node, Node):
            found.append(node)
            waiting.extend(node.children)
    return found


def route(root: Node | int, rows: np.ndarray, greatest: int, learn: bool = False) -> np.ndarray:
    """The leaf of each row. With ``learn`` the ranges take the rows in."""
    out = np.zeros(len(rows), np.int64)
    waiting = [(root, np.arange(len(rows)))]
    while waiting:
        node, here = waiting.pop()
        if not isinstance(node, Node):
            out[here] = node
            continue
        distance = from_points(node, rows[here], greatest)
        near = distance.argmin(axis=1)
        for j, child in enumerate(node.children):
            mine = near == j
            if mine.any():
                if learn:
                    node.least[:, j] = np.minimum(node.least[:, j], distance[mine].min(axis=0))
                    node.most[:, j] = np.maximum(node.most[:, j], distance[mine].max(axis=0))
                waiting.append((child, here[mine]))
    return out


def window(low: np.ndarray, high: np.ndarray, size: np.ndarray, greatest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances (from, to) of the scores from ``low`` to ``high``, per query and window."""
    base = (greatest + size)[:, None].astype(float)
    near = np.sqrt(np.maximum(0.0, base - 2.0 * np.minimum(high, 1 << 60)))
    far = np.sqrt(np.maximum(0.0, base - 2.0 * np.maximum(low, -(1 << 60))))
    slack = ROOM * (1 + np.sqrt(base))
    near, far = near - slack, far + slack
    return near, np.where(low > high, -np.inf, far)  # an empty window reaches nothing


def alive(node: Node, distance: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which children of a node can hold rows within a window of a query (queries x children)."""
    d = distance[:, :, None]
    # No row of child j is nearer than ``lowest`` or farther than ``highest``, over all split points.
    lowest = np.maximum(d - node.most, node.least - d).max(axis=1)
    highest = (d + node.most).min(axis=1)
    slack = ROOM * (1 + distance.max(axis=1, initial=0.0))[:, None, None]
    reached = (highest[:, None, :] + slack >= near[:, :, None]) & (
        lowest[:, None, :] - slack <= far[:, :, None]
    )
    return reached.any(axis=1) & (node.least[0] < np.inf)


def reach(
    root: Node | int, queries: np.ndarray, low: np.ndarray, high: np.ndarray, greatest: int
) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, numbers of the queries) for every leaf that a window of a query may reach."""
    size = lengths(queries)
    near, far = window(low, high, size, greatest)
    some = np.flatnonzero((far > -np.inf).any(axis=1))
    waiting = [(root, some)]
    while waiting:
        node, here = waiting.pop()
        if not len(here):
            continue
        if not isinstance(node, Node):
            yield node, here
            continue
        distance = from_queries(node, queries[here], size[here], greatest)
        left = alive(node, distance, near[here], far[here])
        waiting.extend((child, here[left[:, j]]) for j, child in enumerate(node.children))


@dataclass
class Rows:
    """Rows of one block, ascending by id: number of the row, id, label, vector."""

    key: np.ndarray
    id: np.ndarray
    label: np.ndarray
    v: np.ndarray


class BlockTree:
    """A tree over the rows of one block, with a search for the best rows within windows."""

    def __init__(self, rows: Rows, greatest: int, fanout: int = 8, leaf: int = 128):
        self.rows, self.greatest = rows, greatest

        def grow(here: np.ndarray) -> Node | np.ndarray:
            points = split_points(rows.v[here], fanout) if len(here) > leaf else rows.v[:0]
            if len(points) < 2:
                return here
            node = new_node(points, greatest)
            distance = from_points(node, rows.v[here], greatest)
            near = distance.argmin(axis=1)
            for j in range(len(points)):
                mine = near == j
                node.least[:, j] = distance[mine].min(axis=0, initial=np.inf)
                node.most[:, j] = distance[mine].max(axis=0, initial=-np.inf)
                node.children[j] = grow(here[mine])
            return node

        self.root = grow(np.arange(len(rows.key)))

    def search(
        self, queries: Rows, low: np.ndarray, high: np.ndarray, same: bool, k: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, id and row number of the best ``k`` rows per query and window, best first.

        Rows have the label of the query (``same``) or another one, and are not the query's own row.
        Higher scores come first, ties by smaller id, then by row number. Free places have score NONE.
        As soon as a window has ``k`` rows, scores below the last of them are no longer looked for.
        """
        n, windows = low.shape
        score = np.full((n, windows, k), NONE, np.int64)
        row = np.full((n, windows, k), -1, np.int64)
        size = lengths(queries.v)
        low = low.copy()
        waiting = [(self.root, np.arange(n))]
        while waiting:
            node, here = waiting.pop()
            if isinstance(node, Node):
                if not len(here):
                    continue
                distance = from_queries(node, queries.v[here], size[here], self.greatest)
                near, far = window(low[here], high[here], size[here], self.greatest)
                left = alive(node, distance, near, far)
                # Last in, first out: the child that is nearest on average is looked at first.
                for j in np.argsort(-distance.mean(axis=0), kind="stable"):
                    waiting.append((node.children[j], here[left[:, j]]))
                continue
            if not len(here) or not len(node):
                continue
            self._compare(queries, here, node, low, high, same, k, score, row)
        known = row >= 0
        ids = np.where(known, self.rows.id[row], 0) if len(self.rows.id) else row
        keys = np.where(known, self.rows.key[row], -1) if len(self.rows.id) else row
        return score, ids, keys

    def _compare(self, queries, here, leaf, low, high, same, k, score, row) -> None:
        rows = self.rows
        found = products(queries.v[here], rows.v[leaf])
        fits = (rows.label[leaf] == queries.label[here][:, None]) == same
        fits &= rows.key[leaf] != queries.key[here][:, None]
        for w in range(low.shape[1]):
            good = fits & (found >= low[here, w][:, None]) & (found <= high[here, w][:, None])
            some = np.flatnonzero(good.any(axis=1))
            if not len(some):
                continue
            at = here[some]
            scores = np.where(good[some], found[some], NONE)
            scores = np.concatenate([score[at, w], scores], axis=1)
            numbers = np.concatenate([row[at, w], np.broadcast_to(leaf, (len(some), len(leaf)))], axis=1)
            # Rows are numbered by id within the block, so their number settles ties.
            best = np.lexsort((numbers, -scores), axis=1)[:, :k]
            score[at, w] = np.take_along_axis(scores, best, 1)
            row[at, w] = np.where(score[at, w] > NONE, np.take_along_axis(numbers, best, 1), -1)
            low[at, w] = np.maximum(low[at, w], score[at, w][:, -1])
