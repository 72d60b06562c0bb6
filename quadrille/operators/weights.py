"""Weighted quartet sums of whole gene trees, by lengths and supports, without a row for each quartet.

A quartet ab|cd whose paths meet at u and v weighs exp(-lengths within its pairs) times 1 less what is kept along the path from u to v: on each edge 1 - support.
Either factor may be left out. Both are products over edges, so at a node what a further branch holds of pairs c, d can be carried from node to node: what the
branches beyond a node hold adds up, with the pairs that meet there, times what is kept along the edge. One pass goes up and one down.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

from ..plans.newick import Node

#: n: none; l: lengths; s: supports; h: both. For each, sums to be taken with what is kept on the edges, and their signs.
PASSES = {"n": ((False, 1),), "l": ((False, 1),), "s": ((False, 1), (True, -1)), "h": ((False, 1), (True, -1))}


#: Rows of branches that are multiplied at once.
ROWS = 4096


def checked(weighting: str) -> str:
    if weighting not in PASSES:
        raise ValueError(f"weighting is one of {', '.join(PASSES)}")
    return weighting


class _Branches:
    """What the branches of a node hold: x of leaves, by group, lessened by the lengths on the way; d of pairs further on, lessened by what is kept on the edges up to where they meet."""

    def __init__(self, x: np.ndarray, d: list):
        self.x, self.d = x, d


def junctions(root: Node, held: dict[str, tuple[np.ndarray, np.ndarray]], shape: tuple[int, ...], lengths: bool, kept: bool, beyond) -> Iterator[_Branches]:
    """For each node with three branches or more that hold something: its branches.

    held: for a leaf's name places in an array of that shape, flattened, and how much it weighs there. beyond(branches): the pairs that some branches hold
    together, those further on and those that meet where the branches do, as a tuple of arrays; a leaf's branch holds None.
    """
    order = list(root.walk())
    place = {id(x): i for i, x in enumerate(order)}
    kids = [[place[id(c)] for c in x.children] for x in order]
    fade = [math.exp(-(x.length or 0.0)) if lengths else 1.0 for x in order]
    keep = [max(0.0, 1 - min(1.0, x.support or 0.0)) if kept else 1.0 for x in order]
    below: list[np.ndarray] = []
    pairs: list[tuple | None] = []
    lessened = lambda found, factor: tuple(factor * a for a in found)
    for i, x in enumerate(order):
        if kids[i]:
            own = _Branches(np.stack([below[k] for k in kids[i]]), [pairs[k] for k in kids[i]])
            below.append(own.x.sum(0) * fade[i])
            pairs.append(lessened(beyond(own), keep[i]) if x.parent is not None else None)
        else:
            mine = np.zeros(shape)
            if x.name in held:
                columns, amount = held[x.name]
                mine.reshape(-1)[columns] += amount
            below.append(mine * fade[i])
            pairs.append(None)

    todo: list[tuple[int, np.ndarray | None, tuple | None]] = [(len(order) - 1, None, None)]
    while todo:
        i, above, d_above = todo.pop()
        x, d = [below[k] for k in kids[i]], [pairs[k] for k in kids[i]]
        if above is not None:
            x, d = [*x, above], [*d, d_above]
        some = [b for b, v in enumerate(x) if np.abs(v).max() > 1e-300]
        if len(some) >= 3:
            yield _Branches(np.stack([x[b] for b in some]), [d[b] for b in some])
        for b, k in enumerate(kids[i]):
            if kids[k]:
                others = [c for c in range(len(x)) if c != b]
                rest = _Branches(np.stack([x[c] for c in others]) if others else np.zeros((1, *shape)), [d[c] for c in others])
                todo.append((k, rest.x.sum(0) * fade[k], lessened(beyond(rest), keep[k])))


def edge_sums(root: Node, held: dict[str, tuple[np.ndarray, np.ndarray]], m: int, weighting: str = "h") -> tuple[np.ndarray, np.ndarray]:
    """(good, bad) between m groups, as genetrees.edge_sums has them, of weighted quartets.

    Of the pairs that a branch holds the sums by group suffice, but for groups that several leaves share: for those all their pairs are kept. So work
    and memory are, for each node, its branches times m times the number of shared groups, and matrix products.
    """
    good, bad = np.zeros((m, m)), np.zeros((m, m))
    uses = np.bincount([g for x in root.leaves() if x.name in held for g in np.atleast_1d(held[x.name][0])], minlength=m)
    shared = np.flatnonzero(uses > 1)
    column = np.arange(len(shared))

    def beyond(b: _Branches) -> tuple[np.ndarray, np.ndarray]:
        """(sums of pairs by group, pairs with each shared group)."""
        total, size = b.x.sum(0), b.x.sum(1)
        row = total * total.sum() - size @ b.x - total * total + (b.x * b.x).sum(0)
        some = np.outer(total, total[shared]) - b.x.T @ b.x[:, shared]
        some[shared, column] = 0
        for d in b.d:
            if d is not None:
                row, some = row + d[0], some + d[1]
        return row, some

    sums: list[tuple[list, list, np.ndarray]] = [([], [], good), ([], [], bad)]

    def flush() -> None:
        for left, right, to in sums:
            if left:
                to += np.stack(left).T @ np.stack(right)
                left.clear()
                right.clear()

    def add(k: int, left: np.ndarray, right: np.ndarray) -> None:
        sums[k][0].append(left)
        sums[k][1].append(right)

    for kept, sign in PASSES[checked(weighting)]:
        for b in junctions(root, held, (m,), weighting in ("l", "h"), kept, beyond):
            whole, sizes = b.x.sum(0), b.x.sum(1)
            for h, d in enumerate(b.d):
                if d is None or not d[0].any():
                    continue
                row, some = d
                x = np.delete(b.x, h, 0)
                near = whole - b.x[h]
                mates, own = near * near.sum() - np.delete(sizes, h) @ x, near * near - (x * x).sum(0)
                # Pairs of the other branches are the product of near with itself, less those of each branch with itself.
                for c, p in ((sign, near), *((-sign, y) for y in x)):
                    add(1, c * (row.sum() / 2 - row) * p, p)
                    add(1, -c * p, row * p)
                    add(0, -c * p, row * p + some @ p[shared])
                add(0, sign * (mates - own), row)
                if len(shared):
                    pairs = np.outer(near[shared], near) - x[:, shared].T @ x
                    good[shared] += sign * some.T * (pairs - (mates - 2 * own)[shared, None])
                    bad[np.ix_(shared, shared)] += sign * pairs[:, shared] * some[shared].T
            if len(sums[1][0]) >= ROWS:
                flush()
        flush()
    return good, bad


def around(root: Node, code: dict[str, np.ndarray], branches: int, weighting: str = "h") -> np.ndarray:
    """(branches, 3): weights of a tree's quartets with a leaf in each of the four parts of a branch, as genetrees.around has their numbers."""
    held = {name: (np.arange(branches) * 4 + part, np.ones(branches)) for name, part in code.items()}
    out = np.zeros((branches, 3))

    def beyond(b: _Branches) -> tuple[np.ndarray]:
        total = b.x.sum(0)
        met = total[:, :, None] * total[:, None, :] - np.einsum("bki,bkj->kij", b.x, b.x)
        return (sum((d[0] for d in b.d if d is not None), met),)

    for kept, sign in PASSES[checked(weighting)]:
        for b in junctions(root, held, (branches, 4), weighting in ("l", "h"), kept, beyond):
            total = b.x.sum(0)
            for h, d in enumerate(b.d):
                if d is None:
                    continue
                near, x = total - b.x[h], np.delete(b.x, h, 0)
                for k, (y, z, w) in enumerate(((1, 2, 3), (2, 1, 3), (3, 1, 2))):
                    met = near[:, 0] * near[:, y] - (x[:, :, 0] * x[:, :, y]).sum(0)
                    out[:, k] += sign * met * d[0][:, z, w]
    return out


def total_weight(root: Node, weighting: str = "h") -> float:
    """The weight of all quartets that a tree resolves."""
    names = sorted({x.name for x in root.leaves()})
    bad = edge_sums(root, {n: (np.array([i]), np.ones(1)) for i, n in enumerate(names)}, len(names), weighting)[1]
    return float(np.triu(bad, 1).sum() / 2)
