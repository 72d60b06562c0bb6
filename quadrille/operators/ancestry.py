"""Lowest common ancestors, intervals and quartet topologies of one tree, as arrays that travel with a plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Nodes up to which a tree goes to every task: some 90 bytes for each.
MOST_NODES = 1 << 18
#: Sums of leaf hashes are kept modulo this.
KEYS = 1 << 48


class Ancestry:
    """A rooted tree in preorder: nodes are numbers 0 (the root) to n - 1, and what lies below x is the interval [x, end[x]).

    kids of a node are in order of their ids. Of two nodes x < y the lowest common ancestor is the least parent of the nodes in (x, y]: those
    below it have parents in its subtree, and one of them is its own child. A sparse table of least parents answers that in two look-ups.
    """

    def __init__(self, node_ids: list, parent_ids: list, names: list, leaf: list):
        place = {v: i for i, v in enumerate(node_ids)}
        kids: list[list[int]] = [[] for _ in node_ids]
        roots = []
        for i in sorted(range(len(node_ids)), key=lambda i: node_ids[i]):
            (roots if parent_ids[i] is None else kids[place[parent_ids[i]]]).append(i)
        if len(roots) != 1:
            raise ValueError(f"{len(roots)} roots")
        order, todo, parent, depth = [], [(roots[0], -1, 0)], [], []
        while todo:
            i, up, level = todo.pop()
            number = len(order)
            order.append(i)
            parent.append(up)
            depth.append(level)
            todo += [(k, number, level + 1) for k in reversed(kids[i])]
        if len(order) != len(node_ids):
            raise ValueError("some nodes are not below the root")
        self.ids = [node_ids[i] for i in order]
        self.parent, self.depth = np.array(parent, np.int32), np.array(depth, np.int32)
        self.end = np.arange(1, len(order) + 1, dtype=np.int32)
        for x in range(len(order) - 1, 0, -1):
            self.end[parent[x]] = max(self.end[parent[x]], self.end[x])
        self.leaves = np.array([x for x, i in enumerate(order) if leaf[i]], np.int32)
        self.names = pa.array([str(names[order[x]]) for x in self.leaves], pa.string())
        rows, width = [self.parent], 1
        while 2 * width <= len(order):
            rows.append(np.minimum(rows[-1], np.concatenate([rows[-1][width:], rows[-1][-1:].repeat(width)])))
            width *= 2
        self.table = np.stack(rows)

    def intervals(self) -> tuple[np.ndarray, np.ndarray]:
        """For each node the run of self.leaves that lies below it: first, and behind the last."""
        return np.searchsorted(self.leaves, np.arange(len(self.parent))), np.searchsorted(self.leaves, self.end)

    def kids(self, x: int) -> list[int]:
        found, at = [], x + 1
        while at < self.end[x]:
            found.append(at)
            at = int(self.end[at])
        return found

    def numbers(self, names: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """The leaves of these names, -1 where there is none."""
        at = pc.fill_null(pc.index_in(names.cast(pa.string()), self.names), -1)
        at = np.asarray(at.combine_chunks() if isinstance(at, pa.ChunkedArray) else at).astype(np.int64)
        return np.where(at < 0, -1, self.leaves[at]) if len(self.leaves) else at

    def lca(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        k = np.frexp(np.maximum(high - low + 1, 1))[1] - 1
        low, last = np.minimum(low, len(self.parent) - 1), np.maximum(high - (1 << k) + 1, 0)
        return np.where(x == y, x, np.minimum(self.table[k, low], self.table[k, last]))

    def below(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether x is y or below it."""
        return (y <= x) & (x < self.end[y])

    def topologies(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, u, v) of each row of four leaves: 0 for ab|cd, 1 for ac|bd, 2 for ad|bc, -1 where the tree leaves it open; u and v are the two
        nodes where its paths meet, u the deeper one."""
        a, b, c, d = q.T
        pairs = np.stack([np.stack([self.lca(x, y), self.lca(z, w)]) for x, y, z, w in ((a, b, c, d), (a, c, b, d), (a, d, b, c))])
        depth = self.depth[pairs]
        best = depth.max(1)
        cls = best.argmax(0)
        rows = np.arange(len(q))
        one, two = pairs[cls, 0, rows], pairs[cls, 1, rows]
        deeper = self.depth[one] >= self.depth[two]
        u, other = np.where(deeper, one, two), np.where(deeper, two, one)
        # Where the pairs' ancestors lie on one path, the further node is that of the nearer leaf beyond.
        across = np.concatenate([pairs[(cls + k) % 3, :, rows].T for k in (1, 2)])
        across = across[np.argmax(self.depth[across], 0), rows]
        v = np.where(self.depth[other] >= self.depth[across], other, across)
        return np.where((best == best.max(0)).sum(0) > 1, -1, cls), u, v


def held(tree: DataFrame) -> Ancestry | None:
    """The arrays of a table (node_id, parent_id, name, is_leaf); None for a tree of more than MOST_NODES nodes."""
    rows = tree.select("node_id", "parent_id", "name", "is_leaf").limit(MOST_NODES + 1).toArrow()
    return None if rows.num_rows > MOST_NODES else Ancestry(*(rows.column(c).to_pylist() for c in rows.column_names))


def of(tree: DataFrame) -> Ancestry:
    """The arrays of a tree whose size is checked."""
    found = held(tree)
    if found is None:
        raise ValueError(f"more than {MOST_NODES} nodes")
    return found


def classes(quartet_rows: DataFrame, tree: Ancestry, column: str = "cls") -> DataFrame:
    """(q0..q3, ...) with the class that the tree shows, -1 where it leaves it open; rows with a name that is no leaf go."""
    schema = StructType([*quartet_rows.schema.fields, StructField(column, IntegerType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.stack([tree.numbers(batch.column(f"q{i}")) for i in range(4)], 1)
            known = (q >= 0).all(1)
            kept = batch.filter(pa.array(known))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(tree.topologies(q[known])[0], pa.int32())], [*kept.schema.names, column])

    return quartet_rows.mapInArrow(add, schema)


class Branches:
    """The inner branches of a binary tree, by the node below each, and the four parts around them: a node's children 1 and 2, its sibling 4, the rest 8.

    A root of three children is that of an unrooted tree: of the two siblings there, the first is the part 4. A root of two lies on a branch: the
    branches to its children are one, of the first child, and the sibling's children are the parts 4 and 8; if the sibling is a leaf there is none.
    """

    def __init__(self, tree: Ancestry):
        self.tree, n = tree, len(tree.parent)
        self.rooted = len(tree.kids(0)) == 2
        self.first, self.second, self.third = np.full((3, n), -1, np.int64)
        for x in range(1, n):
            kids, up = tree.kids(x), int(tree.parent[x])
            if not kids:
                continue
            beside = [k for k in tree.kids(up) if k != x]
            if len(kids) != 2 or len(beside) != (2 if up == 0 and not self.rooted else 1):
                raise ValueError("the tree is not binary")
            over = up == 0 and self.rooted
            if over and (x != 1 or tree.end[beside[0]] == beside[0] + 1):
                continue
            self.first[x], self.second[x] = kids
            self.third[x] = tree.kids(beside[0])[0] if over else beside[0]
        self.places = np.flatnonzero(self.first >= 0)

    @property
    def ids(self) -> list:
        return [self.tree.ids[x] for x in self.places]

    def parts(self, branch: np.ndarray, taxa: np.ndarray) -> np.ndarray:
        """The part of each taxon around its row's branch."""
        inside = lambda of: self.tree.below(taxa, of[branch])
        return np.where(inside(self.first), 1, np.where(inside(self.second), 2, np.where(inside(self.third), 4, 8)))

    def codes(self) -> np.ndarray:
        """(branches, leaves): the parts of all leaves, in order of self.tree.leaves."""
        return self.parts(self.places[:, None], self.tree.leaves[None, :])

    def around(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(branch, k) of each row ab|cd: the one branch with its four taxa in the four parts, or -1; k is 0 for xy|zw, 1 for xz|yw, 2 for xw|yz.

        There the paths between the taxa meet in the two ends of the branch, so it takes the ancestors of the pairs and no look at other branches.
        """
        cls, u, v = self.tree.topologies(q)
        top = self.rooted & (self.tree.parent[u] == 0) & (self.tree.parent[v] == 0) & (u != v)
        branch = np.where(top, 1, np.where(self.tree.parent[u] == v, u, -1))
        branch = np.where((cls >= 0) & (branch >= 0) & (self.first[branch] >= 0), branch, -1)
        code = self.parts(branch[:, None].repeat(4, 1), q)
        pair = code[:, 0] + code[:, 1]
        return branch, np.where((pair == 3) | (pair == 12), 0, np.where((pair == 5) | (pair == 10), 1, 2))


def polytomies(tree: Ancestry) -> list[tuple]:
    """(node, degree, direction, rep): nodes of unrooted degree over 3 with the least leaf name of each direction, that beyond the parent last.

    Of runs of leaves in preorder: what lies beyond a node is what comes before its run and behind it.
    """
    names = np.array(tree.names.to_pylist(), object)
    order = np.argsort(names, kind="stable")
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    first, last = tree.intervals()
    none = len(names)
    before, behind = np.minimum.accumulate([none, *rank]), np.minimum.accumulate([none, *rank[::-1]])[::-1]
    count = np.bincount(tree.parent[1:], minlength=len(tree.parent))
    out = []
    for x in np.flatnonzero(count + (tree.parent >= 0) > 3):
        degree = int(count[x] + (tree.parent[x] >= 0))
        out += [(tree.ids[x], degree, tree.ids[k], names[order[rank[first[k] : last[k]].min()]]) for k in tree.kids(int(x)) if last[k] > first[k]]
        beyond = min(before[first[x]], behind[last[x]])
        if tree.parent[x] >= 0 and beyond < none:
            out.append((tree.ids[x], degree, None, names[order[beyond]]))
    return out


def inner_edges(tree: Ancestry) -> list[tuple[int, int, int, bool]]:
    """(node's number, first and behind the last of its run of leaves, whether the least leaf name is in it) of edges with two leaves or more on either side."""
    first, last = tree.intervals()
    size = last - first
    least = int(np.argmin(np.array(tree.names.to_pylist(), object))) if len(tree.names) else -1
    some = np.flatnonzero((size >= 2) & (len(tree.names) - size >= 2))
    return [(int(x), int(first[x]), int(last[x]), bool(first[x] <= least < last[x])) for x in some]


def bipartitions(spark, tree: Ancestry, kind: str) -> DataFrame:
    """(node_id, n, side): the leaf set of each inner edge on the side without the least leaf, in order: a run of leaves, or all but a run, made on executors."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(tree.names.to_pylist(), object)
        for batch in batches:
            for node, a, b, flip in zip(*(batch.column(k) for k in range(4))):
                a, b = a.as_py(), b.as_py()
                side = np.sort(np.concatenate([names[:a], names[b:]]) if flip.as_py() else names[a:b]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], node.type), pa.array([len(side)], pa.int64()), pa.array([side], pa.list_(pa.string()))], ["node_id", "n", "side"])

    rows = [(tree.ids[x], a, b, flip) for x, a, b, flip in inner_edges(tree)]
    return spark.createDataFrame(rows, f"node_id {kind}, a int, b int, flip boolean").mapInArrow(listed, f"node_id {kind}, n long, side array<string>")


def split_keys(tree: Ancestry, hashes) -> list[tuple[int, int, int]]:
    """(n, h0, h1): distinct bipartitions as sums, modulo KEYS, of leaf hashes of the side without the least leaf, from running sums over the leaves. hashes(name): two numbers."""
    h = np.array([hashes(n) for n in tree.names.to_pylist()], np.int64).reshape(-1, 2)
    upto = np.vstack([np.zeros((1, 2), np.int64), np.cumsum(h, 0)])
    whole, n = upto[-1], len(h)
    # Where running sums overflow they are still right modulo KEYS.
    return sorted({(n - (b - a), *(whole - (upto[b] - upto[a]) & KEYS - 1).tolist()) if flip else (b - a, *(upto[b] - upto[a] & KEYS - 1).tolist()) for _, a, b, flip in inner_edges(tree)})
