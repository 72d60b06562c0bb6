"""Quartet sums of whole gene trees, without a row for each quartet, and what is built on them.

A quartet ab|cd is met once at each of two nodes: where a and b come from two branches, and c and d from one further branch. So sums over
quartets are sums over nodes of products of what the branches hold, and a tree of n leaves in m groups takes some n matrix rows of length m.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import newick
from ..plans.newick import Node
from ..sources.tables import written
from . import graph, weights
from .ancestry import Ancestry, Branches

#: Rows of branches that are multiplied at once.
ROWS = 4096


def _below(root: Node, held: dict[str, tuple[np.ndarray, np.ndarray]], width: int) -> tuple[list[Node], np.ndarray]:
    """(nodes, what lies below each). held: for a leaf's name the columns it counts in, and how much."""
    order = list(root.walk())
    at = {id(x): i for i, x in enumerate(order)}
    below = np.zeros((len(order), width))
    for i, x in enumerate(order):
        if x.children:
            below[i] = below[[at[id(c)] for c in x.children]].sum(0)
        elif x.name in held:
            columns, amount = held[x.name]
            below[i, columns] += amount
    return order, below


def _junctions(order: list[Node], below: np.ndarray) -> Iterator[np.ndarray]:
    """For each node with three branches or more that hold something: what they hold."""
    at = {id(x): i for i, x in enumerate(order)}
    total = below[-1]
    for i, x in enumerate(order):
        if x.children:
            branches = below[[at[id(c)] for c in x.children]]
            if x.parent is not None:
                branches = np.vstack([branches, total - below[i]])
            branches = branches[np.abs(branches).max(1) > 1e-12]
            if len(branches) >= 3:
                yield branches


def edge_sums(root: Node, held: dict[str, tuple[np.ndarray, np.ndarray]], m: int) -> tuple[np.ndarray, np.ndarray]:
    """(good, bad) between m groups: weights of the resolved quartets with leaves of four groups, across and within their pairs.

    held: for a leaf's name its group and weight; a quartet weighs the product of its leaves' weights, leaves that have none don't count.
    A branch with leaves of a single group holds no pair, so it is never the one further branch. Work and memory: for each node the
    product of its branches and those with two groups or more, times m; the products are matrix products.
    """
    good, bad = np.zeros((m, m)), np.zeros((m, m))
    rows: list[tuple[np.ndarray, ...]] = []

    def flush() -> None:
        if not rows:
            return
        x, y, h = (np.array(c) for c in zip(*rows))
        rows.clear()
        # Pairs within: from x and y, with the pairs that h holds but for those with the two groups themselves.
        total = h.sum(1, keepdims=True)
        own = h * h - total * h
        pairs = (total * total - (h * h).sum(1, keepdims=True)) / 2
        part = x.T @ (pairs * y) + (x * own).T @ y + x.T @ (y * own) + (x * h).T @ (y * h)
        bad[:] += part + part.T
        # Across: one from a and one from h, while their mates come from b and from h.
        for a, b in ((x, y), (y, x)):
            size = b.sum(1, keepdims=True)
            mates = size * total - (b * h).sum(1, keepdims=True)
            less = 2 * b * h - size * h - total * b
            good[:] += a.T @ (mates * h) + (a * less).T @ h + a.T @ (less * h) + (a * b).T @ (h * h) + (a * h).T @ (h * b)

    for branches in _junctions(*_below(root, held, m)):
        total = branches.sum(0)
        for h in np.flatnonzero((np.abs(branches) > 1e-12).sum(1) >= 2):
            others = np.delete(branches, h, 0)
            if len(others) == 2:
                rows.append((*others, branches[h]))
            else:
                _wide(good, bad, others, total - branches[h] - others, branches[h])
        if len(rows) >= ROWS:
            flush()
    flush()
    return good, bad


def _wide(good: np.ndarray, bad: np.ndarray, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> None:
    """Adds what a node of many branches gives for one further branch h: each other branch x against all the rest y."""
    total = h.sum()
    own, pairs = h * h - total * h, (total * total - (h * h).sum()) / 2
    # Each two branches meet twice in x and y, so half of it counts.
    part = (x.T @ y) * (pairs + own[:, None] + own[None, :] + h[:, None] * h[None, :])
    bad += (part + part.T) / 2
    size = y.sum(1, keepdims=True)
    mates = size * total - (y @ h)[:, None]
    less = 2 * y * h - size * h - total * y
    good += (x * (mates + less)).sum(0)[:, None] * h + (x.T @ less) * h + (x * y).sum(0)[:, None] * (h * h) + (x * h).T @ (h * y)


def around(root: Node, code: dict[str, np.ndarray], branches: int) -> np.ndarray:
    """(branches, 3): how many of a tree's quartets with a leaf in each of the four parts of a branch show each resolution.

    code: for a leaf's name its part of each branch, 0 to 3. The resolutions are 01|23, 02|13, 03|12.
    """
    held = {name: (np.arange(branches) * 4 + part, np.ones(branches)) for name, part in code.items()}
    out = np.zeros((branches, 3))
    for rows in _junctions(*_below(root, held, branches * 4)):
        parts = rows.reshape(len(rows), branches, 4)
        total = parts.sum(0)
        for k, (y, z, w) in enumerate(((1, 2, 3), (2, 1, 3), (3, 1, 2))):
            met = total[:, 0] * total[:, y] - (parts[:, :, 0] * parts[:, :, y]).sum(0)
            # Pairs of two branches that aren't h: all, less those with h in them.
            for h in parts:
                without = met - h[:, 0] * (total[:, y] - h[:, y]) - h[:, y] * (total[:, 0] - h[:, 0])
                out[:, k] += without * h[:, z] * h[:, w]
    return out


def quartets_shown(root: Node) -> int:
    """How many quartets of leaves a tree resolves."""
    names = sorted({x.name for x in root.leaves()})
    _, bad = edge_sums(root, {n: (np.array([i]), np.ones(1)) for i, n in enumerate(names)}, len(names))
    return int(round(np.triu(bad, 1).sum() / 2))


def _weights(problem: list, kids: dict[int, list], norm: str, counts: Counter) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each leaf's name in a tree its group in a subproblem and its weight.

    problem: its taxa, names or the numbers of made-up ones, which stand for their kids, older numbers first. A leaf weighs 1 (n0), 1 over the number of the
    tree's leaves in its group (n1), or the product of 1 over the number of kids that the tree holds, down to the leaf (n2).
    """
    live = {}
    for number, own in kids.items():
        live[number] = [k for k in own if (live.get(k) if isinstance(k, int) else counts.get(k))]
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for i, taxon in enumerate(problem):
        found, todo = [], [(taxon, 1.0)]
        while todo:
            x, weight = todo.pop()
            if isinstance(x, int):
                todo += [(k, weight / len(live[x])) for k in live[x]]
            elif counts.get(x):
                found.append((x, weight / counts[x]))
        size = sum(counts[x] for x, _ in found)
        for x, weight in found:
            held[x] = np.array([i]), np.array([1.0 if norm == "n0" else 1 / size if norm == "n1" else weight])
    return held


def edges(trees: DataFrame, problems: dict[int, list], kids: dict[int, list] | None = None, norm: str = "n0", rename: dict[str, str] | None = None, weighting: str = "n") -> DataFrame:
    """(tree_id, newick) -> (sub_id, i, j, good, bad): the quartet graph of each subproblem over all trees; i < j are places in its taxa.

    weighting: by what quartets weigh besides, as in weights: nothing (n), lengths (l), supports (s) or both (h).
    Each task adds up its trees before anything is shuffled: taxa squared, however many trees. The problems and the kids of their made-up taxa
    travel with the plan; they hold taxa squared at most, whatever the number of trees.
    """
    kids = kids or {}
    weights.checked(weighting)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for text in batch.column("newick").to_pylist():
                if not text:
                    continue
                root = newick.parse(text, rename)
                counts = Counter(x.name for x in root.leaves())
                for s, problem in problems.items():
                    held = _weights(problem, kids, norm, counts)
                    found = edge_sums(root, held, len(problem)) if weighting == "n" else weights.edge_sums(root, held, len(problem), weighting)
                    sums[s] = [a + b for a, b in zip(sums[s], found)] if s in sums else list(found)
        for s, (good, bad) in sums.items():
            i, j = np.triu_indices(len(good), 1)
            some = (good[i, j] != 0) | (bad[i, j] != 0)
            i, j = i[some], j[some]
            yield pa.RecordBatch.from_pydict({"sub_id": pa.array(np.full(len(i), s), pa.int64()), "i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "good": pa.array(good[i, j], pa.float64()), "bad": pa.array(bad[i, j], pa.float64())})

    rows = trees.select("newick").mapInArrow(add_up, "sub_id long, i long, j long, good double, bad double")
    return rows.groupBy("sub_id", "i", "j").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def leaf_names(trees: DataFrame, rename: dict[str, str] | None = None) -> list[str]:
    """All leaves' names, in order; on the driver, which holds the species tree over them."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for text in batch.column("newick").to_pylist():
                if text:
                    seen |= {x.name for x in newick.parse(text, rename).leaves()}
        yield pa.RecordBatch.from_pydict({"name": pa.array(sorted(seen), pa.string())})

    return sorted(r["name"] for r in trees.select("newick").mapInArrow(names, "name string").distinct().collect())


def tree_graph(trees: DataFrame, rename: dict[str, str] | None = None, weighting: str = "n") -> DataFrame:
    """(tree_id, newick) -> (i, j, good, bad) by leaves' names, as quartet_graph has them of all quartets of the trees."""
    trees = written(trees.select("newick"), "gene-trees")
    names = leaf_names(trees, rename)
    spark = trees.sparkSession
    named = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k long, name string")
    one = edges(trees, {0: names}, rename=rename, weighting=weighting).drop("sub_id")
    for x in ("i", "j"):
        one = one.join(F.broadcast(named.select(F.col("k").alias(x), F.col("name").alias(f"_{x}"))), x).drop(x).withColumnRenamed(f"_{x}", x)
    return one.select("i", "j", "good", "bad")


def cuts(graphs: DataFrame, sizes: dict[int, int], iter_limit: int = 3, seed: int = 1) -> DataFrame:
    """(sub_id, i, j, good, bad) -> (sub_id, place, side): max-cut of each subproblem's graph; nothing where there is none."""

    def cut(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = sizes[int(key[0])]
        good, bad = np.zeros((2, n, n))
        i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
        for m, name in ((good, "good"), (bad, "bad")):
            m[i, j] = m[j, i] = rows[name].to_numpy(float)
        side = graph.qmc_cut(good, bad, iter_limit, seed)
        return pd.DataFrame({"sub_id": key[0], "place": np.arange(n) if side is not None else [], "side": side if side is not None else []})

    return graphs.groupBy("sub_id").applyInPandas(cut, "sub_id long, place long, side int")


def frequencies(trees: DataFrame, tree: Node, rename: dict[str, str] | None = None, weighting: str = "n") -> DataFrame:
    """(tree_id, newick) and a binary tree -> (branch, f1, f2, f3): each gene tree has one vote a branch, shared out among its quartets there.

    Branches and their parts are those of support.quadripartitions over the table of the same tree. Trees are read once, added up in their task. Weighted
    (l, s, h), sums over the trees are scaled by sqrt(trees / sum of squared totals), trees with a total over 1e-9 counting.
    """
    branches, code = quadripartitions(tree)
    weights.checked(weighting)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(branches), 5))
        for batch in batches:
            for text in batch.column("newick").to_pylist():
                if text and branches:
                    root = newick.parse(text, rename)
                    found = around(root, code, len(branches)) if weighting == "n" else weights.around(root, code, len(branches), weighting)
                    size = found.sum(1, keepdims=True)
                    some = size > 1e-9
                    total += np.where(some, np.hstack([found / np.where(some, size, 1) if weighting == "n" else found, size * size, some]), 0)
        yield pa.RecordBatch.from_pydict({"branch": pa.array(branches, pa.int64())} | {c: pa.array(total[:, k], pa.float64()) for k, c in enumerate(("f1", "f2", "f3", "squares", "n"))})

    rows = trees.select("newick").mapInArrow(count, "branch long, f1 double, f2 double, f3 double, squares double, n double")
    scale = F.lit(1.0) if weighting == "n" else F.coalesce(F.sqrt(F.sum("n") / F.when(F.sum("squares") > 0, F.sum("squares"))), F.lit(0.0))
    return rows.groupBy("branch").agg(*((F.sum(f) * scale).alias(f) for f in ("f1", "f2", "f3")))


def total_weights(trees: DataFrame, weighting: str = "n", rename: dict[str, str] | None = None) -> DataFrame:
    """(tree_id, newick) -> (tree_id, weight): what the quartets that each tree resolves weigh together."""
    weights.checked(weighting)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [0.0 if not t else float(quartets_shown(newick.parse(t, rename))) if weighting == "n" else weights.total_weight(newick.parse(t, rename), weighting) for t in batch.column("newick").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("tree_id"), pa.array(found, pa.float64())], ["tree_id", "weight"])

    return trees.select(F.col("tree_id").cast("long").alias("tree_id"), "newick").mapInArrow(weigh, "tree_id long, weight double")


def quadripartitions(tree: Node) -> tuple[list[int], dict[str, np.ndarray]]:
    """(branches by node_id, for each leaf's name its part of each branch): children 0 and 1, sibling 2, the rest 3, as in ancestry.Branches."""
    rows = newick.nodes(tree)
    branches = Branches(Ancestry(*map(list, zip(*((r[0], r[1], r[2], r[-1]) for r in rows)))))
    part = np.log2(branches.codes()).astype(np.int64)
    return branches.ids, dict(zip(branches.tree.names.to_pylist(), part.T))
