"""Approximate nearest neighbours by a forest of random-projection trees."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import best, matrix, same_width, searched, usable

#: The trees' planes are fitted on so many rows at most, those of the smallest hash of id. Every row is indexed.
FIT_ROWS = 8192
#: Trees, and sample rows up to which a node is a leaf.
TREES, LEAF = 12, 12
#: A query's search goes on until the leaves it has met hold this share of a tree's sample rows, counted over all trees.
SHARE = 1.1


@dataclass
class Forest:
    """Trees in arrays over all nodes. Children below 0 are leaves: -1 - leaf."""

    planes: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: list[int]
    leaf_tree: np.ndarray
    leaf_rows: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        planes, offsets, children, roots, leaf_tree, leaf_rows = [], [], [], [], [], []

        def grow(rows: np.ndarray, tree: int) -> int:
            for _ in range(3 if len(rows) > leaf else 0):
                a, b = x[rng.choice(rows, 2, replace=False)]
                plane = a - b + 1e-9 * rng.standard_normal(x.shape[1])
                plane /= np.linalg.norm(plane)
                side = x[rows] @ plane
                cut = float(np.median(side))
                left, right = rows[side <= cut], rows[side > cut]
                if len(left) and len(right):
                    node = len(planes)
                    planes.append(plane)
                    offsets.append(cut)
                    children.append((0, 0))
                    children[node] = (grow(left, tree), grow(right, tree))
                    return node
            leaf_tree.append(tree)
            leaf_rows.append(len(rows))
            return -len(leaf_rows)

        for t in range(trees if len(x) else 0):
            roots.append(grow(np.arange(len(x)), t))
        width = x.shape[1] if x.ndim == 2 else 0
        return cls(np.array(planes).reshape(-1, width), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), roots, np.array(leaf_tree, np.int64), np.array(leaf_rows, np.int64))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree."""
        at = np.tile(np.array(self.roots, np.int64), (len(x), 1))
        while (inner := at >= 0).any():
            row, tree = np.nonzero(inner)
            node = at[row, tree]
            right = np.einsum("ij,ij->i", x[row], self.planes[node]) > self.offsets[node]
            at[row, tree] = self.children[node, right.astype(int)]
        return -1 - at

    def visited(self, x: np.ndarray, share: float) -> list[np.ndarray]:
        """For each row the leaves that a search meets, best first, through one queue that all trees share."""
        margins = x @ self.planes.T - self.offsets
        most, out = share * self.leaf_rows[self.leaf_tree == 0].sum(), []
        rows, children, roots = self.leaf_rows.tolist(), self.children.tolist(), self.roots
        for margin in margins.tolist():
            queue, met, held = sorted((0.0, r) for r in roots), [], 0
            while queue and held < most:
                far, node = heapq.heappop(queue)
                while node >= 0:
                    m = margin[node]
                    heapq.heappush(queue, (far + abs(m), children[node][m <= 0]))
                    node = children[node][m > 0]
                met.append(-1 - node)
                held += rows[-1 - node]
            out.append(np.array(met, np.int64))
        return out


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Candidates with one component more, which brings all to the norm `top`: nearest is then largest product."""
    return np.hstack([x, np.sqrt(np.maximum(top**2 - (x**2).sum(1), 0))[:, None]])


def nearest(vectors: DataFrame, is_query, k: int, id_col: str = "vec_id", vec_col: str = "embedding", share: float = SHARE, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of largest inner product among those its search meets.

    Planes between two random sample rows, at the median, make the trees; all rows are indexed in all of them. A
    query walks down every tree from one queue, in order of the sum of its distances to the planes it crossed, until the leaves met hold
    `share` of the sample's rows. The rows of these leaves in all shards are the candidates; each is scored
    exactly, in double precision, once. Products are brought to distances by one more component, from the largest norm.

    Rows with a null id, or whose vector is null, zero or holds null or non-finite components, take no part. A row is
    no candidate for queries of its own id. Shorter vectors count as filled up with zeros. Repeated rows
    are candidates each; a repeated query is asked once. An empty table gives an empty result.
    """
    rows = usable(vectors, id_col, vec_col).withColumn("v", F.col("v").cast("array<double>")).filter(F.exists("v", lambda x: x != 0))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    top = rows.agg(F.sqrt(F.max(norm)).alias("top"), F.max(F.size("v")).alias("width")).first()
    width, norm_max = top["width"] or 0, top["top"] or 0.0
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(fit_rows).toArrow()
    x = matrix(sample.column("v")) if sample.num_rows else np.zeros((0, width))
    shape = np.zeros((0, width))
    forest = Forest.fit(lifted(same_width(x, shape)[0], norm_max))

    def visit(batches):
        f = forest
        for batch in batches:
            if batch.num_rows:
                v = same_width(matrix(batch.column("v")), shape)[0]
                met = f.visited(np.hstack([v, np.zeros((len(v), 1))]), share)
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "v": batch.column("v"), "leaves": pa.array(met, pa.list_(pa.int32()))})

    def kernel(tile: pa.Table, shard: pa.Table) -> pa.Table:
        f = forest
        q, first = np.unique(tile.column("id").to_numpy(), return_index=True)
        ids = shard.column("id").to_numpy()
        a, b = same_width(matrix(tile.column("v"))[first], matrix(shard.column("v")))
        leaf = f.leaves(lifted(same_width(b, shape)[0], norm_max))
        # Postings of all leaves: rows in order of leaf, and where each leaf's rows start.
        order = np.argsort(leaf, axis=None, kind="stable")
        posted = order // leaf.shape[1]
        starts = np.searchsorted(leaf.ravel()[order], np.arange(len(f.leaf_rows) + 1))
        visits, out = tile.column("leaves").take(pa.array(first)), []
        for i in range(len(q)):
            met = np.asarray(visits[i].values)
            size = starts[met + 1] - starts[met]
            at = np.arange(size.sum()) + np.repeat(starts[met] - (np.cumsum(size) - size), size)
            found = np.unique(posted[at])
            found = found[ids[found] != q[i]]
            score = b[found] @ a[i]
            near = best(score, ids[found], k + 4)
            # Scores of the few kept are summed in one order whatever the shard holds, so reruns agree.
            exact = np.array([float(np.dot(a[i], b[j])) for j in found[near]])
            near = near[np.lexsort((ids[found][near], -exact))][:k]
            exact = np.sort(exact)[::-1][:k]
            out.append((np.full(len(near), q[i]), ids[found][near], exact))
        cols = [np.concatenate(x) for x in zip(*out)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    asked = rows.filter(is_query)
    asked = asked.repartition(max(1, vectors.sparkSession.sparkContext.defaultParallelism), "id").mapInArrow(visit, "id long, v array<double>, leaves array<int>")
    return searched(rows, asked, kernel, k, "double")
