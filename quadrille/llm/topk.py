"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import best, matrix, same_width, searched, usable

#: Scores held at a time within a cell.
SCORES = 4 << 20


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of matrices of whole numbers in doubles; by floating point where that is exact."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2.0**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    wide = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([[min(max(x, low), high) for x in r] for r in wide], np.int64)


def exact_top_k(vectors: DataFrame, is_query, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer products, ties to the smaller id.

    Components become floor(scale * x). is_query: a condition on the column id. Candidates are all rows but those of
    the query's own id. A cell of the grid multiplies its tile of queries with its shard strip by strip, keeps each
    query's k best and passes only these on; top lists are merged as a tree.

    Rows with a null id, or whose vector is null or holds null or non-finite components, take no part. Vectors of different
    length are compared as if filled up with zeros. Repeated rows are candidates each; a repeated
    query is asked once. Products beyond 64 bits are cut to that range. An empty table gives an empty result.
    """
    rows = usable(vectors, id_col, vec_col).withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("double")))

    def kernel(tile: pa.Table, shard: pa.Table) -> pa.Table:
        q, first = np.unique(tile.column("id").to_numpy(), return_index=True)
        ids = shard.column("id").to_numpy()
        a, b = same_width(matrix(tile.column("v"))[first], matrix(shard.column("v")))
        out = []
        step = max(1, SCORES // len(ids))
        for at in range(0, len(q), step):
            for i, row in enumerate(_exact(a[at : at + step], b), at):
                own = ids == q[i]
                others, seen = (row[~own], ids[~own]) if own.any() else (row, ids)
                top = best(others, seen, k)
                out.append((np.full(len(top), q[i]), seen[top], others[top]))
        cols = [np.concatenate(x) for x in zip(*out)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, cols))))

    return searched(rows, rows.filter(is_query), kernel, k, "long")
