"""Vectors packed into matrices, and the grid of query tiles and shards that searches run over."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import tasks

#: Rows of a tile of queries and of a shard of vectors; both bound a task's memory.
TILE, SHARD = 8192, 16384
#: Shards whose top lists are merged at a time.
FAN = 16


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that have an id and a vector without null or non-finite components; v holds doubles."""
    huge = F.lit(float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return rows.filter("id is not null and v is not null").filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < huge)))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as doubles; shorter rows are filled up with zeros."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], column.type)
    sizes = np.asarray(whole.value_lengths()).astype(np.int64)
    flat = np.asarray(whole.flatten()).astype(np.float64)
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, w - x.shape[1]))) for x in (a, b))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id, in that order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def searched(vectors: DataFrame, queries: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], k: int, score_type: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of what kernel(tile, shard) returns for each cell of the grid.

    vectors, queries: id, v and any further columns. Every vector is in one shard and every query in one tile; each
    pair of them is a cell, dealt evenly. Tiles and shards are sized by counts, so a cell fits in memory and there is one
    for every task at least. A kernel returns k rows a query at most. These lists are merged FAN shards at a time.
    """
    spark = vectors.sparkSession
    n, q = vectors.count(), queries.count()
    g = max(1, math.ceil(q / TILE))
    s = max(math.ceil(2 * spark.sparkContext.defaultParallelism / g), math.ceil(n / SHARD))
    shards = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(s)).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    tiles = queries.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(g)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(s - 1))))
    schema = f"query_id long, vec_id long, score {score_type}, shard int"

    def cell(key, tile: pa.Table, shard: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64() if score_type == "long" else pa.float64())})
        tile, shard = tile.rename_columns(tile_names), shard.rename_columns(shard_names)
        found = kernel(tile, shard) if tile.num_rows and shard.num_rows else empty
        return found.append_column("shard", pa.array(np.full(found.num_rows, key[0].as_py()), pa.int32()))

    # Both sides come from one table: under new names their columns can't be taken for each other.
    tile_names, shard_names = tiles.columns, shards.columns
    tiles, shards = tiles.toDF(*(f"t_{c}" for c in tile_names)), shards.toDF(*(f"s_{c}" for c in shard_names))
    cells = min(s * g, max(tasks(spark), s * g // 4))
    lists = (
        tiles.repartition(cells, "t_shard", "t_tile")
        .groupBy("t_shard", "t_tile")
        .cogroup(shards.repartition(cells, "s_shard", "s_tile").groupBy("s_shard", "s_tile"))
        .applyInArrow(cell, schema)
    )
    while s > FAN:
        lists = _top(lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int")), ["query_id", "shard"], k)
        s = math.ceil(s / FAN)
    ranked = _top(lists, ["query_id"], k, "rank")
    return ranked.select("query_id", "rank", "vec_id", "score")


def _top(lists: DataFrame, by: list[str], k: int, name: str = "_r") -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    kept = lists.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= k)
    return kept if name != "_r" else kept.drop("_r")
