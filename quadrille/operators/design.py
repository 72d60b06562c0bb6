"""Designs of 24-taxon blocks, and samples of quartets."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sites import block_quartets

BLOCK = 24


def block_count(n: int, k: float, block: int = BLOCK) -> int:
    """Blocks that hold about n ** k quartets; one where the taxa fit in a block."""
    if n < block:
        raise ValueError(f"{n} taxa; a block has {block}")
    return 1 if n == block else math.ceil(math.floor(n**k) / math.comb(block, 4))


def pair_balanced(n: int, blocks: int, block: int = BLOCK, seed: int = 42, taxon_weight: float = 2.0) -> np.ndarray:
    """(blocks, block) taxa: each block starts with the pair that was together least often and grows by the taxon that adds least.

    What a taxon adds is how often it was with the block's taxa, and taxon_weight times how often it was used. Ties are drawn. Pairs of the least count wait
    in one queue, drawn once in random order; a pair that has been together since is passed over, and an empty queue is filled with those of the next count.
    So pairs are looked through once for each count and not once for each block.
    """
    rng = np.random.default_rng(seed)
    pairs, used = np.zeros((n, n)), np.zeros(n)
    out = np.empty((blocks, block), np.int64)
    upper = np.triu_indices(n, 1)
    waiting, level = iter(()), -1
    for b in range(blocks):
        while (first := next((k for k in waiting if pairs[upper[0][k], upper[1][k]] == level), None)) is None:
            counts = pairs[upper]
            level = counts.min()
            waiting = iter(rng.permutation(np.flatnonzero(counts == level)))
        members = [int(upper[0][first]), int(upper[1][first])]
        # A fraction for each taxon breaks ties between whole numbers.
        cost = pairs[members].sum(0) + taxon_weight * used + rng.random(n) / 2 * min(1.0, taxon_weight or 1.0)
        cost[members] = np.inf
        while len(members) < block:
            t = int(cost.argmin())
            members.append(t)
            cost += pairs[t]
            cost[t] = np.inf
        out[b] = sorted(members)
        pairs[np.ix_(members, members)] += 1
        used[members] += 1
    return out


def design(spark: SparkSession, n: int, k: float = 3.0, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """(block_id, members)."""
    rows = pair_balanced(n, block_count(n, k, block), block, seed)
    return spark.createDataFrame(pd.DataFrame({"block_id": np.arange(len(rows)), "members": rows.tolist()}), "block_id long, members array<long>")


def design_quartets(spark: SparkSession, n: int, budget: int, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """(block_id, q0..q3) of as many blocks as hold the budget of quartets."""
    rows = pair_balanced(n, max(1, math.ceil(budget / math.comb(block, 4))), block, seed)
    return block_quartets(spark.createDataFrame(pd.DataFrame({"block_id": np.arange(len(rows)), "members": rows.tolist()}), "block_id long, members array<long>"))


def unranked(ranks: np.ndarray, n: int, k: int = 4) -> np.ndarray:
    """Row by row the k-combination of range(n) with that rank in lexicographic order.

    Counted from the other end, a rank is a sum of binomials whose tops fall: the largest C(t, k) within it, then the largest C(t, k - 1) within the
    rest, and so on. Each is looked up in the sorted column of its binomials.
    """
    left = math.comb(n, k) - 1 - np.asarray(ranks, np.int64)
    if len(left) and (left.min() < 0 or left.max() >= math.comb(n, k)):
        raise ValueError("no such rank")
    out = np.empty((len(left), k), np.int64)
    for j in range(k):
        column = np.array([math.comb(t, k - j) for t in range(n)])
        top = np.searchsorted(column, left, "right") - 1
        out[:, j], left = n - 1 - top, left - column[top]
    return out


def sampled_quartets(spark: SparkSession, n: int, size: int, seed: int = 0) -> DataFrame:
    """(q0..q3): a sample of distinct quartets of range(n); all of them where size is 0 or not below their number.

    Ranks are drawn, and each is turned into its quartet on the executors.
    """
    total = math.comb(n, 4)
    if size <= 0 or size >= total:
        ranks = spark.range(total)
    else:
        draws = spark.range(math.ceil(1.2 * size) + 64).select(F.floor(F.rand(seed) * total).cast("long").alias("id")).distinct()
        ranks = draws.orderBy(F.xxhash64("id")).limit(size) if total > 4 * size else spark.range(total).orderBy(F.rand(seed)).limit(size)

    def turn(batches):
        for batch in batches:
            yield pd.DataFrame(unranked(batch["id"].to_numpy(), n), columns=["q0", "q1", "q2", "q3"])

    return ranks.mapInPandas(turn, "q0 long, q1 long, q2 long, q3 long")


def noisy(splits: DataFrame, correct: float, seed: int = 0) -> DataFrame:
    """Splits of a model tree of which a share 1 - correct are changed to another class, as drawn by a hash."""
    u = F.pmod(F.xxhash64("a", "b", "c", "d", F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    wrong, other = u >= correct, F.pmod(F.xxhash64("d", "c", "b", "a", F.lit(seed)), F.lit(2)) == 0
    first, second = F.struct(F.col("a"), F.col("c").alias("b"), F.col("b").alias("c"), F.col("d")), F.struct(F.col("a"), F.col("d").alias("b"), F.col("b").alias("c"), F.col("c").alias("d"))
    pick: Column = F.when(wrong & other, first).when(wrong, second).otherwise(F.struct("a", "b", "c", "d"))
    return splits.select(pick.alias("s"), "w").select("s.*", "w")


def combinations(n: int) -> list[tuple[int, int, int, int]]:
    """All quartets of a small range."""
    return list(itertools.combinations(range(n), 4))
