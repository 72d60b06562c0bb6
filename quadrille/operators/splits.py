"""Aggregation of quartet weights and their splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import canonical, guarded, pairing, rounded_mean, top1_only

Q = ("q0", "q1", "q2", "q3")
W = ("w0", "w1", "w2")


def aggregated(weights: DataFrame, mode: str = "full", batch: str = "block_id") -> DataFrame:
    """(q0..q3, w0..w2) -> (q0..q3, s0..s2, n): sums and counts of a quartet's copies.

    full: over all copies; batch_only: within a batch, so quartets of several batches repeat; off: each copy by itself.
    """
    if mode == "off":
        return weights.select(*Q, *(F.col(w).alias(f"s{k}") for k, w in enumerate(W)), F.lit(1).cast("long").alias("n"))
    by = Q if mode == "full" else (batch, *Q)
    if mode not in ("full", "batch_only"):
        raise ValueError("mode is full, batch_only or off")
    return weights.groupBy(*by).agg(*(F.sum(w).alias(f"s{k}") for k, w in enumerate(W)), F.count("*").alias("n")).select(*Q, "s0", "s1", "s2", "n")


def merged(partials: DataFrame) -> DataFrame:
    """Partial sums and counts of the same quartets, added up."""
    return partials.groupBy(*Q).agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(3)), F.sum("n").alias("n"))


def top1(weights: DataFrame) -> DataFrame:
    """Weights with all but each quartet's first largest set to 0."""
    return weights.select(*[c for c in weights.columns if c not in W], *(c.alias(w) for w, c in zip(W, top1_only(*map(F.col, W)))))


def to_splits(aggregates: DataFrame) -> DataFrame:
    """(q0..q3, s0..s2, n) -> (a, b, c, d, w): the rounded mean of each class as a split; weights of 0 or less go."""
    cases = [F.struct(*(F.col(x).alias(n) for x, n in zip(pairing(k), "abcd")), rounded_mean(F.col(f"s{k}"), F.col("n")).alias("w")) for k in range(3)]
    return aggregates.select(F.explode(F.array(*cases)).alias("r")).select("r.*").filter("w > 0")


def repair_splits(weights: DataFrame, *keep: str) -> DataFrame:
    """(q0..q3, w0..w2) -> splits of a repair step: rounded weights, the largest at least 1."""
    cases = [F.struct(*(F.col(x).alias(n) for x, n in zip(pairing(k), "abcd")), w.alias("w")) for k, w in enumerate(guarded(*map(F.col, W)))]
    return weights.select(*keep, F.explode(F.array(*cases)).alias("r")).select(*keep, "r.*").filter("w > 0")


def summed(splits: DataFrame) -> DataFrame:
    """Equal splits added up."""
    return splits.groupBy("a", "b", "c", "d").agg(F.sum("w").alias("w"))


def frequency(pairs: DataFrame) -> DataFrame:
    """(a, b, c, d) in any order within pairs -> canonical splits and how often each occurs."""
    return pairs.select(canonical(*map(F.col, "abcd")).alias("s")).groupBy("s").agg(F.count("*").alias("freq")).select("s.*", "freq")


def by_weight(splits: DataFrame, weight: str = "w") -> DataFrame:
    """In descending order of weight, then by taxa: a total order."""
    return splits.orderBy(F.desc(weight), "a", "b", "c", "d")
