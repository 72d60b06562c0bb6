"""A tree against the true one."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.ancestry import Ancestry
from ..operators.design import unranked
from ..sources.quartets import Config
from . import newick
from .newick import Node

#: Above so many common leaves a sample is taken where none is asked for, of so many quartets.
WIDE, SAMPLE = 96, 10_000
#: Quartets that the driver compares at a time.
BATCH = 1 << 18


def common(one: Node, two: Node) -> tuple[Node, Node]:
    """Both trees over the leaves that both have, unrooted."""
    names = {x.name for x in one.leaves()} & {x.name for x in two.leaves()}
    return newick.unrooted(newick.pruned(one, names)), newick.unrooted(newick.pruned(two, names))


def drawn(n: int, sample: int | None, seed: int) -> tuple[int, np.ndarray | None]:
    """(number of quartets, their ranks if they are sampled): all up to WIDE leaves, beyond it SAMPLE, or as many as asked for; 0 or less is no request."""
    total = math.comb(n, 4)
    sample = None if sample is not None and sample <= 0 else sample
    if n > WIDE and sample is None:
        sample = SAMPLE
    if sample is None or sample >= total:
        return total, None
    return sample, np.array(random.Random(seed).sample(range(total), sample), np.int64)


def _indexed(tree: Node, names: list[str]) -> tuple[Ancestry, np.ndarray]:
    rows = newick.nodes(tree)
    found = Ancestry(*map(list, zip(*((r[0], r[1], r[2], r[-1]) for r in rows))))
    return found, found.numbers(pa.array(names))


def quartet_concordance(one: Node, two: Node, sample: int | None = None, seed: int = 42, shown: int = 3, spark: SparkSession | None = None) -> dict:
    """Share of quartets of common leaves that both trees resolve alike, or both leave open; drawn without repetition if sampled.

    shown: so many of the first mismatches are given, as names. Fewer than four common leaves: no quartets, concordance None. With a session, quartets are
    compared on executors, in ranges of their ranks; else on the driver, BATCH at a time.
    """
    names = sorted({x.name for x in one.leaves()} & {x.name for x in two.leaves()})
    if len(names) < 4:
        return {"evaluated": 0, "matches": 0, "concordance": None, "mismatches": []}
    count, ranks = drawn(len(names), sample, seed)
    (a, at), (b, bt) = (_indexed(t, names) for t in common(one, two))

    def compared(places: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        q = unranked(places if ranks is None else ranks[places], len(names))
        wrong = a.topologies(at[q])[0] != b.topologies(bt[q])[0]
        return int((~wrong).sum()), places[wrong][:shown], q[wrong][:shown]

    if spark is None:
        parts = [compared(np.arange(i, min(count, i + BATCH))) for i in range(0, count, BATCH)]
    else:

        def run(batches):
            for batch in batches:
                same, places, q = compared(batch["id"].to_numpy())
                yield pd.DataFrame({"same": [same], "places": [places.tolist()], "q": [q.tolist()]})

        rows = spark.range(count).mapInPandas(run, "same long, places array<long>, q array<array<long>>")
        first = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("places", "q")))), 1, shown)
        # Lists of `shown` mismatches meet task by task, then once.
        some = rows.groupBy(F.spark_partition_id()).agg(F.sum("same").alias("same"), first.alias("z")).selectExpr("same", "z.places places", "z.q q")
        got = some.agg(F.sum("same").alias("same"), first.alias("z")).first()
        parts = [(got["same"], np.array([z["places"] for z in got["z"]]), np.array([z["q"] for z in got["z"]]))]
    matches = sum(p[0] for p in parts)
    wrong = sorted((int(p), tuple(r)) for _, ps, q in parts for p, r in zip(ps, q.tolist()))[:shown]
    return {"evaluated": count, "matches": matches, "concordance": matches / count, "mismatches": [[names[i] for i in r] for _, r in wrong]}


def evaluated(tree: Node, truth: Node, config: Config | None = None, spark: SparkSession | None = None) -> dict:
    """The configured metric of a tree: Robinson-Foulds on common leaves, or quartet concordance on the configured sample; a sample of 0 or less is none."""
    config = config or Config()
    if config.metric == "rf":
        return {"rf": newick.rf_distance(*common(tree, truth))}
    return quartet_concordance(tree, truth, config.quartet_sample_size, config.seed, spark=spark)
