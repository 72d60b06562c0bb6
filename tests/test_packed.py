"""Packed splits: division in one pass, gains of places, and assembly of levels without a join."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrille.operators import graph
from quadrille.plans import assemble, newick


def rows(n, size, seed, wrong=0.1):
    """Random splits of a caterpillar, some of which are wrong; some are equal."""
    rng = np.random.default_rng(seed)
    q = np.sort(rng.integers(0, n, (size, 4)), axis=1)
    q = q[(np.diff(q, axis=1) > 0).all(1)]
    flip = rng.random(len(q)) < wrong
    q[flip] = q[flip][:, [0, 2, 1, 3]]
    return pd.DataFrame(q, columns=[*"abcd"]).assign(w=rng.integers(1, 50, len(q)).astype(float))


def collected(df):
    """Equal splits added up, of each subproblem."""
    return {tuple(r)[:-1]: r["w"] for r in df.groupBy("sub_id", *"abcd").agg(F.round(F.sum("w"), 6).alias("w")).collect()}


@pytest.mark.parametrize("sizes", [False, True])
def test_division_in_one_pass(spark, monkeypatch, sizes):
    """As by joins, over subproblems of which one is not cut, with taxa near and far apart."""
    for name, value in (("CHUNK", 7), ("SLICE", 50), ("RUN", 9)):
        monkeypatch.setattr(graph, name, value)
    parts = {3: rows(30, 900, 0).assign(sub_id=3), 5: rows(20, 500, 1).assign(sub_id=5), 9: rows(25, 700, 2).assign(sub_id=9)}
    for x in "abcd":
        parts[9][x] *= 1 << 40
    df = spark.createDataFrame(pd.concat(parts.values())).repartition(3)
    level = graph.Level({s: np.unique(p[[*"abcd"]]) for s, p in parts.items()})
    held = graph.packed(df, level)
    assert collected(graph.unpacked(held, level, [3, 9])) == collected(df.filter("sub_id <> 5")) and held.agg(F.max("n")).first()[0] <= 7
    side = np.random.default_rng(3).integers(0, 2, len(level.ids)).astype(np.int8)
    gain, score = graph._gains(held, side)
    want = np.zeros(len(side))
    for k, (s, p) in enumerate(parts.items()):
        q = level.places(k, p[[*"abcd"]].to_numpy())
        for at in range(4):
            moved = side[q]
            moved[:, at] = 1 - moved[:, at]
            np.add.at(want, q[:, at], p.w.to_numpy() * (graph._statuses(moved) - graph._statuses(side[q])))
        assert score[level.part(k)].sum() == (p.w * graph._statuses(side[q])).sum()
    assert np.allclose(gain, want)
    cut = {3: (-7, 11, 12), 9: (-8, 13, 14)}
    own = {s: (level.ids[level.part(k)], side[level.part(k)]) for k, s in enumerate((3, 5, 9)) if s in cut}
    following = graph.Level({cut[s][1 + x]: np.sort(np.append(t[y == x], cut[s][0])) for s, (t, y) in own.items() for x in (0, 1)})
    counts = np.array([[(side[level.part(k)] == x).sum() for x in (0, 1)] for k in range(3)]) if sizes else None
    got = collected(graph.unpacked(graph.children(held, level, side, cut, following, counts), following, [11, 12, 13, 14]))
    sides = spark.createDataFrame([(s, int(t), int(x)) for s, (taxa, y) in own.items() for t, x in zip(taxa, y)], "sub_id long, taxon long, side int")
    made = F.when(F.col("sub_id") == 3, -7).otherwise(-8).cast("long")
    by = graph.divided(df.filter("sub_id <> 5"), sides, made, sides.groupBy("sub_id", "side").agg(F.count("*").alias("n")) if sizes else None, ("sub_id",))
    want = by.withColumn("sub_id", F.when(F.col("sub_id") == 3, 11).otherwise(13).cast("long") + F.col("side")).drop("side")
    assert got == collected(want) and len(got) > 300


@pytest.mark.parametrize("repeat", [0, 1 << 20])
def test_levels_divide_without_joins(spark, monkeypatch, repeat):
    """Splits of large subproblems are neither joined with their sides nor shuffled when these divide."""

    def none(*args):
        raise AssertionError("splits were joined with sides")

    monkeypatch.setattr(graph, "with_sides", none)
    monkeypatch.setattr(assemble, "OFTEN", repeat, raising=False)
    df = spark.createDataFrame(rows(60, 20_000, 4, 0.0))
    got = assemble.assemble(df, local=3000)
    assert len(got.leaves()) == 60 and newick.splits(got) == newick.splits(assemble.assemble(df))
