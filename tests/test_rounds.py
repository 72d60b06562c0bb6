"""Cuts of many taxa by rounds, with splits in many tasks."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quadrille.operators import graph
from quadrille.plans import assemble, newick


def rows(n, size, seed, wrong=0.1):
    """Random splits of a caterpillar, some of which are wrong."""
    rng = np.random.default_rng(seed)
    q = np.sort(rng.integers(0, n, (size, 4)), axis=1)
    q = q[(np.diff(q, axis=1) > 0).all(1)]
    flip = rng.random(len(q)) < wrong
    q[flip] = q[flip][:, [0, 2, 1, 3]]
    return pd.DataFrame(q, columns=[*"abcd"]).assign(w=rng.integers(1, 50, len(q)).astype(float)).groupby([*"abcd"], as_index=False).w.sum()


def score(q, w, side):
    return (w * graph._statuses(side[q])).sum()


def test_rounds_are_as_good_as_single_moves(spark):
    """Two subproblems at once, each against the cut of one task."""
    parts = {7: rows(200, 12_000, 0), 9: rows(150, 9_000, 1)}
    df = pd.concat([p.assign(sub_id=s, **{x: p[x] * 3 + s for x in "abcd"}) for s, p in parts.items()])
    splits = spark.createDataFrame(df).repartition(5)
    found = graph.sides_by_rounds(splits).toPandas()
    for s, p in parts.items():
        q, w = p[[*"abcd"]].to_numpy(), p.w.to_numpy()
        own = found[found.sub_id == s].sort_values("taxon")
        assert own.taxon.tolist() == [t * 3 + s for t in range(len(own))] and 2 <= own.side.sum() <= len(own) - 2
        best = score(q, w, graph.fm_bipartition(q, w, len(own)))
        assert score(q, w, own.side.to_numpy()) > 0.99 * best
    again = graph.sides_by_rounds(splits.repartition(3)).toPandas()
    assert sorted(map(tuple, again.to_numpy())) == sorted(map(tuple, found.to_numpy()))


def test_jobs_do_not_grow_with_taxa(spark):
    """Single moves take a job a taxon and pass."""

    def jobs(n):
        df = spark.createDataFrame(rows(n, 60 * n, 2).assign(sub_id=0))
        spark.sparkContext.setJobGroup(f"rounds-{n}", "")
        graph.sides_by_rounds(df)
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds-{n}"))
        spark.sparkContext.setJobGroup("", "")
        return found

    assert 0 < jobs(400) < 80


def test_small_gains_and_ties():
    assert graph._tried(np.array([0, 0, 1, 1], np.int8), np.ones(4), 1.0)[0].tolist() == [1, 1, 0, 0]
    assert graph._tried(np.array([0, 0, 1, 1], np.int8), np.array([1.0, 0, 0, 0]), 1.0)[0] is None
    moved, share, k = graph._tried(np.array([0, 0, 0, 1, 1, 1], np.int8), np.array([3.0, 2, 1, 0, 0, 0]), 1.0)
    assert moved.tolist() == [1, 0, 0, 1, 1, 1] and k == 1 and share == 0.25


def test_assembly_by_rounds(spark, monkeypatch):
    """A caterpillar of 80 taxa comes back, as from one task."""
    monkeypatch.setattr(assemble, "APART", 3000)
    monkeypatch.setattr(assemble, "FEW_TAXA", 20, raising=False)
    df = spark.createDataFrame(rows(80, 40_000, 3, 0.0))
    want = assemble.assemble(df, local=1 << 20)
    got = assemble.assemble(df, local=2000)
    assert len(got.leaves()) == 80 and newick.splits(got) == newick.splits(want)
    assert df.filter(F.col("a") >= F.col("b")).count() == 0
