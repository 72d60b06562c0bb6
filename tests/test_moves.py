"""Moves of single taxa with splits in many tasks: the same sides and trees as in one."""

import numpy as np
import pandas as pd
import pytest

from quadrille.operators import graph
from quadrille.plans import assemble, newick


def rows(n, size, seed, wrong=0.2):
    """Random splits of a caterpillar, some of which are wrong, with whole weights."""
    rng = np.random.default_rng(seed)
    q = np.sort(np.array([rng.choice(n, 4, replace=False) for _ in range(size)]), axis=1)
    flip = rng.random(size) < wrong
    q[flip] = q[flip][:, [0, 2, 1, 3]]
    df = pd.DataFrame(q, columns=[*"abcd"]).assign(w=rng.integers(1, 9, size).astype(float))
    return df.groupby([*"abcd"], as_index=False).w.sum()


@pytest.mark.parametrize("seed, first", [(0, 1 << 14), (1, 2)])
def test_sides_are_those_of_one_task(spark, seed, first):
    df = rows(14, 400, seed)
    names = np.arange(14) * 7 - 3
    taxa, side = graph.sides_by_moves(spark.createDataFrame(df.assign(**{x: names[df[x]] for x in "abcd"})).repartition(8), first)
    assert taxa.tolist() == names.tolist() and side.tolist() == graph.fm_bipartition(df[[*"abcd"]].to_numpy(), df.w.to_numpy(), 14).tolist()
    assert 2 <= side.sum() <= 12


def test_heavy_splits_that_leave_taxa_out(spark):
    """The first splits in order hold six of eight taxa, so more are looked at."""
    df = pd.DataFrame([(0, 1, 2, 3, 9.0), (0, 1, 4, 5, 8.0), (2, 3, 4, 5, 7.0), (0, 6, 2, 7, 1.0)], columns=[*"abcdw"])
    assert graph.first_sides(df[[*"abcd"]].to_numpy()[:3], 8, False) is None
    taxa, side = graph.sides_by_moves(spark.createDataFrame(df), 1)
    assert side.tolist() == graph.fm_bipartition(df[[*"abcd"]].to_numpy(), df.w.to_numpy(), 8).tolist()


def test_no_task_holds_all_splits(spark):
    """What a task gets of a move are splits with the taxon that moves; of a pass, its own part."""
    df = rows(10, 300, 3)
    parts = spark.createDataFrame(df).repartition(8)
    side = np.array([0, 1] * 5, np.int8)
    whole = graph._summed(parts, side, None)
    q, w = df[[*"abcd"]].to_numpy(), df.w.to_numpy()
    score = lambda s: (w * graph._statuses(s[q])).sum()
    for t in range(10):
        moved = side.copy()
        moved[t] = 1 - moved[t]
        assert whole[0][t] == score(moved) - score(side)
        change = graph._summed(parts.filter(f"a = {t} or b = {t} or c = {t} or d = {t}"), side, t)
        assert np.allclose(whole[0] + change[0], graph._summed(parts, moved, None)[0])


def test_assembly_with_moves_apart(spark, monkeypatch):
    df = rows(12, 900, 5, 0.0)
    want = assemble.assemble(spark.createDataFrame(df))
    monkeypatch.setattr(assemble, "APART", 300)
    got = assemble.assemble(spark.createDataFrame(df), local=200)
    assert newick.splits(got) == newick.splits(want) and len(got.leaves()) == 12
