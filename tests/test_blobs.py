"""Searches by descent against all quartets, stored p-values, the tree of blobs."""

import itertools

import numpy as np
import pytest

from quadrille.functions import statistics
from quadrille.operators import blobs, support, trees
from quadrille.plans import newick
from quadrille.plans.infer import _table


def gene_trees(spark, tree, rng, n=40, moved=6):
    """Copies of a tree, most with some leaves exchanged, some without a leaf."""
    rows = []
    for i in range(n):
        t = tree.copy()
        leaves = t.leaves()
        for _ in range(int(rng.integers(0, moved))):
            a, b = rng.choice(len(leaves), 2, replace=False)
            leaves[a].name, leaves[b].name = leaves[b].name, leaves[a].name
        if i % 5 == 0:
            t = newick.pruned(t, {x.name for x in leaves[1:]})
        rows.append((i, newick.write(t, lengths=False)))
    return spark.createDataFrame([*rows, (n, None), (n + 1, "")], "tree_id long, newick string").repartition(3)


def case(spark, seed, n=9):
    rng = np.random.default_rng(seed)
    tree = newick.random_tree([f"t{i}" for i in range(n)], rng)
    return tree, _table(spark, tree), gene_trees(spark, tree, rng)


def test_counts_on_demand(spark, monkeypatch):
    monkeypatch.setattr(blobs, "SLICE", 20)
    tree, _, g = case(spark, 1, 7)
    names = sorted(x.name for x in tree.leaves())
    q = list(itertools.combinations(range(7), 4))[::2]
    got = {tuple(r)[:4]: tuple(r)[4:] for r in blobs.counted(g, spark.createDataFrame(q, "q0 int, q1 int, q2 int, q3 int"), names).collect()}
    factors = {(r["q0"], r["q1"], r["q2"], r["q3"]): (r["n0"], r["n1"], r["n2"]) for r in trees.concordance_factors(trees.gene_tree_quartets(g.filter("newick <> ''"))).collect()}
    assert got == {x: factors.get(tuple(names[i] for i in x), (0, 0, 0)) for x in q}


@pytest.mark.parametrize("star", [False, True])
def test_descent_finds_the_least(spark, star):
    """On a small tree it agrees with the search over all quartets."""
    _, table, g = case(spark, 2)
    every = blobs.with_p(trees.concordance_factors(trees.gene_tree_quartets(g.filter("newick <> ''"))))
    want = {r["branch"]: r for r in blobs.searched(every, support.quadripartitions(table)).collect()}
    got, values = blobs.descended(g, table, star=star, seed=5)
    found = {r["branch"]: r for r in got.collect()}
    assert found.keys() == want.keys() and len(found) == 6
    for b, r in found.items():
        assert r["p_star" if star else "p_tree"] == pytest.approx(want[b]["p_star" if star else "p_tree"], rel=1e-9, abs=1e-300)
    known = values.toPandas()
    assert not known.duplicated([*blobs.Q]).any() and len(known) <= 126
    p = {tuple(r[q] for q in blobs.Q): [r[c] for c in ("n0", "n1", "n2", "p_tree", "p_star")] for r in every.collect()}
    for r in known.to_dict("records"):
        assert [r[c] for c in ("n0", "n1", "n2", "p_tree", "p_star")] == pytest.approx(p.get(tuple(r[q] for q in blobs.Q), [0, 0, 0, 1, -1]))


def test_a_limit_bounds_what_is_looked_at(spark):
    _, table, g = case(spark, 3, 10)
    few = blobs.descended(g, table, limit=1, starts=1)
    assert few[0].count() == 7 and few[1].count() < 210


def test_blobs_from_stored_values(spark, tmp_path):
    """A second run counts nothing anew, and takes what the table says; branches that fail go."""
    tree, table, g = case(spark, 4)
    path = f"file://{tmp_path}/p"
    assert blobs.stored(spark, path).count() == 0
    one, branches = blobs.blob_tree(g, table, alpha=1e-3, beta=2, path=path)
    bad = {r["branch"] for r in branches.collect() if r["p_tree"] < 1e-3}
    assert one.count() == table.count() - len(bad) and {r["name"] for r in one.filter("is_leaf").collect()} == {x.name for x in tree.leaves()}
    first = blobs.stored(spark, path)
    n = first.count()
    again, same = blobs.blob_tree(g, table, alpha=1e-3, beta=2, path=path)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, branches.collect())) and blobs.stored(spark, path).count() == n and again.count() == one.count()
    # Values from elsewhere count as they are: with p-values of 0 all inner branches fail.
    zero = first.withColumn("p_tree", first["p_tree"] * 0)
    found, _ = blobs.descended(g, table, known=zero)
    star = blobs.tree_of_blobs(table, found, beta=2)
    assert all(r["p_tree"] == 0 for r in found.collect()) and star.filter("not is_leaf").count() < table.filter("not is_leaf").count()


def test_published_p_values_near_the_star():
    """Published values of the tree test, down to near the star point."""
    rows = [((22, 79, 69), 2.867199e-07), ((21, 80, 65), 9.485411e-07), ((24, 89, 56), 0.0002844678), ((22, 73, 61), 9.706682e-06), ((145, 82, 37), 2.953462e-05)]
    p = statistics.tree_test_p(np.array([c for c, _ in rows]))
    assert np.allclose(p, [x for _, x in rows], rtol=1e-3, atol=0)
    rng = np.random.default_rng(0)
    points = rng.normal(size=(400_000, 2))
    for mu, angle, z in ((0.0, 2 * np.pi / 3, 1.0), (1.5, 1.95, 0.8), (3.0, 2.0, 1.5)):
        x, y = (points + [mu, 0]).T
        turn, r = np.arctan2(y, x), np.hypot(x, y)
        off = np.abs((turn[:, None] - np.array([0, angle, -angle]) + np.pi) % (2 * np.pi) - np.pi)
        far = np.where(off < np.pi / 2, r[:, None] * np.sin(off), r[:, None]).min(1)
        assert abs((far > z).mean() - statistics._beyond(np.array([z]), np.array([mu]), np.array([angle]))[0]) < 0.003
    assert statistics.tree_test_p(np.zeros((2, 3))).tolist() == [1, 1] and len(statistics.tree_test_p(np.zeros((0, 3)))) == 0
