"""Sums over gene trees against listed quartets, and assembly from gene trees."""

import time

import numpy as np
import pandas as pd
import pytest

from quadrille.operators import genetrees, graph, support, trees, weights
from quadrille.plans import newick
from quadrille.plans.assemble import assemble_gene_trees
from quadrille.plans.infer import _table


def model(names, rng, loss=0.0):
    """A random tree, some inner nodes of which are contracted."""
    root = newick.random_tree(list(names), rng)
    for x in list(root.walk()):
        if x.children and x.parent is not None and rng.random() < loss:
            x.parent.children.remove(x)
            for c in x.children:
                x.parent.add(c)
    return root


def dressed(root, rng):
    """With lengths and supports, some of which are missing or more than 1."""
    for x in root.walk():
        x.length = float(rng.random()) if rng.random() < 0.9 else None
        x.support = float(rng.random() * 1.1) if x.children and rng.random() < 0.9 else None
    return root


def listed(root, held, m, weighting="n"):
    root = root.copy()
    for k, x in enumerate(root.leaves()):
        x.name = f"{k}|{x.name}"
    good, bad = np.zeros((m, m)), np.zeros((m, m))
    for *q, own in newick.all_quartets(root, weighting):
        names = [s.split("|")[1] for s in q]
        if all(s in held for s in names) and len(g := [int(held[s][0][0]) for s in names]) == len(set(g)):
            w = own * np.prod([held[s][1][0] for s in names])
            for x, y, to in ((0, 1, bad), (2, 3, bad), (0, 2, good), (0, 3, good), (1, 2, good), (1, 3, good)):
                to[g[x], g[y]] += w
                to[g[y], g[x]] += w
    return good, bad


@pytest.mark.parametrize("seed", range(12))
def test_edge_sums(seed):
    """Groups, weights, polytomies, leaves of one name, leaves that don't count."""
    rng = np.random.default_rng(seed)
    names = [str(i % 10) for i in range(rng.integers(3, 14))]
    root = model(names, rng, 0.4 * (seed % 3)) if len(names) > 3 else newick.parse("(0,1,2);")
    m = int(rng.integers(4, 9))
    held = {str(i): (np.array([rng.integers(m)]), np.array([rng.random() + 0.1])) for i in range(10) if rng.random() < 0.9}
    off = 1 - np.eye(m)
    for got, want in zip(genetrees.edge_sums(root, held, m), listed(root, held, m)):
        assert np.allclose(got * off, want)


def test_quartets_shown():
    rng = np.random.default_rng(4)
    for loss in (0, 0.3, 1):
        root = model([str(i) for i in range(11)], rng, loss)
        assert genetrees.quartets_shown(root) == len(newick.all_quartets(root))


def test_tree_graph_is_that_of_its_quartets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, newick.write(model([f"s{k}" for k in rng.permutation(9)[: rng.integers(4, 10)]], rng, 0.3), lengths=False)) for i in range(15)]
    df = spark.createDataFrame([*rows, (99, None), (100, "")], "tree_id long, newick string").repartition(3)
    got = genetrees.tree_graph(df).toPandas().sort_values(["i", "j"]).to_numpy().tolist()
    want = graph.quartet_graph(trees.gene_tree_quartets(df.filter("newick <> ''"))).toPandas().sort_values(["i", "j"]).to_numpy().tolist()
    assert got == want


def test_frequencies_agree_with_listed_quartets(spark):
    rng = np.random.default_rng(5)
    names = list("abcdefghi")
    tree = newick.rooted_at(model(names, rng), ["a"])
    tree = newick.parse(newick.write(tree, lengths=False))
    rows = [(i, newick.write(model(rng.permutation(names)[: rng.integers(4, 10)].tolist(), rng, 0.3), lengths=False)) for i in range(12)]
    df = spark.createDataFrame(rows, "tree_id long, newick string")
    table = _table(spark, tree)
    quads = support.quadripartitions(table)
    want = support.gene_tree_frequencies(trees.gene_tree_quartets(df), table).toPandas().set_index("branch").sort_index()
    got = genetrees.frequencies(df, tree).toPandas().set_index("branch").sort_index()
    assert (got.index == want.index).all() and np.allclose(got, want) and got.to_numpy().sum() > 0


def test_weights_of_made_up_taxa():
    from collections import Counter

    counts = Counter({"a": 1, "b": 2, "c": 1, "d": 1})
    kids = {1: ["a", "b", "x"], 2: ["c", 1], 3: ["x", "y"]}
    weigh = lambda norm: {k: (int(g[0]), float(w[0])) for k, (g, w) in genetrees._weights(["d", 2, 3], kids, norm, counts).items()}
    assert weigh("n0") == {k: (int(k != "d"), 1.0) for k in "abcd"}
    assert weigh("n1") == {"d": (0, 1.0), "a": (1, 0.25), "b": (1, 0.25), "c": (1, 0.25)}
    assert weigh("n2") == {"d": (0, 1.0), "c": (1, 0.5), "a": (1, 0.25), "b": (1, 0.125)}


@pytest.mark.parametrize("norm", ["n0", "n1", "n2"])
def test_species_tree_from_gene_trees(spark, norm):
    """Gene trees that lack taxa, some resolved wrongly, give the model tree."""
    rng = np.random.default_rng(7)
    names = [f"s{i}" for i in range(14)]
    tree = model(names, rng)
    rows = []
    for i in range(30):
        keep = set(rng.permutation(names)[:11].tolist())
        rows.append((i, newick.write(newick.pruned(tree, keep) if i % 6 else model(sorted(keep), rng), lengths=False)))
    metrics = []
    got = assemble_gene_trees(spark.createDataFrame(rows, "tree_id long, newick string"), norm, metrics=metrics)
    assert newick.rf_distance(got, tree) == 0
    assert metrics[0] == {"id": 0, "parent": None, "depth": 0, "size": 14, "artificial": 0, "subset": sorted(names)}


def test_odd_gene_trees(spark):
    few = spark.createDataFrame([(1, "(a,b,c);"), (2, None)], "tree_id long, newick string")
    assert sorted(x.name for x in assemble_gene_trees(few).leaves()) == list("abc")
    star = spark.createDataFrame([(1, "(a,b,c,d,e);")], "tree_id long, newick string")
    assert len(assemble_gene_trees(star).children) == 5
    many = spark.createDataFrame([(1, "((a1,a2),b1,((c1,d1),e1));")], "tree_id long, newick string")
    got = assemble_gene_trees(many, rename={f"{x}{i}": x for x in "abcde" for i in "12"})
    assert newick.rf_distance(got, newick.parse("((a,b),(c,d),e);")) == 0
    with pytest.raises(ValueError, match="norm"):
        assemble_gene_trees(star, "n4")
    assert pd.DataFrame(genetrees.edges(few.limit(0), {0: list("abcd")}).collect()).empty


@pytest.mark.parametrize("weighting", ["n", "l", "s", "h"])
@pytest.mark.parametrize("seed", range(8))
def test_weighted_edge_sums(seed, weighting):
    """Groups that leaves share, weights, polytomies, roots of two and of three children."""
    rng = np.random.default_rng(seed)
    names = [str(i % 10) for i in range(rng.integers(4, 14))]
    root = dressed(model(names, rng, 0.4 * (seed % 3)), rng)
    if seed % 4 == 1 and len(root.children) > 2:
        root = newick.rerooted(root, root.children[0])
    m = int(rng.integers(4, 9))
    held = {str(i): (np.array([rng.integers(m)]), np.array([rng.random() + 0.1])) for i in range(10) if rng.random() < 0.9}
    off = 1 - np.eye(m)
    for got, want in zip(weights.edge_sums(root, held, m, weighting), listed(root, held, m, weighting)):
        assert np.allclose(got * off, want)
    if len(set(names)) == len(names):
        assert np.isclose(weights.total_weight(root, weighting), sum(q[-1] for q in newick.all_quartets(root, weighting)))


def test_weighted_sums_of_a_large_tree():
    rng = np.random.default_rng(1)
    root = dressed(newick.random_tree([str(i) for i in range(500)], rng), rng)
    began = time.time()
    good, bad = weights.edge_sums(root, {str(i): (np.array([i]), np.ones(1)) for i in range(500)}, 500)
    assert time.time() - began < 30 and np.allclose(good, good.T) and np.isclose(good.sum(), 2 * bad.sum())


@pytest.mark.parametrize("weighting", ["l", "s", "h"])
def test_weighted_frequencies_agree_with_listed_quartets(spark, weighting):
    rng = np.random.default_rng(6)
    names = list("abcdefghi")
    tree = newick.parse(newick.write(newick.rooted_at(model(names, rng), ["a"]), lengths=False))
    rows = [(i, newick.write(dressed(model(rng.permutation(names)[: rng.integers(4, 10)].tolist(), rng, 0.3), rng), form="{!r}")) for i in range(12)]
    df = spark.createDataFrame(rows, "tree_id long, newick string").repartition(3)
    want = support.gene_tree_frequencies(trees.gene_tree_quartets(df, weighting), _table(spark, tree), True).toPandas().set_index("branch").sort_index()
    got = genetrees.frequencies(df, tree, weighting=weighting).toPandas().set_index("branch").sort_index()
    assert (got.index == want.index).all() and np.allclose(got, want) and got.to_numpy().sum() > 0
    one = {r["tree_id"]: r["weight"] for r in genetrees.total_weights(df, weighting).collect()}
    assert all(np.isclose(one[i], sum(q[-1] for q in newick.all_quartets(newick.parse(t), weighting))) for i, t in rows)
    with pytest.raises(ValueError, match="weighting"):
        genetrees.tree_graph(df, weighting="x")


def test_species_tree_from_weighted_gene_trees(spark):
    """Wrong clades of little support weigh little: what unweighted trees get wrong, weighted ones get right."""
    rng = np.random.default_rng(9)
    names = [f"s{i}" for i in range(10)]
    tree, other = model(names, rng), model(names, rng)
    rows = []
    for i in range(30):
        t = (tree if i % 3 == 0 else other).copy()
        for x in t.walk():
            x.support = (0.95 if i % 3 == 0 else 0.02) if x.children else None
        rows.append((i, newick.write(t)))
    df = spark.createDataFrame(rows, "tree_id long, newick string")
    assert newick.splits(assemble_gene_trees(df, "n0", weighting="s")) == newick.splits(tree)
    assert newick.splits(assemble_gene_trees(df, "n0")) == newick.splits(other)
