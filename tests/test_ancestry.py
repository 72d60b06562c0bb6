"""Ancestors, topologies and branches from arrays, against paths, distances and sets of leaves."""

import itertools
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from quadrille.operators import ancestry, support, trees
from quadrille.operators.ancestry import Ancestry, Branches
from quadrille.plans import newick
from quadrille.plans.infer import _table


def arrays(tree):
    return Ancestry(*map(list, zip(*((r[0], r[1], r[2], r[-1]) for r in newick.nodes(tree)))))


def shaped(seed, kind):
    """A random tree with three children at the root, with two, or with wide nodes."""
    rng = np.random.default_rng(seed)
    t = newick.random_tree([f"t{i}" for i in range(int(rng.integers(4, 13)))], rng)
    if kind == "rooted":
        return newick.rerooted(t, list(t.walk())[int(rng.integers(0, 5))])
    if kind == "wide":
        for x in list(t.walk()):
            if x.children and x.parent is not None and rng.random() < 0.4:
                x.parent.children.remove(x)
                for c in x.children:
                    x.parent.add(c)
    return t


@pytest.mark.parametrize("kind", ["unrooted", "rooted", "wide"])
@pytest.mark.parametrize("seed", range(6))
def test_ancestors_and_topologies(kind, seed):
    t = shaped(seed, kind)
    a = arrays(t)
    path = [{x} for x in range(len(a.parent))]
    for x in range(1, len(path)):
        path[x] |= path[a.parent[x]]
    x, y = np.meshgrid(range(len(path)), range(len(path)))
    assert a.lca(x.ravel(), y.ravel()).tolist() == [max(path[i] & path[j]) for i, j in zip(x.ravel(), y.ravel())]
    assert a.below(x.ravel(), y.ravel()).tolist() == [j in path[i] for i, j in zip(x.ravel(), y.ravel())]
    names, d = newick.distances(t)
    q = np.array(list(itertools.combinations(range(len(names)), 4)))
    assert (a.topologies(a.numbers(pa.array(names))[q])[0] == newick.topology(d, q)).all()
    assert a.numbers(pa.array(["t1", "none", None])).tolist()[1:] == [-1, -1]


@pytest.mark.parametrize("kind", ["unrooted", "rooted"])
@pytest.mark.parametrize("seed", range(6))
def test_quartets_around_branches(kind, seed):
    """Parts of a branch, from the bipartitions at its two ends: a quartet is around it if it has a leaf in each."""
    t = shaped(seed, kind)
    b = Branches(arrays(t))
    names = b.tree.names.to_pylist()
    every = frozenset(names)
    inner = {next(s for s in pair if min(names) not in s) for pair in newick.splits(t)}
    codes = b.codes()
    found = {frozenset(n for n, c in zip(names, row) if c <= 2) for row in codes}
    assert {s if min(names) not in s else every - s for s in found} == inner and len(codes) == len(inner)
    for row in codes:
        parts = [frozenset(n for n, c in zip(names, row) if c == k) for k in (1, 2, 4, 8)]
        # Each part is one leaf, or one side of another branch.
        assert all(len(p) == 1 or (p if min(names) not in p else every - p) in inner for p in parts)
    q = np.array(list(itertools.permutations(range(len(names)), 4)))[:: 1 + seed % 3]
    at, k = b.around(b.tree.leaves[q])
    four = codes[:, q]
    hits = np.bitwise_or.reduce(four, 2) == 15
    assert (hits.sum(0) == (at >= 0)).all()
    rows = np.flatnonzero(at >= 0)
    place = np.searchsorted(b.places, at[rows])
    assert hits[place, rows].all()
    pair = four[place, rows][:, :2].sum(1)
    assert (k[rows] == np.select([np.isin(pair, (3, 12)), np.isin(pair, (5, 10))], (0, 1), 2)).all()


def test_odd_trees(spark):
    with pytest.raises(ValueError, match="roots"):
        Ancestry([1, 2], [None, None], ["a", "b"], [True, True])
    with pytest.raises(ValueError, match="not binary"):
        Branches(arrays(newick.parse("((a,b,c),(d,e));")))
    one = arrays(newick.parse("a;"))
    assert one.lca(np.array([0]), np.array([0])).tolist() == [0] and one.numbers(pa.array(["a"])).tolist() == [0]
    table = _table(spark, newick.parse("((a,b),(c,(d,e)));"))
    q = spark.createDataFrame([("a", "b", "c", "d", 2.0), ("a", "x", "c", "d", 9.0)], "a string, b string, c string, d string, w double")
    assert {r["branch"]: r["f1"] for r in support.frequencies(q, table).collect() if r["f1"]} == {r["node_id"]: 2.0 for r in table.filter("node_id = 1").collect()}


def test_large_trees_go_by_paths(spark, monkeypatch):
    t = shaped(3, "wide")
    table = _table(spark, t)
    names = sorted(x.name for x in t.leaves())
    q = spark.createDataFrame([tuple(c) for c in itertools.combinations(names, 4)], "q0 string, q1 string, q2 string, q3 string")
    one = trees.topologies(q, table).collect()
    monkeypatch.setattr(ancestry, "MOST_NODES", 3)
    assert sorted(map(tuple, trees.topologies(q, table).collect())) == sorted(map(tuple, one))
    with pytest.raises(ValueError, match="more than 3 nodes"):
        support.frequencies(q, table)


def test_sample_of_names(spark):
    names = spark.createDataFrame([(f"n{i:03d}",) for i in range(60)], "name string")
    some = trees.sampled(names, 500).toPandas()
    assert 350 < len(some) <= 500 and (some.q0 < some.q1).all() and (some.q1 < some.q2).all() and (some.q2 < some.q3).all() and not some.duplicated().any()
    assert sorted(map(tuple, trees.sampled(names, 500).collect())) == sorted(map(tuple, some.to_numpy())) and trees.sampled(names.limit(6), 500).count() == 15


def test_support_of_many_quartets(spark):
    """500 taxa and 250 000 splits."""
    rng = np.random.default_rng(0)
    t = newick.random_tree([str(i) for i in range(500)], rng)
    q = np.array([rng.choice(500, 4, replace=False) for _ in range(2500)])
    q = np.concatenate([(q + k) % 500 for k in range(100)])
    rows = spark.createDataFrame(pd.DataFrame(q, columns=[*"abcd"]).assign(w=1.0))
    table = _table(spark, t)
    began = time.time()
    got = support.frequencies(rows, table).toPandas()
    took = time.time() - began
    b = Branches(arrays(t))
    at, k = b.around(b.tree.numbers(pa.array(q.ravel().astype(str))).reshape(-1, 4))
    assert len(got) == 497 and got[["f1", "f2", "f3"]].sum().tolist() == [float(((at >= 0) & (k == j)).sum()) for j in range(3)] and took < 30


@pytest.mark.parametrize("kind", ["unrooted", "rooted", "wide"])
def test_runs_of_leaves_agree_with_paths(spark, kind):
    """Polytomies, bipartitions and their keys, from arrays and from joins."""
    for seed in range(2):
        table = _table(spark, shaped(seed, kind))
        down = trees.leaf_closure(table)
        rows = lambda df: sorted((tuple(map(str, r)) for r in df.collect()))
        assert rows(trees.polytomies(table)) == rows(trees.polytomies(table, down))
        assert rows(trees.bipartitions(table).selectExpr("node_id", "n", "side")) == rows(trees.bipartitions(table, down).selectExpr("node_id", "cast(n as long) n", "side"))
        assert rows(trees.split_keys(table)) == rows(trees.split_keys(table, down))


def test_refined_gene_trees(spark):
    df = spark.createDataFrame([(1, "(a,b,c,d,(e,f,g)0.5);"), (2, "(a,b,c,d,(e,f,g)0.5);"), (3, None), (4, "")], "tree_id long, newick string")
    got = {r["tree_id"]: r["newick"] for r in trees.refined_gene_trees(df, 7).collect()}
    assert got == {r["tree_id"]: r["newick"] for r in trees.refined_gene_trees(df.repartition(3), 7).collect()} and got[3] is None and got[4] == ""
    for i in (1, 2):
        t = newick.parse(got[i])
        assert sorted(x.name for x in t.leaves()) == list("abcdefg") and len(newick.splits(t)) == 4 and newick.splits(newick.parse("(a,b,c,d,(e,f,g));")) <= newick.splits(t)
