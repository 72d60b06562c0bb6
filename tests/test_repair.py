"""Polytomies resolved at once, designs of many taxa, readers and scorers that had no test."""

import json
import time

import numpy as np
import pandas as pd
import pytest

from quadrille.operators import design, scorers, trees
from quadrille.plans import infer, newick
from quadrille.sources import quartets


def sequences(spark, tree, rng, n=4000):
    """Sites that follow the splits of a tree: one side has one base, the other another."""
    names = sorted((x.name for x in tree.leaves()), key=int)
    sides = [frozenset(min(pair, key=lambda s: (len(s), sorted(s)))) for pair in sorted(newick.splits(tree), key=str)]
    draw = rng.integers(0, len(sides), n)
    base = np.array([[rng.permutation(4)[:2]] for _ in range(n)])[:, 0]
    rows = [(int(t), p, int(base[p, int(t in sides[draw[p]])])) for t in names for p in range(n)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["taxon", "pos", "state"]))


def test_ten_polytomies_in_as_many_jobs_as_two(spark):
    """Every polytomy becomes what the sequences say, and more of them take no more jobs."""
    rng = np.random.default_rng(0)
    jobs = {}
    for wide in (2, 10):
        # A caterpillar of clades, each of five leaves and a way on.
        text, k = "", 0
        for _ in range(wide):
            inner = f"(({k},{k + 1}),(({k + 2},{k + 3}),{k + 4}))"
            k += 5
            text = f"({inner},{text})" if text else inner
        model = newick.parse(text + ";")
        site_rows = sequences(spark, model, rng, 1500)
        stars, at = "", 0
        for _ in range(wide):
            leaves = ",".join(str(at + j) for j in range(5))
            at += 5
            stars = f"({leaves},{stars})" if stars else f"({leaves})"
        tree = newick.parse(stars + ";")
        spark.sparkContext.setJobGroup(f"wide-{wide}", "repair")
        found, added = infer.repaired(tree, site_rows)
        jobs[wide] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"wide-{wide}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert newick.splits(found) == newick.splits(model) and len(added) >= 1
    assert jobs[10] <= jobs[2]


def test_what_no_quartet_resolves_stays(spark):
    """Sequences of gaps give each quartet the same weights, and the tree still has all leaves."""
    rows = spark.createDataFrame([(t, p, 4) for t in range(7) for p in range(5)], "taxon long, pos long, state int")
    tree, _ = infer.repaired(newick.parse("(0,1,2,(3,4,5,6));"), rows)
    assert sorted(x.name for x in tree.leaves()) == list("0123456")


def test_design_of_many_taxa():
    began = time.time()
    n, blocks = 300, 2000
    rows = design.pair_balanced(n, blocks)
    pairs = np.zeros((n, n), int)
    for b in rows:
        pairs[np.ix_(b, b)] += 1
    upper = pairs[np.triu_indices(n, 1)]
    used = np.bincount(rows.ravel(), minlength=n)
    assert time.time() - began < 30 and upper.min() >= upper.mean() - 4 and upper.max() <= upper.mean() + 6 and used.max() - used.min() <= 3


def test_design_quartets_and_noise(spark):
    q = design.design_quartets(spark, 30, 12_000)
    assert q.count() == 2 * 10_626 and q.select("block_id").distinct().count() == 2 and q.filter("q0 >= q1 or q1 >= q2 or q2 >= q3").count() == 0
    s = q.selectExpr("q0 a", "q1 b", "q2 c", "q3 d", "1 w").filter("block_id = 0").drop("block_id")
    same, half, none = (design.noisy(s, c).filter("a < b and b < c and c < d").count() for c in (1.0, 0.5, 0.0))
    assert same == 10_626 and none == 0 and 4800 < half < 5800
    changed = design.noisy(s, 0.0)
    assert changed.filter("array_sort(array(a, b, c, d)) = array(a, c, b, d) or array_sort(array(a, b, c, d)) = array(a, c, d, b)").count() == 10_626


def test_read_gene_trees(spark, tmp_path):
    (tmp_path / "g.tre").write_text("((a,b),(c,d));\n\nno tree\n(a,b,c);\n((x,b),(c,(d,e)));\n")
    rows = trees.read_gene_trees(spark, f"file://{tmp_path}/g.tre", {"x": "a"})
    leaves = {r["tree_id"]: sorted(r["n"]) for r in rows.filter("is_leaf").groupBy("tree_id").agg({"name": "collect_list"}).withColumnRenamed("collect_list(name)", "n").collect()}
    assert sorted(leaves.values()) == [list("abcd"), list("abcde")]


def test_outgroups(spark, tmp_path):
    (tmp_path / "o.txt").write_text("a b\nc\n\n")
    assert quartets.outgroups(spark, f"file://{tmp_path}/o.txt") == ["a", "b", "c"] and quartets.outgroups(spark, "x,y, z") == ["x", "y", "z"]


def test_load_weights(spark, tmp_path):
    rng = np.random.default_rng(0)
    given = {"a.w": rng.normal(size=(3, 2)), "a.b": rng.normal(size=2)}
    np.savez(tmp_path / "w.npz", **given)
    found = scorers.load_weights(spark, f"file://{tmp_path}/w.npz")
    assert found.keys() == given.keys() and all(np.array_equal(found[k], v) for k, v in given.items())
    np.savez(tmp_path / "p.npz", x=np.array([{"a": 1}], object))
    with pytest.raises(ValueError, match="allow_pickle"):
        scorers.load_weights(spark, f"file://{tmp_path}/p.npz")


def test_options_of_scorers():
    """An option before which a scorer's name stands is taken where options of a run stand beside it, and nowhere else."""
    config = lambda **kw: quartets.Config.from_jsonc(json.dumps(kw)).top1_only
    assert config(run={"net_top1_only": True, "infer_batch_size": 4})
    assert not config(other={"net_top1_only": True}) and not config(net_top1_only=True) and config(top1_only=True)
    assert not config(run={"net_top1_only": True, "also_top1_only": False, "k_param": 3.0})
