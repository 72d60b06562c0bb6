"""Trees, assembly, and tests on branches."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.functions import statistics
from quadrille.operators import blobs, design, graph, splits, support, trees
from quadrille.plans import newick
from quadrille.plans.assemble import assemble, solved
from quadrille.plans.infer import _table


def model(n, seed):
    return newick.random_tree([str(i) for i in range(n)], np.random.default_rng(seed))


def numbered(tree):
    return np.array([[int(x) for x in q[:4]] for q in newick.all_quartets(tree)])


@given(st.integers(4, 14), st.integers(0, 10_000))
@settings(max_examples=25, deadline=None)
def test_newick_round_trip(n, seed):
    tree = model(n, seed)
    assert newick.rf_distance(newick.parse(newick.write(tree)), tree) == 0


@pytest.mark.parametrize("method", ["qfm", "qmc"])
@pytest.mark.parametrize("seed", range(4))
def test_recovery(method, seed):
    """All quartets of a model tree give it back."""
    tree = model(12, seed)
    q = numbered(tree)
    assert newick.rf_distance(newick.unrooted(solved(list(range(12)), q, np.ones(len(q)), method)), tree) == 0


def test_noise_costs_accuracy():
    def distance(correct):
        out = []
        for seed in range(3):
            tree, rng = model(14, seed), np.random.default_rng(seed)
            q = numbered(tree)
            wrong = rng.random(len(q)) >= correct
            q[wrong] = q[wrong][:, [0, 2, 1, 3]]
            out.append(newick.rf_distance(solved(list(range(14)), q, np.ones(len(q))), tree))
        return np.mean(out)

    assert distance(1.0) == 0 and distance(1.0) <= distance(0.8) <= distance(0.4)


@pytest.mark.parametrize("method", ["qfm", "qmc"])
def test_levels_agree_with_one_task(spark, method):
    """Division by joins, level by level, gives the tree as well."""
    tree = model(10, 3)
    q = pd.DataFrame(numbered(tree), columns=list("abcd")).assign(w=1)
    for local in (10, 100_000):
        assert newick.rf_distance(assemble(spark.createDataFrame(q), method, local=local), tree) == 0


def test_bipartition_ignores_order():
    tree = model(11, 5)
    q = numbered(tree)
    w = np.arange(len(q)) % 7 + 1.0
    side = graph.fm_bipartition(q, w, 11)
    p = np.random.default_rng(1).permutation(len(q))
    assert (graph.fm_bipartition(q[p], w[p], 11) == side).all()


def test_reroot_keeps_splits():
    tree = model(9, 2)
    for leaf in "0378":
        t = newick.rooted_at(tree.copy(), [leaf])
        assert newick.rf_distance(t, tree) == 0 and any(c.name == leaf for c in t.children)


def test_polytomy_refined():
    star = newick.parse("(a,b,c,d,e,f);")
    t = newick.refined(star, np.random.default_rng(0))
    assert max(newick.unrooted_degree(x) for x in t.walk()) == 3 and sorted(x.name for x in t.leaves()) == list("abcdef")


def test_malformed_newick():
    for bad in ("((a,b);", "(a,b));", "a,b;"):
        with pytest.raises(ValueError):
            newick.parse(bad)


def test_weighted_quartets():
    t = newick.parse("((a:1,b:1)0.5:1,(c:1,d:1)0.5:1);")
    (row,) = newick.all_quartets(t, "h")
    assert row[:4] == ("a", "b", "c", "d") and row[4] == pytest.approx(math.exp(-4) * 0.75)
    assert newick.all_quartets(t, "s")[0][4] == pytest.approx(0.75) and newick.all_quartets(t, "l")[0][4] == pytest.approx(math.exp(-4))


def test_rf_tables_agree_with_memory(spark):
    one, two = model(12, 1), model(12, 2)
    got = trees.rf(_table(spark, one), _table(spark, two)).first()
    x, y = newick.splits(one), newick.splits(two)
    assert (got["only_1"], got["only_2"], got["shared"]) == (len(x - y), len(y - x), len(x & y))


def test_contracted(spark):
    table = _table(spark, newick.parse("((a,b),((c,d),e));"))
    inner = [r["node_id"] for r in table.filter("not is_leaf and parent_id is not null").collect()]
    out = trees.contracted(table, spark.createDataFrame([(i,) for i in inner], "node_id long"))
    assert sorted(r["name"] for r in out.filter("parent_id = 0").collect()) == list("abcde")


def test_support_of_own_quartets(spark):
    """All quartets of a tree support all of its branches."""
    tree = model(9, 4)
    binary = newick.parse(newick.write(newick.rooted_at(tree.copy(), ["0"]), lengths=False))
    table = _table(spark, binary)
    quads = support.quadripartitions(table)
    rows = pd.DataFrame(newick.all_quartets(tree), columns=[*"abcdw"])
    got = support.support(support.frequencies(spark.createDataFrame(rows), table)).toPandas()
    assert (got.q1 == 1).all() and (got.brlen == 9).all() and len(got) == 9 - 3


def test_gene_trees_vote_once(spark):
    tree = "((a,b),(c,(d,e)));"
    table = _table(spark, newick.parse(tree))
    quads = support.quadripartitions(table)
    q = trees.gene_tree_quartets(spark.createDataFrame([(1, tree), (2, tree)], "tree_id long, newick string"))
    got = support.gene_tree_frequencies(q, table).toPandas()
    assert (got.f1 == 2).all()
    p = support.partitioned_support(q, table, got.branch[0]).toPandas()
    assert (p.f_xyzw == 0).all() and (p.totalf == p.f_xy_zw).all()


def test_star_and_tree_p_values(spark):
    c = spark.createDataFrame([(69, 80, 21), (225, 5, 0), (145, 82, 37), (0, 0, 0)], "n0 int, n1 int, n2 int")
    got = blobs.with_p(c).toPandas()
    assert got.p_star[0] == pytest.approx(2.85792e-08, rel=1e-5) and got.p_star[1] == pytest.approx(3.055403874155e-94, rel=1e-9) and got.p_star[3] == -1
    assert got.p_tree[2] == pytest.approx(2.953462e-05, rel=1e-4) and got.p_tree[3] == 1


def test_tree_test_is_uniform_under_the_model():
    """p-values below 0.05 come up in about a twentieth of draws, near the star point and far from it."""
    rng = np.random.default_rng(0)
    for top in (0.36, 0.5, 0.8):
        counts = rng.multinomial(300, [top, (1 - top) / 2, (1 - top) / 2], 600)
        assert 0.02 <= (statistics.tree_test_p(counts) < 0.05).mean() <= 0.085


def test_lambert_w():
    x = np.array([-0.3, 0, 0.5, 1, 50])
    w = statistics.lambert_w(x)
    assert np.allclose(w * np.exp(w), x)


def test_quartet_searches(spark):
    tree = newick.parse("((a,b),((c,d),(e,f)));")
    table = _table(spark, tree)
    quads = support.quadripartitions(table)
    rng = np.random.default_rng(3)
    rows = [(*q, *(int(x) for x in rng.integers(1, 90, 3))) for q in itertools.combinations("abcdef", 4)]
    c = blobs.with_p(spark.createDataFrame(rows, "q0 string, q1 string, q2 string, q3 string, n0 int, n1 int, n2 int"))
    wide, four = blobs.searched(c, quads).toPandas().set_index("branch"), blobs.searched(c, quads, True).toPandas().set_index("branch")
    near = blobs.searched_3f1a(c, quads).toPandas().set_index("branch")
    assert (wide.p_tree.loc[four.index] <= four.p_tree).all() and (four.p_tree <= near.p_tree.loc[four.index]).all()


def test_block_design():
    blocks = design.pair_balanced(30, 40, 24)
    pairs = np.zeros((30, 30), int)
    for b in blocks:
        assert len(set(b)) == 24
        pairs[np.ix_(b, b)] += 1
    upper = pairs[np.triu_indices(30, 1)]
    assert upper.min() >= 1 and upper.max() - upper.min() <= 4
    assert [design.block_count(n, 3) for n in (24, 48, 96, 192)] == [1, 11, 84, 667]


@given(st.integers(4, 12), st.data())
@settings(max_examples=20, deadline=None)
def test_unranked(n, data):
    r = data.draw(st.integers(0, math.comb(n, 4) - 1))
    assert tuple(design.unranked([r], n)[0]) == list(itertools.combinations(range(n), 4))[r]


def test_sampled_quartets(spark):
    assert design.sampled_quartets(spark, 8, 0).distinct().count() == 70
    some = design.sampled_quartets(spark, 60, 500).toPandas()
    assert len(some.drop_duplicates()) == 500 and (some.q0 < some.q1).all() and (some.q2 < some.q3).all()


def test_batches_merge_in_any_order(spark):
    w = spark.createDataFrame([(b, 0, 1, 2, 3, float(b), 1.0, 2.0) for b in range(4)], "block_id long, q0 int, q1 int, q2 int, q3 int, w0 double, w1 double, w2 double")
    whole = splits.aggregated(w, "full").collect()
    parts = splits.aggregated(w, "batch_only")
    assert splits.merged(parts.repartition(3)).collect() == whole
