"""Trees whose arrays don't fit: keys, polytomies and closures from joins."""

import pytest
from pyspark.sql import functions as F

from quadrille.operators import ancestry, trees

KIND = "node_id long, parent_id long, name string, is_leaf boolean"


def wide(spark, leaves, moved=False):
    """Ten nodes of many leaves each below three nodes; moved puts the first one elsewhere."""
    inner = [(0, None, "root", False), *((k, 0, f"r{k}", False) for k in (1, 2, 3)), *((10 + k, 1 + (k + (moved and k == 0)) % 3, f"n{k}", False) for k in range(10))]
    below = spark.range(leaves).select((F.col("id") + 100).alias("node_id"), (F.col("id") % 10 + 10).alias("parent_id"), F.concat(F.lit("c"), "id").alias("name"), F.lit(True).alias("is_leaf"))
    return spark.createDataFrame(inner, KIND).union(below)


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_keys_of_more_leaves_than_a_sum_holds(spark, monkeypatch):
    """Sums of 48 bits over 120 000 leaves pass 63 bits."""
    one, two = wide(spark, 120_000), wide(spark, 120_000, True)
    want, distance = rows(trees.split_keys(one)), rows(trees.rf(one, two))
    monkeypatch.setattr(ancestry, "MOST_NODES", 1000)
    assert rows(trees.split_keys(one)) == want and len(want) == 13
    assert rows(trees.rf(one, two)) == distance and distance[0][:3] == ("2", "2", "11")


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_polytomies_by_joins(spark, monkeypatch, few):
    """The same as from arrays; what has more than FEW rows goes to no task whole, however small its files are."""
    monkeypatch.setattr(trees, "FEW", few, raising=False)
    table = wide(spark, 500)
    want, keys, every = rows(trees.polytomies(table)), rows(trees.split_keys(table)), rows(trees.bipartitions(table).selectExpr("node_id", "n", "side"))
    monkeypatch.setattr(ancestry, "MOST_NODES", 5)
    got = trees.polytomies(table)
    assert rows(got) == want and len(want) == 523 and rows(trees.split_keys(table)) == keys
    assert rows(trees.bipartitions(table).selectExpr("node_id", "cast(n as long) n", "side")) == every
    if not few:
        for df in (got, trees.closure(table), trees.leaf_closure(table)):
            assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()


def test_closure_of_mixed_nodes(spark):
    """A node marked as a leaf that has children, an inner node without any, a chain."""
    table = spark.createDataFrame([(0, None, "r", False), (1, 0, "a", True), (2, 1, "b", True), (3, 0, "e", False), (4, 2, "d", False), (5, 4, "f", True)], KIND)
    up = {0: [0], 1: [1, 0], 2: [2, 1, 0], 3: [3, 0], 4: [4, 2, 1, 0], 5: [5, 4, 2, 1, 0]}
    names = {1: "a", 2: "b", 5: "f"}
    assert rows(trees.closure(table)) == sorted((str(a), str(x), str(d)) for x, path in up.items() for d, a in enumerate(path))
    want = sorted((str(a), names[x], str(d)) for x, path in up.items() if x in names for d, a in enumerate(path))
    assert rows(trees.leaf_closure(table)) == want == rows(trees.leaf_closure(table, trees.closure(table)))
