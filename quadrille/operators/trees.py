"""Trees as tables: (node_id, parent_id, name, is_leaf), and what joins and aggregates say about them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import canonical
from ..plans import newick
from ..sources.tables import written
from . import ancestry

#: Rows of a table that a join may send to every task.
FEW = 1 << 16
NODES = "tree_id long, node_id long, parent_id long, name string, support double, length double, is_leaf boolean"


def parsed(trees: DataFrame, rename: dict[str, str] | None = None, least_leaves: int = 0) -> DataFrame:
    """(tree_id, newick) -> NODES. Trees with least_leaves leaves or fewer are left out."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree_id, text in zip(batch.column("tree_id").to_pylist(), batch.column("newick").to_pylist()):
                root = newick.parse(text, rename)
                if len(root.leaves()) > least_leaves:
                    rows += [(tree_id, *n) for n in newick.nodes(root)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([],) * 7, kinds)], [x.split()[0] for x in NODES.split(", ")])

    return trees.select(F.col("tree_id").cast("long").alias("tree_id"), "newick").mapInArrow(parse, NODES)


def read_gene_trees(spark, path: str, rename: dict[str, str] | None = None) -> DataFrame:
    """NODES of the lines that hold a tree of four leaves or more."""
    lines = spark.read.text(path).filter(F.col("value").contains(";"))
    return parsed(lines.select(F.monotonically_increasing_id().alias("tree_id"), F.col("value").alias("newick")), rename, 3)


def _few(table: DataFrame) -> DataFrame:
    """A table for a join: to every task if it has few rows, which is counted, not guessed from its files; else both sides are shuffled."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table.hint("merge")


def _paths(tree: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with children, the other nodes, closure of the former). Paths double in each round, so a tree of depth d takes log d joins."""
    heads = _few(written(tree.filter("parent_id is not null").select(F.col("parent_id").alias("_h")).distinct(), "closure-heads"))
    inner, outer = (tree.join(heads, F.col("node_id") == F.col("_h"), how) for how in ("left_semi", "left_anti"))
    inner = written(inner, "closure-inner")
    reach = written(inner.select("node_id", F.col("node_id").alias("anc"), F.lit(0).alias("dist")), "closure")
    jump = written(inner.filter("parent_id is not null").select("node_id", F.col("parent_id").alias("anc"), F.lit(1).alias("dist")), "closure-jump")
    step = 1
    while step <= max_depth and not jump.isEmpty():
        # reach: all ancestors at a distance below step; jump: the one at exactly step.
        up = _few(reach.select(F.col("node_id").alias("_m"), F.col("anc").alias("_a"), F.col("dist").alias("_d")))
        far = jump.join(up, F.col("anc") == F.col("_m")).select("node_id", F.col("_a").alias("anc"), (F.col("_d") + step).alias("dist"))
        reach = written(reach.union(far), "closure")
        other = _few(jump.select(F.col("node_id").alias("_m"), F.col("anc").alias("_a")))
        jump = written(jump.join(other, F.col("anc") == F.col("_m")).select("node_id", F.col("_a").alias("anc"), F.lit(2 * step).alias("dist")), "closure-jump")
        step *= 2
    return inner, outer, reach


def _under(outer: DataFrame, reach: DataFrame, *keep) -> DataFrame:
    """Nodes without children under each of their ancestors, and themselves."""
    above = _few(reach.select(F.col("node_id").alias("_m"), "anc", F.col("dist").alias("_d")))
    far = outer.join(above, F.col("parent_id") == F.col("_m")).select("anc", *keep, (F.col("_d") + 1).alias("dist"))
    return outer.select(F.col("node_id").alias("anc"), *keep, F.lit(0).alias("dist")).union(far)


def closure(tree: DataFrame, max_depth: int = 1 << 20) -> DataFrame:
    """(anc, node_id, dist): every node under each of its ancestors, and itself.

    Paths are made of nodes with children only; the others, most of a wide tree, take their parent's in one join.
    """
    _, outer, reach = _paths(tree, max_depth)
    return reach.select("anc", "node_id", "dist").union(_under(outer, reach, "node_id"))


def leaf_closure(tree: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(anc, leaf, dist): every leaf under each of its ancestors."""
    leaves = tree.filter("is_leaf").select("node_id", F.col("name").alias("leaf"))
    if reach is not None:
        return reach.join(leaves.hint("merge"), "node_id").select("anc", "leaf", "dist")
    inner, outer, reach = _paths(tree, 1 << 20)
    named = reach.join(inner.filter("is_leaf").select("node_id", F.col("name").alias("leaf")).hint("merge"), "node_id").select("anc", "leaf", "dist")
    return named.union(_under(outer.filter("is_leaf"), reach, F.col("name").alias("leaf")))


def _added(inner: DataFrame, outer: DataFrame, reach: DataFrame, **columns) -> DataFrame:
    """(anc, k, least, *columns): of the leaves below each node with children the number, the least name and sums of columns of `leaf`.

    Leaves are added up by parent before they meet its paths.
    """
    held = outer.filter("is_leaf").select(F.col("parent_id").alias("_m"), F.col("name").alias("leaf")).union(inner.filter("is_leaf").select("node_id", "name"))
    each = held.groupBy("_m").agg(F.count("*").alias("k"), F.min("leaf").alias("least"), *(F.sum(x).alias(c) for c, x in columns.items()))
    met = reach.join(_few(written(each, "leaf-sums")), F.col("node_id") == F.col("_m"))
    return met.groupBy("anc").agg(F.sum("k").alias("k"), F.min("least").alias("least"), *(F.sum(c).alias(c) for c in columns))


def polytomies(tree: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """(node_id, degree, direction, rep): nodes of unrooted degree over 3, with the least leaf name of each direction.

    direction is the child's id; null stands for what lies beyond the parent. From runs of leaves, for a tree whose arrays fit; else from joins of its paths.
    """
    kind = tree.schema["node_id"].dataType.simpleString()
    if leaves is None and (found := ancestry.held(tree)):
        return tree.sparkSession.createDataFrame(ancestry.polytomies(found), f"node_id {kind}, degree long, direction {kind}, rep string")
    inner, outer, reach = _paths(tree, 1 << 20)
    if leaves is None:
        least = _added(inner, outer, reach).select("anc", "least").union(outer.filter("is_leaf").select("node_id", "name"))
    else:
        least = leaves.groupBy("anc").agg(F.min("leaf").alias("least"))
    kids = tree.filter("parent_id is not null").select(F.col("parent_id").alias("p"), F.col("node_id").alias("c"))
    count = _few(written(kids.groupBy(F.col("p").alias("node_id")).count(), "kids-count"))
    up = F.col("parent_id").isNotNull()
    wide = written(inner.join(count, "node_id").select("node_id", up.alias("_up"), (F.col("count") + up.cast("int")).alias("degree")).filter("degree > 3"), "wide")
    kids = written(kids.join(least.hint("merge"), F.col("c") == F.col("anc")).select("p", "c", "least"), "kids")
    below = kids.join(_few(wide.drop("_up")), F.col("node_id") == F.col("p")).select("node_id", "degree", F.col("c").alias("direction"), F.col("least").alias("rep"))
    # The least leaf beyond the parent is the least of all that isn't below: the first of the ordered leaves at which ranks part.
    above = _least_outside(inner, reach, kids, wide.filter("_up").select("node_id", "degree"))
    return below.unionByName(above.select("node_id", "degree", F.lit(None).cast(tree.schema["node_id"].dataType).alias("direction"), "rep"))


def _least_outside(inner: DataFrame, reach: DataFrame, kids: DataFrame, at: DataFrame) -> DataFrame:
    """The least leaf name not below each node: along the path to the root, the least below any other child."""
    # For each child the least among its siblings: of the parent's two least, the one that isn't the child's own. Paths hold nodes with children only.
    two = _few(written(kids.groupBy("p").agg(F.min(F.struct("least", "c")).alias("one"), F.min_by("c", F.struct("least", "c")).alias("first")), "two-least"))
    second = kids.join(two, "p").filter(F.col("c") != F.col("first")).groupBy("p").agg(F.min("least").alias("second"))
    some = kids.join(_few(inner.select(F.col("node_id").alias("_i"))), F.col("c") == F.col("_i"), "left_semi")
    beside = some.join(two, "p").join(_few(written(second, "second-least")), "p", "left").select(F.col("c").alias("b"), F.when(F.col("c") == F.col("first"), F.col("second")).otherwise(F.col("one")["least"]).alias("beside"))
    path = reach.join(_few(at), "node_id")
    return path.join(beside.hint("merge"), F.col("anc") == F.col("b")).groupBy("node_id", "degree").agg(F.min("beside").alias("rep")).filter("rep is not null")


def bipartitions(tree: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """(node_id, n, side): inner edges by the leaf set on the side without the least leaf of the tree, in order; both sides of two leaves or more.

    From runs of leaves, for a tree whose arrays fit; else from joins of its paths.
    """
    if leaves is None and (found := ancestry.held(tree)):
        return ancestry.bipartitions(tree.sparkSession, found, tree.schema["node_id"].dataType.simpleString())
    down = leaf_closure(tree) if leaves is None else leaves
    total = tree.filter("is_leaf").agg(F.count("*").alias("total"), F.min("name").alias("least"))
    sets = down.groupBy(F.col("anc").alias("node_id")).agg(F.array_sort(F.collect_set("leaf")).alias("s"), F.count("*").alias("k"))
    every = tree.filter("is_leaf").agg(F.array_sort(F.collect_set("name")).alias("all"))
    inner = sets.crossJoin(F.broadcast(total)).filter((F.col("k") >= 2) & (F.col("total") - F.col("k") >= 2))
    flip = F.array_contains("s", F.col("least"))
    return inner.crossJoin(F.broadcast(every)).select("node_id", F.when(flip, F.col("total") - F.col("k")).otherwise(F.col("k")).alias("n"), F.when(flip, F.array_except("all", "s")).otherwise(F.col("s")).alias("side"))


def split_keys(tree: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """(n, h0, h1): distinct bipartitions by size and two sums of leaf hashes, modulo 2^48, of the side without the least leaf, which no set of leaves is collected for."""
    if leaves is None and (found := ancestry.held(tree)):
        hashes = lambda name: [int(hashlib.md5((x + name).encode()).hexdigest()[:12], 16) for x in ("a", "b")]
        return tree.sparkSession.createDataFrame(ancestry.split_keys(found, hashes), "n long, h0 long, h1 long")
    # Hashes of 48 bits, whose sums over more than 32768 leaves are no long numbers any more.
    part = {f"h{i}": F.conv(F.substring(F.md5(F.concat(F.lit(x), F.col("leaf"))), 1, 12), 16, 10).cast("decimal(15,0)") for i, x in enumerate("ab")}
    if leaves is None:
        own = _added(*_paths(tree, 1 << 20), **part)
    else:
        own = leaves.groupBy("anc").agg(F.count("*").alias("k"), F.min("leaf").alias("least"), *(F.sum(x).alias(c) for c, x in part.items()))
    whole = tree.filter("is_leaf").select(F.col("name").alias("leaf")).agg(F.count("*").alias("total"), F.min("leaf").alias("first"), *(F.sum(x).alias(f"t{c}") for c, x in part.items()))
    rows = own.crossJoin(F.broadcast(whole)).filter((F.col("k") >= 2) & (F.col("total") - F.col("k") >= 2))
    flip = F.col("least") == F.col("first")
    pick = lambda a, b: F.when(flip, F.col(b) - F.col(a)).otherwise(F.col(a))
    bits = lambda c: F.pmod(pick(c, f"t{c}"), F.lit(ancestry.KEYS)).cast("long").alias(c)
    return rows.select(pick("k", "total").cast("long").alias("n"), bits("h0"), bits("h1")).distinct()


def rf(one: DataFrame, two: DataFrame) -> DataFrame:
    """(only_1, only_2, shared, rf, fp_rate, fn_rate): bipartitions of two tree tables over the same leaves; tree 2 is the truth."""
    a, b = split_keys(one).withColumn("x", F.lit(1)).withColumn("y", F.lit(0)), split_keys(two).withColumn("x", F.lit(0)).withColumn("y", F.lit(1))
    both = a.unionByName(b).groupBy("n", "h0", "h1").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    s = both.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in ((F.col("x") * (1 - F.col("y")), "only_1"), (F.col("y") * (1 - F.col("x")), "only_2"), (F.col("x") * F.col("y"), "shared"))))
    share = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(0.0))
    n1, n2 = F.col("only_1") + F.col("shared"), F.col("only_2") + F.col("shared")
    return s.select("only_1", "only_2", "shared", share(F.col("only_1") + F.col("only_2"), n1 + n2).alias("rf"), share(F.col("only_1"), n1).alias("fp_rate"), share(F.col("only_2"), n2).alias("fn_rate"))


def topologies(quartet_rows: DataFrame, tree: DataFrame, column: str = "cls") -> DataFrame:
    """(q0..q3 names, ...) with the class a tree shows, -1 where it is unresolved; rows with a name that is no leaf go.

    The class is that of the one pair whose lowest common ancestor is deeper than those of the other pairs, or whose partner pair's is. Ancestors come from
    a tree's arrays in each task; those of a tree too large for that from joins of its paths.
    """
    if found := ancestry.held(tree):
        return ancestry.classes(quartet_rows, found, column)
    return _topologies_by_paths(quartet_rows, leaf_closure(tree), column)


def _topologies_by_paths(quartet_rows: DataFrame, leaves: DataFrame, column: str) -> DataFrame:
    """The same from (anc, leaf, dist): two leaves have as many ancestors in common as their lowest one is deep."""
    depth = leaves.groupBy("leaf").agg(F.max("dist").alias("depth"))
    out = quartet_rows
    pairs = {"01": (0, 1), "02": (0, 2), "03": (0, 3), "12": (1, 2), "13": (1, 3), "23": (2, 3)}
    anc = leaves.join(depth, "leaf").select("leaf", "anc", (F.col("depth") - F.col("dist")).alias("level"))
    sets = anc.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("level", "anc"))).alias("path"))
    for i in range(4):
        out = out.join(sets.select(F.col("leaf").alias("_l"), F.col("path").alias(f"_p{i}")), F.col(f"q{i}") == F.col("_l")).drop("_l")
    shared = {k: F.size(F.array_intersect(f"_p{i}", f"_p{j}")) for k, (i, j) in pairs.items()}
    best = [F.greatest(shared[a], shared[b]) for a, b in (("01", "23"), ("02", "13"), ("03", "12"))]
    top = F.greatest(*best)
    n = sum(((x == top).cast("int") for x in best[1:]), (best[0] == top).cast("int"))
    cls = F.when(n > 1, -1).when(best[0] == top, 0).when(best[1] == top, 1).otherwise(2)
    return out.withColumn(column, cls).drop(*(f"_p{i}" for i in range(4)))


def sampled(names: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(name) -> (q0..q3): quartets of distinct names, drawn by a hash, fewer than `size` where a draw holds a name twice or draws agree; all quartets where there are no more.

    Names are numbered in their order, so draws are the same in each run.
    """
    n = names.count()
    if math.comb(n, 4) <= size:
        out = names.select(F.col("name").alias("q0"))
        for i in (1, 2, 3):
            out = out.join(names.select(F.col("name").alias(f"q{i}")), F.col(f"q{i}") > F.col(f"q{i - 1}"))
        return out
    numbered = ranked(names, "name").select("name", F.col("new").alias("r"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "i", "j")), 1, 8), 16, 10).cast("long") % n
    draws = names.sparkSession.range(size).withColumnRenamed("id", "i").withColumn("j", F.explode(F.array(*map(F.lit, range(4)))))
    four = draws.select("i", draw.alias("r")).distinct().join(numbered, "r").groupBy("i").agg(F.array_sort(F.collect_list("name")).alias("q")).filter(F.size("q") == 4)
    return four.select(*(F.col("q")[k].alias(f"q{k}") for k in range(4))).distinct()


def ranked(values: DataFrame, column: str) -> DataFrame:
    """Distinct values with new, their rank from 0: ranges of the order are numbered each in its task."""
    runs = values.select(column).repartitionByRange(column).withColumn("_run", F.spark_partition_id())
    runs = written(runs, "ranked")
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = runs.groupBy("_run").count().select("_run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_run").orderBy(column)
    return runs.withColumn("_n", F.row_number().over(inside) - 1).join(sizes, "_run").select(column, (F.col("_n") + F.col("_before")).alias("new"))


def _both(quartet_rows: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    return topologies(topologies(quartet_rows, one, "one"), two, "two")


def concordance(quartet_rows: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """(evaluated, matches, concordance) of two trees over quartets of leaf names."""
    same = F.coalesce(F.sum((F.col("one") == F.col("two")).cast("long")), F.lit(0))
    return _both(quartet_rows, one, two).agg(F.count("*").alias("evaluated"), same.alias("matches")).withColumn("concordance", F.col("matches") / F.when(F.col("evaluated") > 0, F.col("evaluated")))


def total_weight(splits: DataFrame, tree: DataFrame) -> DataFrame:
    """(shown, total): the weight of the splits that a tree shows, and of all."""
    rows = splits.select(*(F.col(x).cast("string").alias(f"q{i}") for i, x in enumerate("abcd")), "w")
    found = topologies(rows, tree)
    return found.agg(F.coalesce(F.sum(F.when(F.col("cls") == 0, F.col("w"))), F.lit(0)).alias("shown"), F.coalesce(F.sum("w"), F.lit(0)).alias("total"))


def mismatches(quartet_rows: DataFrame, one: DataFrame, two: DataFrame, n: int) -> DataFrame:
    """(q0..q3, one, two): the first n quartets, in order of names, that two trees show as different classes."""
    names = [c for c in quartet_rows.columns if c.startswith("q")]
    return _both(quartet_rows, one, two).filter("one <> two").select(*names, "one", "two").orderBy(*names).limit(n)


def refined_gene_trees(trees: DataFrame, seed: int = 0, low: float = 0.0, rename: dict[str, str] | None = None) -> DataFrame:
    """(tree_id, newick) -> (tree_id, newick): gene trees with nodes of many children resolved at random, by seed and tree_id; the nodes made have the least support."""

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for tree_id, text in zip(batch.column("tree_id").to_pylist(), batch.column("newick").to_pylist()):
                rng = np.random.default_rng([seed, (tree_id or 0) % (1 << 64)])
                done.append(newick.write(newick.refined(newick.parse(text, rename), rng, low)) if text else text)
            yield pa.RecordBatch.from_arrays([batch.column("tree_id"), pa.array(done, pa.string())], ["tree_id", "newick"])

    return trees.select(F.col("tree_id").cast("long").alias("tree_id"), "newick").mapInArrow(refine, "tree_id long, newick string")


def gene_tree_quartets(trees: DataFrame, weighting: str = "n") -> DataFrame:
    """(tree_id, newick) -> (tree_id, a, b, c, d, w): the resolved quartets of each tree."""

    def list_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree_id, text in zip(batch.column("tree_id").to_pylist(), batch.column("newick").to_pylist()):
                rows = newick.all_quartets(newick.parse(text), weighting)
                if rows:
                    cols = dict(zip("abcdw", zip(*rows)))
                    yield pa.RecordBatch.from_pydict({"tree_id": pa.array([tree_id] * len(rows), pa.int64())} | {k: pa.array(v, pa.float64() if k == "w" else pa.string()) for k, v in cols.items()})

    return trees.select(F.col("tree_id").cast("long").alias("tree_id"), "newick").mapInArrow(list_all, "tree_id long, a string, b string, c string, d string, w double")


def concordance_factors(quartets: DataFrame) -> DataFrame:
    """(tree_id, a, b, c, d) -> (q0..q3, n0, n1, n2): how many trees show each class."""
    q = F.array_sort(F.array("a", "b", "c", "d"))
    s = canonical(*map(F.col, "abcd"))
    cls = F.when(s["b"] == q[1], 0).when(s["b"] == q[2], 1).otherwise(2)
    rows = quartets.select(*(q[i].alias(f"q{i}") for i in range(4)), cls.alias("cls"))
    return rows.groupBy("q0", "q1", "q2", "q3").agg(*(F.sum((F.col("cls") == k).cast("long")).alias(f"n{k}") for k in range(3)))


def contracted(tree: DataFrame, flagged: DataFrame) -> DataFrame:
    """The tree without the flagged inner nodes (node_id): their children go to the nearest ancestor that stays."""
    out = closure(tree).join(flagged.select(F.col("node_id").alias("_f")), F.col("anc") == F.col("_f"), "left_anti").filter("dist > 0")
    up = out.groupBy("node_id").agg(F.min_by("anc", "dist").alias("_p"))
    kept = tree.join(flagged.select("node_id"), "node_id", "left_anti")
    return kept.join(up, "node_id", "left").select(*[F.col("_p").alias("parent_id") if c == "parent_id" else F.col(c) for c in tree.columns])
