"""Branch support from quartets, and tests of branches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import coalescent_length
from ..functions.statistics import biallelic_length
from .ancestry import Branches, of

SPLIT = ("a", "b", "c", "d")


def quadripartitions(tree: DataFrame) -> DataFrame:
    """(branch, taxon, code) of a binary tree's inner branches, as in ancestry.Branches: each taxon's part of each branch, taxa squared rows, made on executors."""
    branches = Branches(of(tree))
    names = branches.tree.names

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, branch in zip(batch.column("place").to_pylist(), batch.column("branch")):
                code = branches.parts(np.full(len(names), place), branches.tree.leaves)
                yield pa.RecordBatch.from_arrays([pa.array([branch.as_py()] * len(names), branch.type), names, pa.array(code, pa.int32())], ["branch", "taxon", "code"])

    kind = tree.schema["node_id"].dataType.simpleString()
    rows = tree.sparkSession.createDataFrame(list(zip(branches.places.tolist(), branches.ids)), f"place long, branch {kind}")
    return rows.mapInArrow(listed, f"branch {kind}, taxon string, code int")


def _around(quartets: DataFrame, branches: Branches, kind: str, tree_id: bool = False) -> DataFrame:
    """(branch, f1, f2, f3), for each tree_id if asked: the weights of quartets with their taxa in the four parts of a branch, as xy|zw, xz|yw, xw|yz.

    A quartet is around one branch at most, found by its taxa's ancestors: no branches are joined. Each batch is added up before the shuffle.
    """
    keys = ["tree_id", "branch"] if tree_id else ["branch"]
    ids = np.array(branches.ids, object)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.stack([branches.tree.numbers(batch.column(c)) for c in SPLIT], 1)
            known = np.flatnonzero((q >= 0).all(1))
            at, k = branches.around(q[known])
            known, k, at = known[at >= 0], k[at >= 0], at[at >= 0]
            w = np.asarray(batch.column("w")).astype(float)[known]
            group = np.stack([np.asarray(batch.column("tree_id"))[known] if tree_id else np.zeros(len(at), np.int64), at])
            some, of_row = np.unique(group, axis=1, return_inverse=True)
            sums = np.bincount(of_row.ravel() * 3 + k, w, 3 * some.shape[1]).reshape(-1, 3)
            places = np.searchsorted(branches.places, some[1])
            cols = ([pa.array(some[0], pa.int64())] if tree_id else []) + [pa.array(ids[places].tolist(), types[0])] + [pa.array(sums[:, i], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(cols, [*keys, "f1", "f2", "f3"])

    types = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]]
    rows = quartets.select(*(["tree_id"] if tree_id else []), *(F.col(c).cast("string").alias(c) for c in SPLIT), F.col("w").cast("double").alias("w"))
    found = rows.mapInArrow(add_up, ("tree_id long, " if tree_id else "") + f"branch {kind}, f1 double, f2 double, f3 double")
    return found.groupBy(*keys).agg(*(F.sum(f).alias(f) for f in ("f1", "f2", "f3")))


def _all(found: DataFrame, branches: Branches, kind: str) -> DataFrame:
    every = found.sparkSession.createDataFrame([(b,) for b in branches.ids], f"branch {kind}")
    return every.join(found, "branch", "left").fillna(0.0, ["f1", "f2", "f3"])


def frequencies(splits: DataFrame, tree: DataFrame) -> DataFrame:
    """(branch, f1, f2, f3): weights of the three resolutions around each branch of a binary tree; branches without any have zeros. Splits with a taxon that
    the tree lacks don't count."""
    branches, kind = Branches(of(tree)), tree.schema["node_id"].dataType.simpleString()
    return _all(_around(splits, branches, kind), branches, kind)


def gene_tree_frequencies(quartets: DataFrame, tree: DataFrame, weighted: bool = False) -> DataFrame:
    """(tree_id, a, b, c, d, w) -> (branch, f1, f2, f3). Unweighted, each tree has one vote, shared out among its quartets.

    Weighted, sums over the trees are scaled by sqrt(trees / sum of squared totals), trees with a total over 1e-9 counting.
    """
    branches, kind = Branches(of(tree)), tree.schema["node_id"].dataType.simpleString()
    return _all(votes(_around(quartets, branches, kind, True), weighted), branches, kind)


def votes(each: DataFrame, weighted: bool) -> DataFrame:
    """(tree_id, branch, f1, f2, f3) -> (branch, f1, f2, f3) over the trees, as gene_tree_frequencies has it."""
    each = each.withColumn("t", F.col("f1") + F.col("f2") + F.col("f3")).filter("t > 1e-9")
    if not weighted:
        return each.groupBy("branch").agg(*(F.sum(F.col(f) / F.col("t")).alias(f) for f in ("f1", "f2", "f3")))
    scale = F.sqrt(F.count("*") / F.sum(F.col("t") * F.col("t")))
    return each.groupBy("branch").agg(*((F.sum(f) * scale).alias(f) for f in ("f1", "f2", "f3")))


def partitioned_support(quartets: DataFrame, tree: DataFrame, branch) -> DataFrame:
    """(tree_id, f_xy_zw, f_xz_yw, f_xw_yz, f_xyzw, totalf): each tree's quartets around one branch; f_xyzw is what it leaves open.

    The tree must hold the taxa of the quartets; the number of quartets that one could show is the product of its taxa in the four parts.
    """
    branches, kind = Branches(of(tree)), tree.schema["node_id"].dataType.simpleString()
    shown = _around(quartets.withColumn("w", F.lit(1.0)), branches, kind, True).filter(F.col("branch") == branch).drop("branch")
    q = quadripartitions(tree).filter(F.col("branch") == branch).select("taxon", "code")
    taxa = quartets.select("tree_id", F.explode(F.array(*(F.col(c).cast("string") for c in SPLIT))).alias("taxon")).distinct().join(q, "taxon")
    count = lambda c: F.sum((F.col("code") == c).cast("double"))
    could = taxa.groupBy("tree_id").agg((count(1) * count(2) * count(4) * count(8)).alias("totalf"))
    rows = could.join(shown, "tree_id", "left").fillna(0.0, ["f1", "f2", "f3"])
    return rows.select("tree_id", F.col("f1").alias("f_xy_zw"), F.col("f2").alias("f_xz_yw"), F.col("f3").alias("f_xw_yz"), (F.col("totalf") - F.col("f1") - F.col("f2") - F.col("f3")).alias("f_xyzw"), "totalf")


def support(freqs: DataFrame, biallelic: bool = False) -> DataFrame:
    """(branch, f1..f3) -> with en, q1..q3 and brlen, in coalescent units; all 0 where nothing is known."""
    en = F.col("f1") + F.col("f2") + F.col("f3")
    q = freqs.withColumn("en", en)
    for k in (1, 2, 3):
        q = q.withColumn(f"q{k}", F.coalesce(F.col(f"f{k}") / F.when(F.col("en") > 0, F.col("en")), F.lit(0.0)))
    return q.withColumn("brlen", biallelic_length("q1") if biallelic else coalescent_length(F.col("q1")))


def support_table(supported: DataFrame) -> DataFrame:
    """Three rows a branch: node, tree, qfreq, en, qsupp, brlen (NA but for the tree's own resolution)."""
    rows = F.array(*(F.struct(F.lit(f"t{k}").alias("tree"), F.col(f"f{k}").alias("qfreq"), F.col("en"), F.col(f"q{k}").alias("qsupp"), (F.format_string("%.6f", "brlen") if k == 1 else F.lit("NA")).alias("brlen")) for k in (1, 2, 3)))
    return supported.select(F.concat(F.lit("N"), F.col("branch").cast("string")).alias("node"), F.explode(rows).alias("r")).select("node", "r.*")


def reliability(branches: DataFrame, bins: int = 10) -> DataFrame:
    """(support 0-1, correct boolean) -> (n, auc, ece): area under the curve by ranks, and calibration error over equal bins.

    Both come from counts per support value, so ranks need no sort of all rows in one task.
    """
    per = branches.groupBy("support").agg(F.sum(F.col("correct").cast("long")).alias("p"), F.sum((~F.col("correct")).cast("long")).alias("n"))
    below = Window.orderBy("support").rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.withColumn("under", F.coalesce(F.sum("n").over(below), F.lit(0)))
    auc = ranked.agg(F.sum("p").alias("right"), F.sum("n").alias("wrong"), F.sum(F.col("p") * (F.col("under") + F.col("n") / 2)).alias("u"))
    b = branches.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("support") * bins))).groupBy("bin").agg(F.count("*").alias("c"), F.avg("support").alias("s"), F.avg(F.col("correct").cast("double")).alias("a"))
    ece = b.agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.abs(F.col("s") - F.col("a"))) / F.sum("c")).alias("ece"))
    return auc.crossJoin(ece).select("n", (F.col("u") / (F.col("right") * F.col("wrong"))).alias("auc"), "ece")


def tail_recall(branches: DataFrame, order: str, shares: tuple[float, ...] = (0.1, 0.2, 0.3)) -> DataFrame:
    """(support, correct, order) -> (share, branches, recall): the part of the wrong branches among the share of all with least support.

    Ties go by the column `order`. Where a share ends is found on counts per support, so only branches of one support are sorted.
    """
    per = branches.groupBy("support").agg(F.count("*").alias("here"), F.sum((~F.col("correct")).cast("long")).alias("wrong"))
    below = Window.orderBy("support").rowsBetween(Window.unboundedPreceding, -1)
    total = per.agg(F.sum("here").alias("n"), F.sum("wrong").alias("all_wrong"))
    placed = per.withColumn("under", F.coalesce(F.sum("here").over(below), F.lit(0))).crossJoin(F.broadcast(total))
    ends = placed.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("left", F.ceil(F.col("share") * F.col("n")) - F.col("under"))
    full = ends.filter("left >= here").groupBy("share").agg(F.sum("here").alias("branches"), F.sum("wrong").alias("found"))
    cut = ends.filter("left > 0 and left < here").select(F.col("support").alias("s"), "share", "left")
    place = F.row_number().over(Window.partitionBy("share").orderBy(order))
    part = branches.join(F.broadcast(cut), F.col("support") == F.col("s")).withColumn("place", place).filter("place <= left")
    part = part.groupBy("share").agg(F.count("*").alias("branches"), F.sum((~F.col("correct")).cast("long")).alias("found"))
    both = full.unionByName(part).groupBy("share").agg(F.sum("branches").alias("branches"), F.sum("found").alias("found"))
    return both.crossJoin(F.broadcast(total)).select("share", "branches", (F.col("found") / F.when(F.col("all_wrong") > 0, F.col("all_wrong"))).alias("recall"))
