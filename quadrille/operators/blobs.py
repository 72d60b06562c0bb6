"""Tree of blobs: p-values of quartets around branches, and contraction of branches that fail."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.statistics import star_test, tree_test
from ..plans import newick
from ..sources.tables import written
from .ancestry import Ancestry, Branches, of
from .sites import Q
from .trees import contracted

ALPHA, BETA = 1e-7, 0.95
#: Quartets that a task counts in its trees.
SLICE = 1 << 17


def with_p(counts: DataFrame) -> DataFrame:
    """(q0..q3, n0..n2) with p_tree and p_star."""
    n = [F.col(f"n{k}") for k in range(3)]
    total = n[0] + n[1] + n[2]
    return counts.withColumn("p_tree", F.when(total > 0, tree_test(*(x.cast("double") for x in n))).otherwise(F.lit(1.0))).withColumn("p_star", star_test(*n))


def _placed(counts: DataFrame, quads: DataFrame, four: bool) -> DataFrame:
    out = counts
    for i in range(4):
        s = quads.select(F.col("branch").alias(f"_b{i}"), F.col("taxon").alias("_t"), F.col("code").alias(f"c{i}"))
        out = out.join(s, (F.col(f"q{i}") == F.col("_t")) if i == 0 else (F.col(f"q{i}") == F.col("_t")) & (F.col("_b0") == F.col(f"_b{i}"))).drop("_t")
    codes = [F.col(f"c{i}") for i in range(4)]
    if four:
        keep = codes[0].bitwiseOR(codes[1]).bitwiseOR(codes[2]).bitwiseOR(codes[3]) == 15
    else:
        inside = [(c <= 2).cast("int") for c in codes]
        keep = (inside[0] + inside[1] + inside[2] + inside[3]) == 2
    return out.filter(keep).withColumnRenamed("_b0", "branch")


def searched(counts_p: DataFrame, quads: DataFrame, quadripartition: bool = False) -> DataFrame:
    """(branch, p_tree, p_star, q0..q3, n0..n2): the least tree p-value over all quartets with two taxa on either side of each branch,
    or with one in each of its four parts; with it the largest star p-value, and the quartet that has the least."""
    rows = _placed(counts_p, quads, quadripartition)
    least = F.struct("p_tree", "q0", "q1", "q2", "q3", "n0", "n1", "n2")
    found = rows.groupBy("branch").agg(F.min(least).alias("m"), F.max("p_star").alias("p_star"))
    return found.select("branch", "m.p_tree", "p_star", "m.q0", "m.q1", "m.q2", "m.q3", "m.n0", "m.n1", "m.n2")


def searched_3f1a(counts_p: DataFrame, quads: DataFrame) -> DataFrame:
    """The same by four steps, each of which holds three taxa of the best quartet so far and changes the fourth within its part."""
    rows = _placed(counts_p, quads, True)
    by_code = [F.get(F.array("q0", "q1", "q2", "q3"), F.array_position(F.array("c0", "c1", "c2", "c3"), F.lit(c)).cast("int") - 1) for c in (1, 2, 4, 8)]
    rows = rows.select("branch", "p_tree", "p_star", "q0", "q1", "q2", "q3", "n0", "n1", "n2", *(x.alias(f"x{i}") for i, x in enumerate(by_code)))
    best = rows.groupBy("branch").agg(F.min(F.struct("x0", "x1", "x2", "x3")).alias("s")).select("branch", "s.*")
    for i in range(4):
        held = [f"x{j}" for j in range(4) if j != i]
        near = rows.join(best.select("branch", *held), ["branch", *held])
        best = near.groupBy("branch").agg(F.min(F.struct("p_tree", "x0", "x1", "x2", "x3")).alias("s")).select("branch", "s.x0", "s.x1", "s.x2", "s.x3")
    top = rows.groupBy("branch").agg(F.max("p_star").alias("top"))
    return rows.join(best, ["branch", "x0", "x1", "x2", "x3"]).join(top, "branch").select("branch", "p_tree", F.col("top").alias("p_star"), "q0", "q1", "q2", "q3", "n0", "n1", "n2")


def tree_of_blobs(tree: DataFrame, branches: DataFrame, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """The tree without branches whose least tree p-value is below alpha or whose largest star p-value is above beta."""
    return contracted(tree, branches.filter((F.col("p_tree") < alpha) | (F.col("p_star") > beta)).select(F.col("branch").alias("node_id")))


def counted(trees: DataFrame, wanted: DataFrame, names: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """(tree_id, newick) and (q0..q3 as places in names, rising) -> (q0..q3, n0, n1, n2): how many trees show each class of just these quartets.

    Quartets are dealt to slices and trees to packs; a task has one of each, asks the ancestors of each tree once for all its quartets, and counts add up. Trees that lack
    a taxon, or leave the quartet open, don't count; quartets without any tree have zeros.
    """
    slices = max(1, -(-wanted.count() // SLICE))
    packs = max(1, min(trees.sparkSession.sparkContext.defaultParallelism, trees.count()))
    asked = wanted.withColumn("slice", F.pmod(F.xxhash64(*Q), F.lit(slices)).cast("int")).withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    shown = trees.filter("newick <> ''").select("newick", F.pmod(F.xxhash64("tree_id", "newick"), F.lit(packs)).cast("int").alias("t_pack")).withColumn("t_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def count(quartets: pa.Table, some: pa.Table) -> pa.Table:
        q = np.stack([quartets.column(c).to_numpy() for c in Q], 1).astype(np.int64) if quartets.num_rows else np.empty((0, 4), np.int64)
        n = np.zeros((len(q), 3), np.int64)
        for text in some.column("newick").to_pylist():
            rows = newick.nodes(newick.parse(text, rename))
            tree = Ancestry(*map(list, zip(*((r[0], r[1], r[2], r[-1]) for r in rows))))
            at = tree.numbers(pa.array(names))[q]
            known = np.flatnonzero((at >= 0).all(1))
            cls = tree.topologies(at[known])[0]
            np.add.at(n, (known[cls >= 0], cls[cls >= 0]), 1)
        return pa.table({c: pa.array(q[:, k].astype(np.int32)) for k, c in enumerate(Q)} | {f"n{k}": pa.array(n[:, k]) for k in range(3)})

    cells = asked.groupBy("slice", "pack").cogroup(shown.groupBy("t_slice", "t_pack")).applyInArrow(count, "q0 int, q1 int, q2 int, q3 int, n0 long, n1 long, n2 long")
    return cells.groupBy(*Q).agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(3)))


#: (q0..q3, n0..n2, p_tree, p_star) by names of taxa in order: what is known of quartets, kept between runs.
STORE = "q0 string, q1 string, q2 string, q3 string, n0 long, n1 long, n2 long, p_tree double, p_star double"


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The p-values of earlier runs; none where there is no such table."""
    try:
        return spark.read.schema(STORE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], STORE)


def keep(found: DataFrame, path: str) -> None:
    """Adds the p-values of quartets that the table at path does not have yet."""
    have = stored(found.sparkSession, path).select(*Q)
    written(found.join(have, list(Q), "left_anti").dropDuplicates(list(Q)), "p-values").write.mode("append").parquet(path)


def descended(trees: DataFrame, tree: DataFrame, limit: int | None = None, starts: int = 4, seed: int = 0, known: DataFrame | None = None, star: bool = False, rename: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(branches as in searched, p-values as in STORE): for each branch of a binary tree the least tree p-value that descents find over quartets with two taxa on either side.

    A descent begins at a random quartet, looks at all quartets that differ in one taxon of the same side, and goes to the best while that is better. Each
    branch makes `starts` descents at a time, anew until it has looked at `limit` quartets, 2 n^2 unless told. All branches step together: a step is one
    job, which counts in the gene trees just the quartets that are not known, from this run or by `known`. So quartets are never all listed, and of n taxa
    some n^2 are on executors at a time. p_star is the star p-value of the best quartet. star: the largest star p-value is sought instead.
    """
    spark, index = trees.sparkSession, of(tree)
    trees = written(trees.select("tree_id", "newick"), "gene-trees")
    names = sorted(index.names.to_pylist())
    places = np.searchsorted(names, index.names.to_pylist())
    branches, rng = Branches(index), np.random.default_rng(seed)
    limit = 2 * len(names) ** 2 if limit is None else limit
    sides = {}
    for x, b in zip(branches.places.tolist(), branches.ids):
        inside = branches.tree.below(index.leaves, np.full(len(index.leaves), x))
        sides[b] = (np.sort(places[inside]), np.sort(places[~inside]))
    named = lambda df: df.select(*(F.element_at(F.array(*map(F.lit, names)), F.col(q) + 1).alias(q) for q in Q), "n0", "n1", "n2", "p_tree", "p_star")
    have = None
    if known is not None:
        at = F.create_map(*(F.lit(v) for k, n in enumerate(names) for v in (n, k)))
        have = written(known.select(*(at[F.col(q)].cast("int").alias(q) for q in Q), "n0", "n1", "n2", "p_tree", "p_star").dropna(subset=list(Q)), "p-values")

    def begun(b) -> tuple:
        return tuple(int(x) for s in sides[b] for x in rng.choice(s, 2, replace=False))

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, quartet in zip(batch.column("n").to_pylist(), batch.column("quartet").to_pylist()):
                a, b = sides[ids[n]]
                rows = [quartet]
                for k, side in ((0, a), (1, a), (2, b), (3, b)):
                    pair = quartet[:2] if k < 2 else quartet[2:]
                    rows += [[*quartet[:k], int(x), *quartet[k + 1 :]] for x in side if x not in pair]
                q = np.array(rows)
                moved = pa.array(q.tolist(), pa.list_(pa.int32()))
                q = np.sort(q, 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), n), pa.int32()), moved, *(pa.array(q[:, k]) for k in range(4))], ["n", "moved", *Q])

    # Each descent: branch, quartet, its value so far, quartets looked at.
    ids = [b for b in branches.ids for _ in range(starts)]
    value = "-p_star" if star else "p_tree"
    now = {n: [begun(b), None] for n, b in enumerate(ids)}
    seen, best = dict.fromkeys(branches.ids, 0), {}
    step = 0
    while now:
        state = spark.createDataFrame([(n, list(q)) for n, (q, _) in now.items()], "n int, quartet array<int>")
        near = written(state.repartition(min(len(now), spark.sparkContext.defaultParallelism), "n").mapInArrow(expanded, "n int, moved array<int>, q0 int, q1 int, q2 int, q3 int"), "descent-near")
        new = near.select(*Q).distinct()
        new = written(new if have is None else new.join(have, list(Q), "left_anti"), "descent-new")
        found = written(with_p(counted(trees, new, names, rename)), "p-values")
        have = found if have is None else have.unionByName(found)
        step += 1
        if step % 16 == 0:
            have = written(have, "p-values")
        top = near.join(have, list(Q)).groupBy("n").agg(F.min(F.struct(F.expr(value).alias("value"), "moved", *Q, "n0", "n1", "n2", "p_tree", "p_star")).alias("m"), F.count("*").alias("looked"))
        for r in top.collect():
            n, m = r["n"], r["m"]
            b = ids[n]
            seen[b] += r["looked"]
            if now[n][1] is None or m["value"] < now[n][1]:
                now[n] = [tuple(m["moved"]), m["value"]]
                if b not in best or m["value"] < best[b][0]:
                    best[b] = (m["value"], m)
            elif seen[b] < limit:
                now[n] = [begun(b), None]
            else:
                del now[n]
    kind = tree.schema["node_id"].dataType.simpleString()
    rows = [(b, m["p_tree"], m["p_star"], *(names[m[q]] for q in Q), m["n0"], m["n1"], m["n2"]) for b, (_, m) in best.items()]
    out = spark.createDataFrame(rows, f"branch {kind}, p_tree double, p_star double, q0 string, q1 string, q2 string, q3 string, n0 long, n1 long, n2 long")
    return out, named(have) if have is not None else spark.createDataFrame([], STORE)


def blob_tree(trees: DataFrame, tree: DataFrame, alpha: float = ALPHA, beta: float = BETA, path: str | None = None, **search) -> tuple[DataFrame, DataFrame]:
    """(tree of blobs, its branches with p-values): descents, and contraction of the branches that fail. With a path, p-values of earlier runs are used and new ones added."""
    known = stored(trees.sparkSession, path) if path else None
    found, values = descended(trees, tree, known=known, **search)
    if path:
        keep(values, path)
    return tree_of_blobs(tree, found, alpha, beta), found
