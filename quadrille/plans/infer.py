"""From an alignment to a tree with support."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import design, sites, splits, support
from ..operators import trees as tree_tables
from ..sources import alignments
from ..sources.quartets import Config
from ..sources.tables import written
from . import newick
from .assemble import LOCAL, assemble, locally


def block_weights(blocks: DataFrame, site_rows: DataFrame, kernel: bool = True) -> DataFrame:
    """(block_id, members) and sites -> (block_id, q0..q3, w0..w2).

    The kernel counts classes block by block. Without it patterns are joined, each distinct quartet's once, and then to the blocks that have it.
    """
    if kernel:
        return sites.scores(sites.block_class_counts(blocks, site_rows), "block_id")
    quartets = sites.block_quartets(blocks)
    distinct = quartets.select(*sites.Q).distinct()
    counted = distinct.join(sites.class_counts(sites.site_patterns(distinct, site_rows)), list(sites.Q), "left").fillna(0, ["c0", "c1", "c2"])
    return quartets.join(sites.scores(counted), list(sites.Q)).select("block_id", *sites.Q, "w0", "w1", "w2")


def weighted_splits(weights: DataFrame, config: Config) -> DataFrame:
    """Splits of block weights under the configured aggregation."""
    w = splits.top1(weights) if config.top1_only else weights
    if config.aggregate_mode == "batch_only":
        w = w.withColumn("batch", F.floor(F.col("block_id") / config.infer_batch_size))
    return splits.to_splits(splits.aggregated(w, config.aggregate_mode, "batch" if config.aggregate_mode == "batch_only" else "block_id"))


def repaired(tree: newick.Node, site_rows: DataFrame) -> tuple[newick.Node, list[DataFrame]]:
    """Polytomies resolved, all of a round at once: the least leaf of each direction stands for it, the quartets of each polytomy's leaves are scored in one job, its
    tree is assembled by single moves, one task a polytomy, and the directions' clades take the leaves' places.

    Which leaves lie in a direction doesn't depend on how others are resolved, so polytomies are problems of their own. Nodes that are still wide go to a
    further round; those that stay as wide are left. Polytomies of more splits than one task takes are assembled level by level. Also returns the splits
    that each round added.
    """
    added, stuck = [], set()
    tree = newick.unrooted(tree)
    spark = site_rows.sparkSession
    while wide := [x for x in tree.walk() if newick.unrooted_degree(x) > 3 and id(x) not in stuck]:
        reps = _directions(tree, wide)
        ids = [sorted(map(int, r)) for r in reps]
        blocks = spark.createDataFrame(list(enumerate(ids)), "block_id long, members array<long>")
        taxa = spark.createDataFrame([(t,) for t in sorted({t for i in ids for t in i})], "taxon long")
        scored = sites.scores(sites.block_class_counts(blocks, site_rows.join(taxa, "taxon", "left_semi")), "block_id")
        rows = written(splits.repair_splits(scored, "block_id"), "repair")
        added.append(rows.drop("block_id"))
        large = [k for k, i in enumerate(ids) if 3 * math.comb(len(i), 4) > LOCAL]
        subs = {k: assemble(rows.filter(F.col("block_id") == k).drop("block_id")) for k in large}
        small = rows.withColumnRenamed("block_id", "sub_id")
        for r in locally(small.filter(~F.col("sub_id").isin(large)) if large else small, "qfm", "n0", 1).collect():
            subs[r["sub_id"]] = newick.parse(r["newick"])
        for k, node in enumerate(wide):
            sub = subs.get(k)
            have = {x.name for x in sub.leaves()} if sub else set()
            if sub is None or len(newick.unrooted(sub).children) >= len(ids[k]) or have != set(map(str, ids[k])):
                stuck.add(id(node))
            else:
                _grafted(node, sub, reps[k])
    return tree, added


def _directions(tree: newick.Node, nodes: list[newick.Node]) -> list[dict[str, newick.Node | None]]:
    """For each node the least leaf of each direction, with the child it lies below, None for what lies beyond the parent."""
    least: dict[int, str] = {}
    order = list(tree.walk())
    for x in order:
        least[id(x)] = x.name if x.is_leaf else min(least[id(c)] for c in x.children)
    beyond: dict[int, str] = {}
    for x in reversed(order):
        for c in x.children:
            beyond[id(c)] = min([least[id(o)] for o in x.children if o is not c] + ([beyond[id(x)]] if id(x) in beyond else []))
    return [{least[id(c)]: c for c in x.children} | ({beyond[id(x)]: None} if x.parent is not None else {}) for x in nodes]


def _grafted(node: newick.Node, sub: newick.Node, reps: dict[str, newick.Node | None]) -> None:
    """Puts a tree of the directions' leaves in the place of a node, rooted at what lies beyond the node's parent, with clades for leaves."""
    above = next((name for name, clade in reps.items() if clade is None), None)
    if above is not None:
        top = newick.rerooted(sub, newick.leaf_of(sub, above))
        sub = next(c for c in top.children if not (c.is_leaf and c.name == above))
    for leaf in sub.leaves():
        clade, parent = reps[leaf.name], leaf.parent
        parent.children[parent.children.index(leaf)] = clade
        clade.parent = parent
    node.children = []
    for c in list(sub.children):
        node.add(c)


def supported(tree: newick.Node, split_rows: DataFrame) -> newick.Node:
    """The tree with the main quartet frequency of each inner branch as support and coalescent lengths."""
    spark = split_rows.sparkSession
    binary = newick.refined(tree.copy(), np.random.default_rng(1))
    table = _table(spark, binary)
    found = {r["branch"]: r for r in support.support(support.frequencies(split_rows, table)).collect()}
    order = list(binary.walk())[::-1]
    for i, x in enumerate(order):
        if i in found:
            x.support, x.length = found[i]["q1"], found[i]["brlen"]
    return binary


def _table(spark, tree: newick.Node) -> DataFrame:
    return spark.createDataFrame([(0, *n) for n in newick.nodes(tree)], tree_tables.NODES)


def infer(rows: DataFrame, config: Config | None = None, block: int = design.BLOCK) -> newick.Node:
    """(taxon_id, taxon, seq) -> a tree whose leaves have the taxa's names."""
    config = config or Config()
    spark = rows.sparkSession
    names = {r["taxon_id"]: r["taxon"] for r in rows.select("taxon_id", "taxon").collect()}
    if block == design.BLOCK:
        alignments.check_taxa(len(names))
    site_rows = alignments.sites(alignments.dense(rows)).select(F.col("taxon_id").cast("long").alias("taxon"), "pos", "state")
    site_rows = written(sites.informative(site_rows), "sites")
    ids = sorted(names)
    blocks = design.design(spark, len(ids), config.k_param, block, config.seed)
    split_rows = written(weighted_splits(block_weights(blocks, site_rows), config), "splits")
    tree = assemble(splits.summed(split_rows), config.quartet_assembler, "n2" if config.quartet_assembler == "qmc" else "n0", config.qmc_iter_limit)
    tree, added = repaired(tree, site_rows)
    if config.compute_branch_support:
        every = split_rows
        for a in added:
            every = every.unionByName(a)
        tree = supported(tree, splits.summed(every))
    for x in tree.leaves():
        x.name = names[int(x.name)]
    return tree
