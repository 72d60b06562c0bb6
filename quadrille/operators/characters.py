"""Character matrices: characters as groups, trees and quartets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import missing


def groups(characters: DataFrame) -> DataFrame:
    """(pos, taxon, state) -> (pos, state, taxa, n) for characters that tell something: two states or more with two taxa
    or more each, and four taxa or more that aren't missing."""
    known = characters.filter(F.col("state").isNotNull() & ~missing(F.col("state")))
    each = known.groupBy("pos", "state").agg(F.array_sort(F.collect_set("taxon")).alias("taxa")).withColumn("n", F.size("taxa"))
    good = each.groupBy(F.col("pos").alias("_p")).agg(F.sum((F.col("n") >= 2).cast("int")).alias("wide"), F.sum("n").alias("all")).filter("wide >= 2 and all >= 4").select("_p")
    return each.join(good, F.col("pos") == F.col("_p"), "left_semi").select("pos", "state", "taxa", "n")


def newicks(group_rows: DataFrame) -> DataFrame:
    """(pos, state, taxa, n) -> (tree_id, newick): each character as a tree with one clade a state."""
    clade = F.when(F.col("n") > 1, F.concat(F.lit("("), F.array_join(F.col("taxa").cast("array<string>"), ","), F.lit(")"))).otherwise(F.col("taxa")[0].cast("string"))
    rows = group_rows.select("pos", "state", clade.alias("clade"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("state", "clade"))), lambda x: x["clade"]), ",")
    return rows.groupBy(F.col("pos").cast("long").alias("tree_id")).agg(F.concat(F.lit("("), joined, F.lit(");")).alias("newick"))


def concordance(characters: DataFrame) -> DataFrame:
    """(pos, taxon, state) -> (q0..q3, n0, n1, n2): characters that support each class by two states, two and two.

    Pairs of one state are met across states of the same character, so only quartets that some character supports are made;
    the others have no row.
    """
    known = characters.filter(F.col("state").isNotNull() & ~missing(F.col("state"))).select("pos", "taxon", "state").distinct()
    other = known.select(F.col("pos").alias("_p"), F.col("taxon").alias("y"), F.col("state").alias("_s"))
    pairs = known.join(other, (F.col("pos") == F.col("_p")) & (F.col("state") == F.col("_s")) & (F.col("taxon") < F.col("y"))).select("pos", "state", F.col("taxon").alias("x"), "y")
    right = pairs.select(F.col("pos").alias("_p"), F.col("state").alias("_s"), F.col("x").alias("z"), F.col("y").alias("w"))
    met = pairs.join(right, (F.col("pos") == F.col("_p")) & (F.col("state") < F.col("_s")))
    q = F.array_sort(F.array("x", "y", "z", "w"))
    mate = F.when(F.col("x") == q[0], F.col("y")).otherwise(F.col("w"))
    cls = F.when(mate == q[1], 0).when(mate == q[2], 1).otherwise(2)
    rows = met.select(*(q[i].alias(f"q{i}") for i in range(4)), cls.alias("cls"))
    return rows.groupBy("q0", "q1", "q2", "q3").agg(*(F.sum((F.col("cls") == k).cast("long")).alias(f"n{k}") for k in range(3)))
