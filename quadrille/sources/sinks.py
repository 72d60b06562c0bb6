"""Tables of results as text files, and where they go."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUBPROBLEMS = "id long, parent long, depth int, size int, artificial int, subset array<string>"


def write_support(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(node, tree, qfreq, en, qsupp, brlen) as text between tabs, with a header in each part."""
    table.select("node", "tree", "qfreq", "en", "qsupp", "brlen").write.csv(path, sep="\t", header=True, nullValue="NA", mode=mode)


def partitioned_lines(rows: DataFrame, quads: DataFrame, branch) -> DataFrame:
    """Rows of partitioned_support -> (place, value): four comment lines with the taxa around the branch, a header, a line a tree, between tabs."""
    columns = ["tree_id", "f_xy_zw", "f_xz_yw", "f_xw_yz", "f_xyzw", "totalf"]
    name = F.element_at(F.create_map(*(F.lit(x) for k, part in enumerate("xyzw") for x in (1 << k, part))), F.col("code"))
    parts = quads.filter(F.col("branch") == branch).groupBy("code").agg(F.array_join(F.array_sort(F.collect_list(F.col("taxon").cast("string"))), ",").alias("taxa"))
    comments = parts.select(F.struct(F.lit(0).alias("part"), F.col("code").cast("long").alias("at")).alias("place"), F.concat(F.lit("# "), name, F.lit(" = "), "taxa").alias("value"))
    header = rows.sparkSession.range(1).select(F.struct(F.lit(1).alias("part"), F.lit(0).cast("long").alias("at")).alias("place"), F.lit("\t".join(columns)).alias("value"))
    lines = rows.select(F.struct(F.lit(2).alias("part"), F.col("tree_id").cast("long").alias("at")).alias("place"), F.concat_ws("\t", *(F.col(c).cast("string") for c in columns)).alias("value"))
    return comments.unionByName(header).unionByName(lines)


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(place, value) as text whose parts, end to end, are in order of place."""
    lines.orderBy("place").select("value").write.mode(mode).text(path)


def subproblems(spark: SparkSession, metrics: list[dict]) -> DataFrame:
    """What an assembly notes of its subproblems: ID, PARENT, DEPTH, SIZE, ARTIFICIAL, SUBSET as they are written between commas."""
    rows = spark.createDataFrame([tuple(m[c.split()[0]] for c in SUBPROBLEMS.split(", ")) for m in metrics], SUBPROBLEMS)
    return rows.select(*(F.col(c).alias(c.upper()) for c in ("id", "parent", "depth", "size", "artificial")), F.array_join("subset", ";").alias("SUBSET"))


def output_path(given: str, source: str, ending: str = ".nwk", overwrite: bool = True) -> str:
    """Where a tree goes: the file given, made to a folder's file named after the source if it is a folder or has no suffix.

    Folders are made. A file that is there raises FileExistsError unless it may be overwritten.
    """
    if os.path.isdir(given) or not os.path.splitext(os.path.basename(given))[1]:
        given = os.path.join(given, os.path.splitext(os.path.basename(source))[0] + ending)
    os.makedirs(os.path.dirname(given) or ".", exist_ok=True)
    if os.path.exists(given) and not overwrite:
        raise FileExistsError(given)
    return given
