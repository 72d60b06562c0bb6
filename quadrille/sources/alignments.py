"""Alignments and character matrices: PHYLIP, FASTA, NEXUS, format sniffing, concatenation, conversion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import states
from .records import head, records

#: Taxa that an inference run accepts.
LEAST_TAXA, MOST_TAXA = 24, 65535


def read_phylip(spark: SparkSession, path: str, renumber: bool = True) -> DataFrame:
    """(taxon_id, taxon, seq) of sequential PHYLIP, one line a taxon, read in byte ranges. With renumber, names whose first numbers run from 0 to n - 1 give the ids.

    Longer rows are cut to the declared length and shorter ones filled up with gaps. A file whose number of rows differs
    from its header raises ValueError.
    """
    lines, n = records(spark, path, "lines")
    text = next((t for t in head(path) if re.search(rb"\S[^\n]*\n", t)), b"")
    try:
        n_taxa, n_sites = map(int, text.split(None, 2)[:2])
    except ValueError as e:
        raise ValueError(f"no header with the numbers of taxa and sites: {path}") from e
    if n - 1 != n_taxa:
        raise ValueError(f"rows differ from the header: {n - 1}")
    parts = F.split(F.trim("value"), r"\s+", 2)
    seq = F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "")
    rows = lines.filter("n > 0").select((F.col("n") - 1).cast("int").alias("taxon_id"), F.get(parts, F.lit(0)).alias("taxon"), F.rpad(F.substring(seq, 1, n_sites), n_sites, "-").alias("seq"))
    return renumbered(rows) if renumber else rows


def renumbered(taxa: DataFrame, name: str = "taxon") -> DataFrame:
    """taxon_id after the first run of digits in each name where these are exactly 0 to n - 1, else as it was."""
    number = F.regexp_extract(name, r"(\d+)", 1).try_cast("long")
    stats = taxa.agg(F.count("*").alias("n"), F.count_distinct(number).alias("k"), F.min(number).alias("lo"), F.max(number).alias("hi"), F.count(number).alias("some"))
    fits = stats.select(((F.col("n") == F.col("k")) & (F.col("some") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)).alias("fits"))
    return taxa.crossJoin(F.broadcast(fits)).withColumn("taxon_id", F.when(F.col("fits"), number.cast("int")).otherwise(F.col("taxon_id"))).drop("fits")


def dense(rows: DataFrame) -> DataFrame:
    """(taxon_id, taxon, seq) -> (taxon_id, taxon, states)."""
    return rows.select("taxon_id", "taxon", states(F.col("seq")).alias("states"))


def sites(rows: DataFrame) -> DataFrame:
    """(taxon_id, states) -> (taxon_id, pos, state), one row a site."""
    return rows.select("taxon_id", F.posexplode("states").alias("pos", "state"))


def packed(values: Column) -> Column:
    """States as bytes of two, the even site in the low half."""
    n = F.floor((F.size(values) + 1) / 2).cast("int")
    byte = lambda i: F.get(values, (2 * i).cast("int")).cast("int") + 16 * F.coalesce(F.get(values, (2 * i + 1).cast("int")).cast("int"), F.lit(0))
    digits = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0"))
    return F.when(n > 0, F.unhex(F.array_join(digits, ""))).otherwise(F.lit(b""))


def unpacked(data: Column, length: Column) -> Column:
    """The first `length` states of packed bytes."""
    digits = F.hex(data)
    digit = lambda i: F.substring(digits, (2 * F.floor(i / 2) + 2 - i % 2).cast("int"), F.lit(1))
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.conv(digit(i), 16, 10).cast("tinyint"))).otherwise(F.array().cast("array<tinyint>"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(taxon_id, taxon, seq): a record's lines are joined. The file is read in byte ranges, cut at entries."""
    entries, _ = records(spark, path, "fasta")
    name = F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1))
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    return entries.select(F.col("n").cast("int").alias("taxon_id"), name.alias("taxon"), seq.alias("seq"))


def read_nexus(spark: SparkSession, path: str) -> DataFrame:
    """(taxon_id, taxon, seq) of the matrix block, read in byte ranges; counts that differ from ntax raise ValueError."""
    for text in head(path):
        # Comments count as blanks.
        plain = re.sub(rb"\[[^\]]*\]", lambda m: b" " * len(m[0]), text)
        block = re.search(rb"(?i)\bmatrix\b", plain)
        if block:
            break
    else:
        raise ValueError(f"no matrix: {path}")
    lines, n = records(spark, path, "lines", block.end(), ";")
    ntax = re.search(rb"(?i)ntax\s*=\s*(\d+)", plain[: block.start()])
    if ntax and int(ntax[1]) != n:
        raise ValueError(f"rows differ from ntax: {n}")
    parts = F.split(F.trim("value"), r"\s+", 2)
    return lines.select(F.col("n").cast("int").alias("taxon_id"), F.regexp_replace(parts[0], "^['\"]|['\"]$", "").alias("taxon"), F.regexp_replace(F.get(parts, F.lit(1)), r"\s", "").alias("seq"))


def kind_of(spark: SparkSession, path: str) -> str:
    """fasta, nexus, newick or phylip, by a file's first character."""
    first = spark.read.text(path).filter(F.trim("value") != "").select(F.substring(F.trim("value"), 1, 1).alias("c")).first()
    return {">": "fasta", "#": "nexus", "(": "newick"}.get(first["c"] if first else "", "phylip")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(taxon_id, taxon, seq) of a character matrix in any of the formats."""
    readers = {"fasta": read_fasta, "nexus": read_nexus, "phylip": lambda s, p: read_phylip(s, p, renumber=False)}
    kind = kind_of(spark, path)
    if kind not in readers:
        raise ValueError(f"no character matrix: {path}")
    return readers[kind](spark, path)


def characters(rows: DataFrame) -> DataFrame:
    """(taxon, seq) -> (pos, taxon, state): one row a character."""
    return rows.select("taxon", F.posexplode(F.split("seq", "")).alias("pos", "state")).filter("state <> ''").select("pos", "taxon", "state")


def supermatrix(parts: DataFrame) -> DataFrame:
    """(part, taxon, seq) -> (taxon, seq): parts joined in order; a taxon missing from a part has gaps there."""
    lengths = parts.groupBy("part").agg(F.max(F.length("seq")).alias("len")).agg(F.array_sort(F.collect_list(F.struct("part", "len"))).alias("lengths"))
    own = parts.groupBy("taxon").agg(F.map_from_entries(F.collect_list(F.struct("part", "seq"))).alias("own"))
    # One row with the number of sites of each part goes to every taxon; what a taxon lacks is made there.
    filled = F.transform("lengths", lambda p: F.rpad(F.coalesce(F.try_element_at("own", p["part"]), F.lit("")), p["len"], F.lit("-")))
    return own.join(lengths).select("taxon", F.array_join(filled, "").alias("seq"))


def nexus_text(rows: DataFrame) -> DataFrame:
    """(taxon, seq) -> value: one NEXUS file."""
    lines = F.array_sort(F.collect_list(F.concat(F.col("taxon"), F.lit(" "), F.col("seq"))))
    body = rows.agg(lines.alias("l"), F.count("*").alias("n"), F.max(F.length("seq")).alias("m"))
    head = F.concat(F.lit("#NEXUS\nbegin data;\n  dimensions ntax="), F.col("n"), F.lit(" nchar="), F.col("m"), F.lit(";\n  format datatype=standard gap=- missing=?;\n  matrix\n"))
    return body.select(F.concat(head, F.array_join("l", "\n"), F.lit("\n;\nend;")).alias("value"))


def check_taxa(n: int) -> None:
    if not LEAST_TAXA <= n <= MOST_TAXA:
        raise ValueError(f"{n} taxa; {LEAST_TAXA} to {MOST_TAXA} can be inferred")
