"""Quartet files: templated text, concordance tables, binary records; taxon maps; configuration."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import canonical
from ..operators.sites import Q, block_quartets
from .records import RECORD, source

#: Layouts of a quartet in text; ___ stands for a taxon, and the fifth for the weight.
QMC, QFM, BARE = "___,___|___,___:___", "((___,___),(___,___));___", "___,___|___,___"


def template_regex(template: str) -> str:
    """A pattern with a group for each slot; blanks don't count and the weight may be absent with what precedes it."""
    parts = [re.escape(p) for p in template.replace(" ", "").split("___")]
    if len(parts) not in (5, 6):
        raise ValueError("a template has four or five slots")
    taxon = r"([^,|:;()\s]+)"
    out = "".join(p + taxon for p in parts[:4])
    return "^" + out + (f"(?:{parts[4]}([-+0-9.eE]+)?)?{parts[5]}$" if len(parts) == 6 else f"{parts[4]}$")


def parse_quartets(lines: DataFrame, template: str = QMC, mode: str = "PERMISSIVE", weights: bool = True) -> DataFrame:
    """(value) -> (a, b, c, d, w): one canonical split for each quartet of the template. A missing weight is 1.

    Lines may hold several quartets between blanks if the template has none. PERMISSIVE drops malformed ones, FAILFAST raises.
    """
    pattern = template_regex(template)
    one = lines.select(F.regexp_replace("value", r"\s+", "").alias("v")) if ";" in template else lines.select(F.explode(F.split(F.trim("value"), r"\s+")).alias("v"))
    one = one.filter("v <> ''")
    got = [F.regexp_extract("v", pattern, i) for i in range(1, 5)]
    w = F.regexp_extract("v", pattern, 5) if template.count("___") == 5 and weights else F.lit("")
    good = F.col("v").rlike(pattern)
    if mode == "FAILFAST":
        one = one.withColumn("v", F.when(good, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("no quartet: "), F.col("v")))))
    else:
        one = one.filter(good)
    weight = F.coalesce(F.when(w != "", w).try_cast("double"), F.lit(1.0))
    return one.select(canonical(*got).alias("s"), weight.alias("w")).select("s.*", "w")


def read_quartets(spark: SparkSession, path: str, template: str = QMC, mode: str = "PERMISSIVE", sum_repeats: bool = True) -> DataFrame:
    """Splits of a text file, repeats summed unless told not to."""
    found = parse_quartets(spark.read.text(path), template, mode)
    return summed(found) if sum_repeats else found


def summed(splits: DataFrame) -> DataFrame:
    return splits.groupBy("a", "b", "c", "d").agg(F.sum("w").alias("w"))


def concordance_splits(table: DataFrame) -> DataFrame:
    """(t1, t2, t3, t4, CF12_34, CF13_24, CF14_23, ngenes) -> (a, b, c, d, w, repeated): three splits a row, of weight CF * ngenes.

    Rows of the same four taxa add up, and are marked.
    """
    t = [F.col(f"t{i}") for i in range(1, 5)]
    cases = [("CF12_34", (0, 1, 2, 3)), ("CF13_24", (0, 2, 1, 3)), ("CF14_23", (0, 3, 1, 2))]
    rows = F.array(*(F.struct(canonical(*(t[i] for i in order)).alias("s"), (F.col(cf).cast("double") * F.col("ngenes").cast("double")).alias("w")) for cf, order in cases))
    found = table.select(F.explode(rows).alias("r")).select("r.s.*", "r.w")
    return found.groupBy("a", "b", "c", "d").agg(F.sum("w").alias("w"), (F.count("*") > 1).alias("repeated"))


def read_concordance(spark: SparkSession, path: str) -> DataFrame:
    schema = "t1 string, t2 string, t3 string, t4 string, CF12_34 double, CF13_24 double, CF14_23 double, ngenes double"
    return concordance_splits(spark.read.csv(path, header=True, schema=schema))


def read_binary(spark: SparkSession, path: str, positive_only: bool = False, int32: bool = False) -> DataFrame:
    """(a, b, c, d, w) of 16-byte records, read in byte ranges. Zero weights are skipped, with positive_only negative ones too.

    A file that ends within a record, or with int32 a weight, read or summed, of more bits, raises an error. Equal splits add up.
    """
    options = {k: "true" for k, on in (("positive", positive_only), ("int32", int32)) if on}
    rows = summed(source(spark, path, "binary", **options))
    if int32:
        fits = F.col("w").between(-(1 << 31) + 1, (1 << 31) - 1)
        rows = rows.withColumn("w", F.when(fits, F.col("w")).otherwise(F.raise_error(F.lit("a weight of more than 32 bits")).cast("long")))
    return rows


def read_index(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """(q0..q3) of an index of quartets in Parquet or CSV with a header: four columns q0..q3, or in block form block_id and members, of which every four are a quartet.

    In CSV, members are numbers between blanks. Members of a quartet are put in order; rows that hold a taxon twice, or none, raise an error.
    """
    table = spark.read.option("header", True).format(form).load(path)
    if "members" in table.columns:
        members = F.split(F.trim("members"), r"\s+") if form == "csv" else F.col("members")
        return block_quartets(table.select("block_id", members.cast("array<int>").alias("members"))).select(*Q)
    q = F.array_sort(F.array(*(F.col(c).cast("int") for c in Q)))
    fine = (F.size(F.array_distinct(q)) == 4) & ~F.exists(q, lambda x: x.isNull())
    checked = table.select(F.when(fine, q).otherwise(F.raise_error(F.concat(F.lit("no quartet: "), F.to_json(F.array(*Q)))).cast("array<int>")).alias("q"))
    return checked.select(*(F.col("q")[i].alias(c) for i, c in enumerate(Q)))


def to_records(splits: DataFrame) -> DataFrame:
    """(a, b, c, d, w) -> (content): 16-byte records, one blob for each batch of rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.asarray(batch.column(k)).astype(np.uint64) for k in "abcd"]
            rows = np.empty(batch.num_rows, RECORD)
            rows["key"] = (ids[0] << np.uint64(48)) | (ids[1] << np.uint64(32)) | (ids[2] << np.uint64(16)) | ids[3]
            rows["w"] = np.asarray(batch.column("w"))
            yield pa.RecordBatch.from_pydict({"content": pa.array([rows.tobytes()], pa.binary())})

    return splits.select("a", "b", "c", "d", F.col("w").cast("long").alias("w")).mapInArrow(pack, "content binary")


def split_lines(splits: DataFrame, layout: str = "qmc") -> DataFrame:
    """(a, b, c, d, w) -> (value): one line a split, as the assemblers read them."""
    form = "%s,%s|%s,%s:%s" if layout == "qmc" else "((%s,%s),(%s,%s));%s"
    return splits.select(F.format_string(form, *(F.col(c).cast("string") for c in ("a", "b", "c", "d", "w"))).alias("value"))


def quartet_ids(rows: DataFrame) -> DataFrame:
    """(a, b, c, d as names with a number) -> (q0, q1, q2, q3): the numbers."""
    return rows.select(*(F.regexp_extract(c, r"(\d+)", 1).cast("int").alias(f"q{i}") for i, c in enumerate("abcd")))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(indiv, taxon) from lines of two words."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(parts) >= 2).select(parts[0].alias("indiv"), parts[1].alias("taxon"))


def mapped(names: DataFrame, mapping: DataFrame, column: str = "name") -> DataFrame:
    """Names replaced by their taxon where the mapping has one."""
    m = mapping.select(F.col("indiv").alias("_i"), F.col("taxon").alias("_t"))
    return names.join(m, F.col(column) == F.col("_i"), "left").withColumn(column, F.coalesce("_t", column)).drop("_i", "_t")


def outgroups(spark: SparkSession, given: str) -> list[str]:
    """Names from a file's words or lines, else from a list between commas."""
    try:
        lines = [r["value"] for r in spark.read.text(given).collect()]
    except Exception as e:  # no such file: the argument itself is the list
        if "PATH_NOT_FOUND" not in str(e) and "PATH" not in str(getattr(e, "getCondition", lambda: "")()):
            raise
        lines = [given]
    return [n for line in lines for n in re.split(r"[,\s]+", line) if n]


@dataclass
class Config:
    """Options that change results, with the values that runs use unless told otherwise."""

    task_type: str = "homogeneous"
    k_param: float = 3.0
    quartet_assembler: str = "qfm"
    qmc_iter_limit: int = 1
    aggregate_mode: str = "full"
    top1_only: bool = False
    infer_batch_size: int = 4
    compute_branch_support: bool = False
    metric: str = "rf"
    quartet_sample_size: int = 40000
    seed: int = 42

    def __post_init__(self):
        for name, allowed in (("quartet_assembler", ("qfm", "qmc")), ("aggregate_mode", ("full", "batch_only", "off")), ("metric", ("rf", "quartet")), ("task_type", ("homogeneous", "heterogeneous"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}")
        if self.qmc_iter_limit < 1:
            raise ValueError("qmc_iter_limit is 1 or more")

    @classmethod
    def from_jsonc(cls, text: str) -> Config:
        """From an object with sections, with // and /* */ comments outside strings."""
        bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
        flat, known = {}, {f.name for f in fields(cls)}
        for k, v in json.loads(bare).items():
            section = v if isinstance(v, dict) else {k: v}
            flat |= section
            # A scorer's name may stand before this option, where other options of a run stand beside it.
            named = [x for x in section if re.fullmatch(r"[a-z0-9]+_top1_only", x)]
            if len(named) == 1 and known & section.keys():
                flat.setdefault("top1_only", section[named[0]])
        if "run_mode" in flat:
            flat.setdefault("quartet_assembler", flat["run_mode"])
        return cls(**{k: v for k, v in flat.items() if k in known and v is not None})
