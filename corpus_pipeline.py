"""A corpus from documents to token ids, in stages that are each written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import mixing, neardup, spm, substring, toxicity
from quadrille.llm._common import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go; it learns from the labels beside the table.

    Rows are judged one by one, so repeated ones alike. A null or empty text has no toxic term and stays; texts are read whole. Without toxic
    labels all rows stay. An empty table stays empty. All columns stay, whatever their names.
    """
    model = toxicity.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the least id stays.

    Rows without an id, null texts and texts without words are like no others and stay. Of rows that agree in id and text one stays; rows of one
    id with different texts are documents of their own. An empty table stays empty. All columns stay, whatever their names.
    """
    return neardup.deduplicated(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of a smaller id has are cut out.

    A document of which no word is left goes; one that had none, a null text too, stays. A null id is smaller than any; rows of one id
    don't cut each other. Texts of any length are read whole. An empty table stays empty. All columns stay, whatever their names.
    """
    return substring.cleaned(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last of a source in part.

    Null sources are one source. Documents without words, null texts too, have nothing to take and go. Ties in the order of keys go by id and
    size; repeated rows are documents of their own. An empty table stays empty. All columns stay, whatever their names.
    """
    return mixing.mixed_documents(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of each document with the source spans of their pieces, and a digest of the text decoded from them.

    A null text is encoded as an empty one: its end id only. Rows are encoded one by one, repeated ones alike, whole whatever their length. An
    empty table stays empty. Other columns go, so no names clash.
    """
    done = spm.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("lang", "source"))
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "begins", "ends", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("substrings", without_repeats),
    ("mix", mixed),
    ("sentencepiece", tokenised),
]

#: SQL can express neither the learned scores nor the signatures; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
