"""Aggregation of quartet weights that arrive in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits
from ..operators.sites import Q

SCHEMA = "block_id long, q0 long, q1 long, q2 long, q3 long, w0 double, w1 double, w2 double"


def read(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Weights of a folder's files, so many in each micro-batch."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def full(stream: DataFrame) -> DataFrame:
    """Running sums and counts of each quartet; the state is three sums and a count."""
    return splits.aggregated(stream, "full")


#: Sums are kept on executors' disks, not in their memory.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run(stream: DataFrame, mode: str, out: str, checkpoint: str) -> DataFrame:
    """Reads the stream to its end and returns its splits.

    full keeps each quartet's sums over all batches as state, and writes those that a batch has changed; the latest of each quartet counts. batch_only aggregates
    each micro-batch and appends; off appends every row. Each batch is written under its number, so a batch that is run again after a failure replaces
    what it wrote, and what is written grows with the batches alone.
    """
    spark = stream.sparkSession

    def append(batch: DataFrame, n: int) -> None:
        rows = batch if mode == "full" else splits.to_splits(splits.aggregated(batch.withColumn("_b", F.lit(n)), mode, "_b"))
        rows.write.mode("overwrite").parquet(f"{out}/batch={n}")

    source = full(stream) if mode == "full" else stream
    before = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    try:
        query = source.writeStream.outputMode("update" if mode == "full" else "append").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE[0], before) if before else spark.conf.unset(STATE_STORE[0])
    found = spark.read.parquet(out)
    if mode != "full":
        return found.drop("batch")
    latest = found.groupBy(*Q).agg(F.max_by(F.struct("s0", "s1", "s2", "n"), "batch").alias("r"))
    return splits.to_splits(latest.select(*Q, "r.*"))
