"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written  # noqa: F401

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text handled at a time inside a Python worker; a longer single document is handled alone.
SLICE_BYTES = 1 << 20


def dropped(df: DataFrame) -> None:
    """Removes the files of a table made by written(), once nothing reads it any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, over all its tasks; what it holds must follow from its key."""
    held = sys.modules.setdefault("_worker_caches", types.ModuleType("_worker_caches"))
    return held.__dict__.setdefault(name, {})


def released() -> None:
    """Gives memory that this worker has freed back to the system: workers outlive tasks, and Spark keeps several."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow; freed memory is given back after each of its batches and at the end of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                released()

        try:
            yield from f(passed())
        finally:
            released()

    return run


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `size` bytes of text each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = np.cumsum(sizes) // size
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(start of each document's words, with the end added; code of each word; distinct words as binary)."""
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    flat = pc.list_flatten(lists).cast(pa.large_binary())
    real = np.asarray(pc.not_equal(pc.binary_length(flat), 0))
    owner = np.repeat(np.arange(len(counts)), counts)[real]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    starts = np.searchsorted(owner, np.arange(len(counts) + 1))
    return starts, np.asarray(coded.indices).astype(np.int64), coded.dictionary


def hashes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(v, seed) for v in values.to_pylist()), np.uint64, len(values))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(words: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` word hashes within a document, and each document's start among them, with the end added.

    A polynomial in an odd base over wrapping 64-bit integers, scrambled.
    """
    n = len(words) - width + 1
    counts = np.maximum(np.diff(starts) - width + 1, 0)
    out_starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    if n <= 0:
        return np.empty(0, np.uint64), out_starts
    base, total = np.uint64(0x9E3779B97F4A7C15), np.zeros(n, np.uint64)
    for k in range(width):
        total = total * base + words[k : k + n]
    at = np.arange(out_starts[-1]) + np.repeat(starts[:-1] - out_starts[:-1], counts)
    return mixed(total[at]), out_starts


def lists_of(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of the runs of values."""
    return pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), pa.array(values, kind)).cast(pa.list_(kind))
