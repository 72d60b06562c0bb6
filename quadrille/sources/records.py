"""Files of records, read in byte ranges that are cut at records: lines, FASTA entries, binary quartets."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file that one partition reads, of a read at a time, and of text in one batch.
SPLIT_BYTES, BLOCK_BYTES, BATCH_BYTES = 64 << 20, 8 << 20, 32 << 20
#: What stands before each record but the first; an entry of FASTA begins behind its >.
SEPARATORS = {"lines": b"\n", "fasta": b"\n>"}
#: A binary record: an unsigned key of four 16-bit ids, and a signed weight.
RECORD = np.dtype([("key", "<u8"), ("w", "<i8")])


def located(path: str) -> tuple[fs.FileSystem, list[tuple[str, int]]]:
    """The file system of a path, and its files with their sizes: itself, or in order of name those of a folder."""
    system, at = fs.FileSystem.from_uri(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return system, [(at, info.size)]
    inside = system.get_file_info(fs.FileSelector(at, recursive=True))
    return system, sorted((f.path, f.size) for f in inside if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def pieces(file, size: int, low: int, high: int, separator: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the pieces between separators that begin from low on and before high; the last may end beyond, at size at the latest."""
    k = len(separator)
    base = max(0, low - k)
    file.seek(base)
    held, at, ended = b"", 0, False

    def more() -> None:
        # Reads double with what is held, so that a long piece is not copied time and again.
        nonlocal held, at, base, ended
        new = file.read(min(max(BLOCK_BYTES, len(held) - at), size - base - len(held)))
        held, base, at, ended = held[at:] + new, base + at, 0, not new

    if low > 0:
        while (i := held.find(separator, at)) < 0 and not ended:
            at = max(at, len(held) - k + 1)
            more()
        if i < 0:
            return
        at = i + k
    seen = at
    while base + at < min(high, size):
        i = held.find(separator, seen)
        if i >= 0:
            yield base + at, held[at:i]
            at = seen = i + k
        elif ended:
            yield base + at, held[at:]
            return
        else:
            seen = max(at, len(held) - k + 1) - at
            more()


@dataclass
class Range(InputPartition):
    number: int
    path: str
    size: int
    low: int
    high: int


class RecordReader(DataSourceReader):
    """Options: path, kind (lines, fasta or binary), split; start and stop, between which a single file counts; count, for one row a range; firsts, the number of each range's
    first record; until, a byte at which the counting ends; positive and int32 for binary records."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.kind = self.options["kind"]

    def partitions(self) -> list[Range]:
        _, files = located(self.options["path"])
        step, out = int(self.options.get("split", SPLIT_BYTES)), []
        if self.kind == "binary":
            step = max(1, step // RECORD.itemsize) * RECORD.itemsize
        for path, size in files:
            if self.kind == "binary" and size % RECORD.itemsize:
                raise ValueError(f"{path} ends within a record")
            start, size = int(self.options.get("start", 0)), min(size, int(self.options.get("stop", size)))
            cuts = [*range(start, max(size, start + 1), step), size]
            out += [Range(len(out) + k, path, size, a, b) for k, (a, b) in enumerate(itertools.pairwise(cuts))]
        return out

    def _pieces(self, r: Range) -> Iterator[tuple[int, bytes]]:
        """The records of a range: lines that are not blank, or entries of FASTA; what stands before the first entry is none."""
        system, _ = fs.FileSystem.from_uri(self.options["path"])
        start = int(self.options.get("start", 0))
        with system.open_input_file(r.path) as file:
            if r.low == start and start:
                # The first piece begins where the file is to begin, not behind a separator.
                file = _From(file, start)
                found = ((at + start, x) for at, x in pieces(file, r.size - start, 0, r.high - start, SEPARATORS[self.kind]))
            else:
                found = pieces(file, r.size, r.low, r.high, SEPARATORS[self.kind])
            for at, x in found:
                if self.kind == "fasta":
                    if at or x.startswith(b">"):
                        yield at, x if at else x[1:]
                elif x.strip():
                    yield at, x

    def read(self, r: Range) -> Iterator[pa.RecordBatch]:
        if self.kind == "binary":
            yield from self._quartets(r)
            return
        if self.options.get("count"):
            until, n, stop = self.options.get("until", "").encode(), 0, -1
            for at, x in self._pieces(r):
                if until and (i := x.find(until)) >= 0:
                    n, stop = n + bool(x[:i].strip()), at + i
                    break
                n += 1
            yield pa.RecordBatch.from_pydict({"part": pa.array([r.number], pa.int32()), "records": pa.array([n], pa.int64()), "stop": pa.array([stop], pa.int64())})
            return
        n, texts, held = json.loads(self.options["firsts"]), [], 0
        # Behind the range in which the reading ends no record begins.
        n = n[min(r.number, len(n) - 1)]
        batch = lambda: pa.RecordBatch.from_pydict({"n": pa.array(np.arange(n - len(texts), n), pa.int64()), "value": pa.array(texts, pa.string())})
        for _, x in self._pieces(r):
            if texts and held + len(x) > BATCH_BYTES:
                yield batch()
                texts, held = [], 0
            texts.append(x.decode())
            held, n = held + len(x), n + 1
        if texts:
            yield batch()

    def _quartets(self, r: Range) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.options["path"])
        with system.open_input_file(r.path) as file:
            file.seek(r.low)
            left = r.high - r.low
            while left:
                rows = np.frombuffer(file.read(min(left, BLOCK_BYTES)), RECORD)
                left -= rows.nbytes
                rows = rows[rows["w"] > 0] if self.options.get("positive") else rows[rows["w"] != 0]
                if self.options.get("int32") and len(rows) and not (-(1 << 31) < rows["w"].min() and rows["w"].max() < 1 << 31):
                    raise ValueError(f"{r.path} has a weight of more than 32 bits")
                ids = {k: ((rows["key"] >> np.uint64(s)) & np.uint64(65535)).astype(np.int32) for k, s in zip("abcd", (48, 32, 16, 0))}
                yield pa.RecordBatch.from_pydict(ids | {"w": rows["w"].astype(np.int64)})


class _From:
    """A file from an offset on."""

    def __init__(self, file, start: int):
        self.file, self.start, self.read = file, start, file.read

    def seek(self, at: int) -> None:
        self.file.seek(self.start + at)


class RecordSource(DataSource):
    """spark.read.format("records"), see RecordReader."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        if self.options["kind"] == "binary":
            return "a int, b int, c int, d int, w long"
        return "part int, records long, stop long" if self.options.get("count") else "n long, value string"

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)


def source(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    spark.dataSource.register(RecordSource)
    return spark.read.format("records").options(path=path, kind=kind, split=SPLIT_BYTES, **options).load()


def records(spark: SparkSession, path: str, kind: str, start: int = 0, until: str = "") -> tuple[DataFrame, int]:
    """((n, value), number of records): the records of one file, numbered in its order, from `start` to the first `until`, if given.

    A first pass counts the records of each range, so that the second numbers them as it reads: no record is shuffled or sorted.
    """
    _, files = located(path)
    if len(files) != 1:
        raise ValueError(f"one file is to be read, {path} has {len(files)}")
    counts = sorted(tuple(r) for r in source(spark, path, kind, count="true", start=start, until=until).collect())
    last = next((i for i, c in enumerate(counts) if c[2] >= 0), len(counts) - 1)
    firsts = [0, *itertools.accumulate(c[1] for c in counts[: last + 1])]
    stop = counts[last][2] if counts and counts[last][2] >= 0 else files[0][1]
    rows = source(spark, path, kind, start=start, stop=stop, firsts=json.dumps(firsts[:-1] or [0]))
    return rows, firsts[-1]


def head(path: str, least: int = 1 << 16) -> Iterator[bytes]:
    """The beginning of a file, read further and further: `least` bytes, then twice as many, up to the whole."""
    system, files = located(path)
    with system.open_input_file(files[0][0]) as file:
        size = least
        while True:
            file.seek(0)
            got = file.read(size)
            yield got
            if len(got) >= files[0][1]:
                return
            size *= 2
