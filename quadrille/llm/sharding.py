"""Sharding of whole groups by a minimax contiguous partition; DataFrame functions only."""

from __future__ import annotations

import bisect
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import dropped, tasks, written

#: Shards of a data set, and bytes that a document takes besides its text.
SHARDS, EXTRA = 24, 8
#: Groups of one run of the order; rows of a group that are numbered together are those of one block of 1 << BLOCK rows of the table.
RUN, BLOCK = 1 << 14, 16
#: Groups of at least this part of an even share come first.
BIG = 4
#: Bins of the first summary of the groups' ends, and of each stretch that is looked at again.
BINS, FINER = 1 << 14, 1 << 10


class Ends:
    """What is known of the ends of the groups, as ordered cells (least end, greatest end); a cell of one end is known exactly."""

    def __init__(self):
        self.lo, self.hi = [0], [0]

    def put(self, first: int, last: int, cells: list[tuple[int, int]]) -> None:
        """The cells between two ends, in place of those before."""
        a, b = bisect.bisect_left(self.lo, first), bisect.bisect_right(self.lo, last)
        self.lo[a:b], self.hi[a:b] = [c[0] for c in cells], [c[1] for c in cells]

    def floor(self, x: int) -> tuple[int, int]:
        """Bounds of the greatest end that is x or less."""
        i = bisect.bisect_right(self.lo, x) - 1
        return (self.hi[i], self.hi[i]) if self.hi[i] <= x else (self.lo[i], x)

    def path(self, at: int, capacity: int, shards: int, high: bool) -> list[int]:
        """The cuts of shards filled one after the other, each as far as the capacity allows; high: as far as may be, else as is sure."""
        cuts, end = [], self.hi[-1]
        while len(cuts) < shards and at < end:
            at = self.floor(at + capacity)[high]
            cuts.append(at)
        return cuts

    def least(self, at: int, shards: int, high: bool) -> int:
        """The least capacity with which the groups beyond `at` go into so many shards."""
        end = self.hi[-1]
        low, top = -(-(end - at) // shards), end - at
        while low < top:
            mid = (low + top) // 2
            if self.path(at, mid, shards, high)[-1:] == [end]:
                top = mid
            else:
                low = mid + 1
        return low

    def open(self, at: int, shards: int) -> tuple[int, list[tuple[int, int]]]:
        """(least capacity, stretches in which ends must be known better before it and its cuts are exact)."""
        low, top = self.least(at, shards, True), self.least(at, shards, False)
        sure, may = self.path(at, low, shards, False), self.path(at, top, shards, True)
        found = []
        for k in range(min(len(sure), len(may))):
            a, b = (sure[k - 1] if k else at) + low, (may[k - 1] if k else at) + top
            i, j = bisect.bisect_right(self.lo, a) - 1, bisect.bisect_right(self.lo, b)
            vague = [c for c in range(i, j) if self.lo[c] < self.hi[c] and self.hi[c] > a]
            if vague and (low < top or sure != may):
                found.append((self.lo[vague[0]], self.hi[vague[-1]]))
        return top, found


def _merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _looked(placed: DataFrame, ends: Ends, stretches: list[tuple[int, int]], least: int) -> None:
    """Cuts each stretch into bins, four for each cell known there and `least` at least, and keeps the least and the greatest end of each.

    These are bounded rows, whatever the number of groups.
    """
    end, case, used = F.col("end"), None, 0
    for a, b in stretches:
        bins = max(least, 4 * (bisect.bisect_right(ends.lo, b) - bisect.bisect_left(ends.lo, a)))
        bin_ = F.floor((end - a) / F.lit(-(-(b - a + 1) // bins))) + used
        used += bins
        case = F.when(end.between(a, b), bin_) if case is None else case.when(end.between(a, b), bin_)
    some = placed.filter(reduce(lambda x, y: x | y, (end.between(a, b) for a, b in stretches)))
    rows = sorted((r["lo"], r["hi"]) for r in some.groupBy(case.alias("bin")).agg(F.min("end").alias("lo"), F.max("end").alias("hi")).collect())
    for a, b in stretches:
        ends.put(a, b, rows[bisect.bisect_left(rows, (a,)) : bisect.bisect_left(rows, (b + 1,))])


def cuts(placed: DataFrame, total: int, shards: int) -> list[int]:
    """Where the shards end: a minimax contiguous partition of groups, given by their ends on one line.

    The least capacity that suffices is found by bisection, checked greedily, on a summary of the ends: the least and greatest end of each bin.
    Where the summary leaves the capacity or a cut open, these stretches are binned again, finer, until both are exact. A shard that begins with
    a big group may set the capacity alone, so it is found anew for what follows it.
    """
    ends = Ends()
    _looked(placed, ends, [(1, total)], BINS)
    big = sorted(r["end"] for r in placed.filter("big").select("end").collect())
    at, found = 0, []
    while at < total:
        capacity, vague = ends.open(at, shards - len(found))
        if vague:
            _looked(placed, ends, _merged(vague), FINER)
            continue
        way = ends.path(at, capacity, shards - len(found), True)
        alone = bool(big) and at < big[-1]
        found += way[:1] if alone else way
        at = found[-1]
    return found


def sharded(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """(document, size, shard, slot): whole documents in shards of nearly equal bytes; document is the row as it was.

    Documents of equal text are one group, which no cut divides. Groups lie on one line in order of their texts' digests, so that a shard is a
    mixture; those of a quarter of an even share or more come first, the largest at the head. The line is cut by cuts(). slot numbers a
    shard's documents from 0 without gaps. size is the UTF-8 bytes of the text and 8 more.

    A group may hold any share of the rows: its rows are numbered by blocks of the table, then within each. A null text counts as an empty one.
    Repeated rows each have a slot of their own. A text larger than an even share has a shard to itself; then, and with fewer groups than shards,
    some shards are smaller or empty. Columns of any name may be there, as they stay within document. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    row = F.monotonically_increasing_id()
    rows = docs.select(F.struct("*").alias("document"), F.unhex(F.sha2(whole, 256)).alias("digest"), (F.octet_length(whole).cast("long") + EXTRA).alias("size"), row.alias("row"))
    rows = written(rows, "shard-rows").withColumn("block", F.shiftright("row", BLOCK))
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    if not total["n"]:
        return rows.select("document", "size", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))

    runs = max(4 * tasks(spark), -(-total["n"] // RUN))
    big = F.col("bytes") * BIG * shards >= total["bytes"]
    lead = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).withColumn("big", big)
    groups = written(groups.withColumn("run", F.when(F.col("big"), F.lit(-1)).otherwise(F.floor(lead * runs / (1 << 32)))), "shard-groups")
    order = Window.partitionBy("run").orderBy(F.when(F.col("big"), -F.col("bytes")).otherwise(0), "digest")
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = groups.groupBy("run").agg(F.sum("bytes").alias("b"), F.sum("n").alias("k"))
    starts = sums.select("run", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("b", "k")))
    ordered = groups.select("run", "digest", "big", F.sum("bytes").over(order).alias("upto"), (F.sum("n").over(order) - F.col("n")).alias("ahead"))
    placed = written(ordered.join(starts, "run").select("digest", "big", (F.col("b") + F.col("upto")).alias("end"), (F.col("k") + F.col("ahead")).alias("first")), "shard-ends")
    dropped(groups)

    limits = cuts(placed, total["bytes"], shards)
    shard = reduce(lambda x, y: x + y, ((F.col("end") > c).cast("int") for c in limits[:-1]), F.lit(0))
    placed = placed.withColumn("shard", shard)
    heads = {r["shard"]: r["head"] for r in placed.groupBy("shard").agg(F.min("first").alias("head")).collect()}
    head = F.element_at(F.array(*(F.lit(heads.get(k, 0)).cast("long") for k in range(len(limits)))), F.col("shard") + 1)

    inside = Window.partitionBy("digest").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("digest", "block").agg(F.count("*").alias("n")).select("digest", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("before"))
    blocks = blocks.join(placed, "digest").select("digest", "block", "shard", (F.col("first") + F.col("before") - head).alias("base"))
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("digest", "block").orderBy("row")) - 1)
    return numbered.join(blocks, ["digest", "block"]).select("document", "size", "shard", (F.col("base") + F.col("k")).alias("slot"))


def write_shards(done: DataFrame, path: str) -> None:
    """Parquet files of sharded(), one folder a shard, in order of slots within each file."""
    done.repartitionByRange(tasks(done.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
