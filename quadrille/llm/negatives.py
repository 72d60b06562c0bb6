"""Hard negatives by a two-dimensional block product of anchors and all rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import tasks, written
from .blocks import FAN, best, matrix
from .topk import _exact

#: Anchors of a tile, rows of a shard and dimensions of a chunk.
TILE, SHARD, DIMS = 256, 4096, 32
#: Bytes of scores, of 64 bits each, in the tiles of a wave; anchors beyond it are taken up in later waves.
WAVE_BYTES = 1 << 38
#: Components are cut to this range, so that scores of up to 2048 dimensions fit into 64 bits.
MOST = 1 << 26
#: Shards whose scores meet in one call, and bytes, at 64 bits a score, of the parts that do; a tile is cut into strips of so few anchors.
SPAN, MEET_BYTES = 4, 1 << 24
#: Buckets of labels at most; a shard's and a tile's rows are of one bucket.
BUCKETS = 64

_PART = "tile int, shard int, strip int, span int, a_ids binary, a_labels binary, b_ids binary, b_labels binary, scores binary"


def _bytes(values: pa.ChunkedArray | np.ndarray, kind: type = np.int64) -> bytes:
    return np.ascontiguousarray(np.asarray(values), kind).tobytes()


def _ints(blob: pa.Scalar, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), kind)


def _narrow(scores: np.ndarray) -> bytes:
    """Scores in the fewest of 16, 32 or 64 bits that hold them all."""
    low, high = scores.min(), scores.max()
    return _bytes(scores, next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max))


def _packed(rows: DataFrame, block: str, side: str, blocks: int) -> DataFrame:
    """(block, bucket, id, label, v) -> one row for each block and chunk of dimensions: ids, labels, and the chunk's part of the matrix."""

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        whole = np.clip(matrix(rows.column("v")), -MOST, MOST).astype(np.int32)
        ids, labels = _bytes(rows.column("id")), _bytes(rows.column("label"))
        parts = [whole[:, c : c + DIMS] for c in range(0, max(1, whole.shape[1]), DIMS)]
        first = lambda x: pa.array([x] + [None] * (len(parts) - 1), pa.binary())
        same = lambda x: pa.array(np.full(len(parts), x), pa.int32())
        return pa.table({
            block: same(rows.column(block)[0].as_py()), f"{side}_bucket": same(rows.column("bucket")[0].as_py()), "chunk": pa.array(np.arange(len(parts)), pa.int32()), f"{side}_n": same(rows.num_rows),
            f"{side}_ids": first(ids), f"{side}_labels": first(labels), f"{side}_part": pa.array([_bytes(p, np.int32) for p in parts], pa.binary()),
        })

    # A writer holds 100 rows at least before it looks at their size: few blocks go to a file.
    rows = rows.repartition(max(tasks(rows.sparkSession), blocks // 16), block)
    return rows.groupBy(block).applyInArrow(pack, f"{block} int, {side}_bucket int, chunk int, {side}_n int, {side}_ids binary, {side}_labels binary, {side}_part binary")


def _multiplied(strip: int):
    """One chunk's part of the scores of a tile and a shard, in strips of a few anchors; where one side has no such dimensions there are none."""
    kinds = [x.split() for x in _PART.split(", ")]

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return pa.table({n: pa.array([], pa.int32() if k == "int" else pa.binary()) for n, k in kinds})
        get = lambda t, name: t.column(name)[0]
        n, shard = get(a, "a_n").as_py(), get(b, "b_shard").as_py()
        x, y = _ints(get(a, "a_part"), np.int32).reshape(n, -1), _ints(get(b, "b_part"), np.int32).reshape(get(b, "b_n").as_py(), -1)
        w = min(x.shape[1], y.shape[1])
        scores = _exact(x[:, :w].astype(np.float64), y[:, :w].astype(np.float64))
        cuts = range(0, n, strip)
        of = lambda name: [_bytes(_ints(get(a, name))[i : i + strip]) if get(a, name).is_valid else None for i in cuts]
        out = {"tile": [get(a, "a_tile").as_py()] * len(cuts), "shard": [shard] * len(cuts), "strip": [i // strip for i in cuts], "span": [shard // SPAN] * len(cuts), "a_ids": of("a_ids"), "a_labels": of("a_labels")}
        out |= {name: [get(b, name).as_py()] * len(cuts) for name in ("b_ids", "b_labels")} | {"scores": [_narrow(scores[i : i + strip]) for i in cuts]}
        return pa.table({n: pa.array(out[n], pa.int32() if k == "int" else pa.binary()) for n, k in kinds})

    return product


def _added(parts: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids and labels of a strip's anchors, of a shard's rows, their scores) for each shard of a span, from its parts, added up."""
    shards = np.asarray(parts.column("shard"))
    for s in np.unique(shards):
        at = np.flatnonzero(shards == s).tolist()
        lead = next(i for i in at if parts.column("a_ids")[i].is_valid)
        a, la, b, lb = (_ints(parts.column(c)[lead]) for c in ("a_ids", "a_labels", "b_ids", "b_labels"))
        total = np.zeros(len(a) * len(b), np.int64)
        for i in at:
            blob = parts.column("scores")[i].as_buffer()
            total += np.frombuffer(blob, f"i{blob.size // len(total)}")
        yield a, la, b, lb, total.reshape(len(a), len(b))


def _lists(chosen: list[tuple[np.ndarray, ...]], names: tuple[str, ...], **same: int) -> pa.Table:
    cols = [np.concatenate(c) for c in zip((np.empty(0, np.int64),) * len(names), *chosen)]
    return pa.table({k: pa.array(np.full(len(cols[0]), v), pa.int32()) for k, v in same.items()} | dict(zip(names, map(pa.array, cols))))


def _positives(k: int):
    """The k best rows of the same label for each anchor of a strip, of all shards of a span."""

    def found(key: tuple, parts: pa.Table) -> pa.Table:
        near: dict[int, list] = {}
        for a, la, b, lb, scores in _added(parts):
            for i in range(len(a)):
                at = np.flatnonzero((lb == la[i]) & (b != a[i]))
                at = at[best(scores[i, at], b[at], k)]
                near.setdefault(int(a[i]), []).append((b[at], scores[i, at]))
        out = []
        for anchor, some in near.items():
            ids, scores = (np.concatenate(c) for c in zip(*some))
            at = best(scores, ids, k)
            out.append((np.full(len(at), anchor), ids[at], scores[at]))
        return _lists(out, ("anchor_id", "positive_id", "positive_score"), **dict(zip(("tile", "strip", "shard"), (x.as_py() for x in key))))

    return found


def _negatives(k: int, low: int, high: int):
    """For a strip and its anchors' positives, the first k rows of another label within each window of scores, of all shards of a span."""
    whole = lambda x: max(-(1 << 63) + 1, min((1 << 63) - 1, x))

    def found(key: tuple, parts: pa.Table, wanted: pa.Table) -> pa.Table:
        windows: dict[int, list] = {}
        for anchor, row, bound, nth in zip(*(wanted.column(c).to_pylist() for c in ("p_anchor", "p_id", "p_score", "p_nth"))):
            # low * positive <= 100 * score <= high * positive, in whole numbers of any size.
            windows.setdefault(anchor, []).append((nth, row, bound, whole(-(-low * bound // 100)), whole(high * bound // 100)))
        held: dict[int, list] = {}
        for a, la, b, lb, scores in _added(parts) if windows else ():
            for i, anchor in enumerate(a.tolist()):
                if anchor in windows:
                    least, most = min(w[3] for w in windows[anchor]), max(w[4] for w in windows[anchor])
                    at = np.flatnonzero((scores[i] >= least) & (scores[i] <= most) & (lb != la[i]) & (b != anchor))
                    held.setdefault(anchor, []).append((b[at], scores[i, at]))
        out = []
        for anchor, some in held.items():
            ids, scores = (np.concatenate(c) for c in zip(*some))
            at = np.lexsort((ids, -scores))
            ids, scores = ids[at], scores[at]
            for nth, row, bound, least, most in windows[anchor]:
                first, last = np.searchsorted(-scores, -most, "left"), np.searchsorted(-scores, -least, "right")
                own = slice(first, max(first, min(first + k, last)))
                out.append((*(np.full(len(ids[own]), x) for x in (anchor, nth, row, bound)), ids[own], scores[own]))
        return _lists(out, ("anchor_id", "positive_rank", "positive_id", "positive_score", "negative_id", "negative_score"), shard=key[2].as_py())

    return found


def _best(lists: DataFrame, by: list[str], score: str, row: str, k: int, shards: int) -> DataFrame:
    """The k best of each key, with their rank; lists are merged FAN shards at a time."""
    while shards > FAN:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
        part = Window.partitionBy(*by, "shard").orderBy(F.desc(score), row)
        lists = lists.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k).drop("_r")
        shards = math.ceil(shards / FAN)
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), row))).filter(F.col("rank") <= k).drop("shard")


def hard_negatives(
    vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank).

    A score is the integer product of two rows, whose components become floor(scale * x). An anchor's positives are the rows of its label
    that score highest. For each of them its negatives are the rows of other labels, highest first, that score from low to high hundredths of
    the positive's score. Ties go to the smaller id. is_anchor: a condition on the column id.

    Rows are packed into shards and anchors into tiles, of one bucket of labels each, both cut into chunks of DIMS dimensions. A task multiplies one chunk of a tile and a
    shard; these parts of the scores are shuffled in strips of a few anchors and added up, for anchors of WAVE_BYTES of scores at a time. No scores are kept: those of an anchor
    and its own bucket give its positives, those of all rows that may have another label its negatives, within the windows positives set. Where buckets hold one label each, no
    score is made twice. Only short lists leave a strip, and are merged as a tree.

    Rows with a null id or label, or whose vector is null or holds null or non-finite components, take no part. An anchor is never its own
    positive, nor is another row of its id, nor its negative. Of rows that repeat an anchor's id, that of the least label and vector is the anchor; repeated rows are
    candidates each, and of copies of a positive each counts. Vectors of different length are compared as if filled up with zeros. Components beyond +-2^26
    are cut to that. An empty table gives an empty result. Other columns may have any names.
    """
    spark = vectors.sparkSession
    huge = F.lit(float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v")).filter("id is not null and label is not null and v is not null")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < huge))).withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("double")))
    anchors = rows.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    buckets = max(1, min(BUCKETS, rows.count() // SHARD))
    rows, anchors = (x.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(buckets)).cast("int")) for x in (rows, anchors))
    held = {r["bucket"]: r for r in rows.groupBy("bucket").agg(F.count("*").alias("n"), (F.min("label") < F.max("label")).alias("mixed"), F.max(F.size("v")).alias("dims")).collect()}
    asked = {r["bucket"]: r["count"] for r in anchors.groupBy("bucket").count().collect()}
    n, chunks = sum(r["n"] for r in held.values()), max(1, math.ceil(max((r["dims"] for r in held.values()), default=0) / DIMS))
    tiles = _Blocks([math.ceil(asked.get(k, 0) / TILE) for k in range(buckets)])
    least = math.ceil(2 * spark.sparkContext.defaultParallelism / max(1, tiles.total))
    shards = _Blocks([max(math.ceil(r["n"] / SHARD), math.ceil(r["n"] / n * least)) if (r := held.get(k)) else 0 for k in range(buckets)])
    mixed = [bool(held[k]["mixed"]) if k in held else False for k in range(buckets)]
    # Rows go to shards by their place in the table: a repeated id or vector is no key.
    place = F.xxhash64(F.monotonically_increasing_id())
    right = written(_packed(rows.withColumn("b_shard", shards.dealt(F.col("bucket"), place)), "b_shard", "b", shards.total), "negatives-rows")
    left = written(_packed(anchors.withColumn("a_tile", tiles.dealt(F.col("bucket"), F.xxhash64("id"))), "a_tile", "a", tiles.total), "negatives-anchors")

    done = None
    step = max(1, WAVE_BYTES // (8 * TILE * max(1, n)))
    for at in range(0, max(1, tiles.total), step):
        wave = _wave(left, right, (at, min(max(1, tiles.total), at + step) - 1), tiles, shards, mixed, chunks, (positives, negatives, low, high))
        done = wave if done is None else done.unionByName(wave)
    return done


class _Blocks:
    """Numbers of the tiles or shards, bucket by bucket."""

    def __init__(self, counts: list[int]) -> None:
        ends = np.cumsum(counts).tolist()
        self.counts, self.first, self.last, self.total = counts, [e - c for e, c in zip(ends, counts)], [e - 1 for e in ends], ends[-1]

    @staticmethod
    def _of(values: list, bucket: Column) -> Column:
        return F.array(*map(F.lit, values))[bucket]

    def dealt(self, bucket: Column, key: Column) -> Column:
        return (self._of(self.first, bucket) + F.pmod(key, self._of([max(1, c) for c in self.counts], bucket))).cast("int")

    def met(self, bucket: Column, mixed: list[bool] | None, low: int, high: int) -> Column:
        """Of those from low to high: a bucket's own or, with mixed, all others, and its own too if it holds several labels."""
        own = lambda x: (x >= self._of(self.first, bucket)) & (x <= self._of(self.last, bucket))
        return F.filter(F.sequence(F.lit(low), F.lit(high)), lambda x: own(x) if mixed is None else ~own(x) | self._of(mixed, bucket))


def _wave(left: DataFrame, right: DataFrame, of: tuple[int, int], tiles: _Blocks, shards: _Blocks, mixed: list[bool], chunks: int, asked: tuple[int, int, int, int]) -> DataFrame:
    """hard_negatives of the anchors in some tiles, from the first to the last."""
    spark, (positives, negatives, low, high) = right.sparkSession, asked
    left, s = left.filter(F.col("a_tile").between(*of)), max(1, shards.total)
    spans, strip = math.ceil(s / SPAN), max(1, min(TILE, MEET_BYTES // (8 * SHARD * SPAN * chunks)))

    def parts(mixed: list[bool] | None, products: int) -> DataFrame:
        a = left.withColumn("a_shard", F.explode(shards.met(F.col("a_bucket"), mixed, 0, s - 1))).withColumnRenamed("chunk", "a_chunk")
        b = right.withColumn("b_tile", F.explode(tiles.met(F.col("b_bucket"), mixed, *of))).withColumnRenamed("chunk", "b_chunk")
        cells = max(tasks(spark), products // 8)
        each = a.repartition(cells, "a_tile", "a_shard", "a_chunk").groupBy("a_tile", "a_shard", "a_chunk").cogroup(b.repartition(cells, "b_tile", "b_shard", "b_chunk").groupBy("b_tile", "b_shard", "b_chunk")).applyInArrow(_multiplied(strip), _PART)
        return each.repartition(max(tasks(spark), products // 16), "tile", "strip", "span")

    own = sum(shards.counts[k] * max(0, min(of[1], tiles.last[k]) - max(of[0], tiles.first[k]) + 1) for k in range(len(mixed))) * chunks
    near = parts(None, own).groupBy("tile", "strip", "span").applyInArrow(_positives(positives), "tile int, strip int, shard int, anchor_id long, positive_id long, positive_score long")
    near = _best(near, ["anchor_id"], "positive_score", "positive_id", positives, spans)
    wanted = near.select(F.col("tile").alias("p_tile"), F.col("strip").alias("p_strip"), F.col("anchor_id").alias("p_anchor"), F.col("positive_id").alias("p_id"), F.col("positive_score").alias("p_score"), F.col("rank").alias("p_nth"))
    wanted = wanted.withColumn("p_span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))))
    products = s * (of[1] - of[0] + 1) * chunks
    schema = "shard int, anchor_id long, positive_rank long, positive_id long, positive_score long, negative_id long, negative_score long"
    wanted = wanted.repartition(max(tasks(spark), products // 16), "p_tile", "p_strip", "p_span")
    hard = parts(mixed, products).groupBy("tile", "strip", "span").cogroup(wanted.groupBy("p_tile", "p_strip", "p_span")).applyInArrow(_negatives(negatives, low, high), schema)
    hard = _best(hard, ["anchor_id", "positive_rank"], "negative_score", "negative_id", negatives, spans)
    return written(hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("positive_rank").cast("int").alias("positive_rank")), "negatives-found")
