"""Quartet graphs, bipartitions and their scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import canonical
from ..sources.tables import written

SPLIT = ("a", "b", "c", "d")
#: Packed splits: to a row, so that a batch of 10 000 rows has 61 MB, and handled at a time in a task; places whose sums meet in one call.
CHUNK, SLICE, RUN = 1 << 8, 1 << 18, 1 << 11
_PACKED = "sub_id long, n int, q binary, w binary"


def quartet_graph(splits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, c, d, w) -> (i, j, good, bad): pairs across a split are good to cut, pairs within bad."""
    edge = lambda x, y, good: F.struct(F.least(x, y).alias("i"), F.greatest(x, y).alias("j"), F.lit(good).alias("good"))
    edges = F.array(edge("a", "b", False), edge("c", "d", False), *(edge(x, y, True) for x in "ab" for y in "cd"))
    rows = splits.select(*by, F.explode(edges).alias("e"), "w").select(*by, "e.*", "w")
    part = lambda good: F.sum(F.when(F.col("good") == good, F.col("w")).otherwise(0))
    return rows.groupBy(*by, "i", "j").agg(part(True).alias("g"), part(False).alias("bad")).select(*by, "i", "j", F.col("g").alias("good"), "bad")


def edge_matrix(graph: DataFrame, column: str) -> DataFrame:
    """One kind of edge over the smallest weight above 1, as the debug output has it."""
    least = graph.agg(F.min(F.when(F.col(column) > 1, F.col(column))).alias("least"))
    return graph.crossJoin(F.broadcast(least)).select("i", "j", (F.col(column) / F.coalesce("least", F.lit(1))).alias("w"))


def with_sides(splits: DataFrame, sides: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Splits with xa..xd, the side (0 or 1) of each of their taxa. sides: by, taxon, side."""
    out = splits
    for x in SPLIT:
        s = sides.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("taxon").alias("_t"), F.col("side").alias(f"x{x}"))
        same = [F.col(c) == F.col(f"_{c}") for c in by] + [F.col(x) == F.col("_t")]
        out = out.join(s, same).drop("_t", *(f"_{c}" for c in by))
    return out


def status():
    """Of a split with sides: satisfied, violated, deferred (three on one side) or same (all on one side)."""
    xa, xb, xc, xd = (F.col(f"x{x}") for x in SPLIT)
    total = xa + xb + xc + xd
    return F.when((total == 0) | (total == 4), "same").when(total != 2, "deferred").when(xa == xb, "satisfied").otherwise("violated")


def cut_scores(splits: DataFrame, sides: DataFrame) -> DataFrame:
    """(status, n, w) of the splits under a bipartition."""
    return with_sides(splits, sides).groupBy(status().alias("status")).agg(F.count("*").alias("n"), F.sum("w").alias("w"))


def divided(splits: DataFrame, sides: DataFrame, artificial, sizes: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One level of division: (by, side, a, b, c, d, w), equal splits added up.

    Splits on one side stay there; of three on one side the lone taxon becomes the artificial one (a column) and, with sizes
    (by, side, n), the weight is divided by the size of the side it stands for; two and two are dropped.
    """
    rows = with_sides(splits, sides, by).withColumn("k", sum((F.col(f"x{x}") for x in "bcd"), F.col("xa"))).filter("k <> 2")
    side = (F.col("k") > 2).cast("int")
    rows = rows.withColumn("side", side).withColumn("lone", F.col("k").isin(1, 3))
    if sizes is not None:
        z = sizes.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("side").alias("_side"), F.col("n").alias("_n"))
        rows = rows.join(z, [F.col(c) == F.col(f"_{c}") for c in by] + [F.col("_side") == 1 - F.col("side")])
        rows = rows.withColumn("w", F.when(F.col("lone"), F.col("w") / F.col("_n")).otherwise(F.col("w")))
    named = [F.when(F.col("lone") & (F.col(f"x{x}") != F.col("side")), artificial).otherwise(F.col(x)) for x in SPLIT]
    return rows.select(*by, "side", canonical(*named).alias("s"), "w").select(*by, "side", "s.*", "w").groupBy(*by, "side", *SPLIT).agg(F.sum("w").alias("w"))


# ---- bipartitions of one subproblem, in memory -------------------------------------------------------------------


def _statuses(side: np.ndarray) -> np.ndarray:
    """Per split: 1 satisfied, -1 violated, 0 otherwise; side: (splits, 4)."""
    k = side.sum(1)
    two = k == 2
    return np.where(two, np.where(side[:, 0] == side[:, 1], 1, -1), 0)


def first_sides(quartets: np.ndarray, n: int, whole: bool = True) -> np.ndarray | None:
    """A bipartition to start from: splits in the order given place their unplaced taxa with their pair, else across; the rest balance.

    Not whole: the splits are the first of more, which hold all taxa; None if they leave a taxon unplaced.
    """
    side, missing = np.full(n, -1, np.int8), len(np.unique(quartets)) if whole else n
    for q in quartets:
        if not missing:
            break
        a, b, c, d = q
        placed = side[q] >= 0
        if placed.all():
            continue
        before = int(placed.sum())
        if not before:
            side[[a, b]], side[[c, d]] = 0, 1
            missing -= 4
            continue
        for pair, other in (((a, b), (c, d)), ((c, d), (a, b))):
            for x, mate in (pair, pair[::-1]):
                if side[x] < 0 and side[mate] >= 0:
                    side[x] = side[mate]
            if side[pair[0]] < 0 and (known := [y for y in other if side[y] >= 0]):
                side[list(pair)] = 1 - side[known[0]]
        missing -= int((side[q] >= 0).sum()) - before
    if missing and not whole:
        return None
    for x in np.flatnonzero(side < 0):
        zeros, ones = (side == 0).sum(), (side == 1).sum()
        side[x] = 0 if zeros < ones else 1
    return side


#: By the sides of a split's four taxa, as bits, and the place of the taxon that moves: what its status gains, and whether it is satisfied then.
_SIDES = np.arange(16)[:, None] >> np.arange(4) & 1
_AFTER = np.stack([_statuses(np.where(np.arange(4) == i, 1 - _SIDES, _SIDES)) for i in range(4)], axis=1)
_GAIN, _THEN = (_AFTER - _statuses(_SIDES)[:, None]).astype(float), (_AFTER == 1).astype(float)
#: How these four change for each taxon by a move: a row for each 4 * sides + place.
_GAIN_BY, _THEN_BY = ((table[np.arange(16)[:, None] ^ 1 << np.arange(4)] - table[:, None]).reshape(64, 4) for table in (_GAIN, _THEN))


def _passes(side: np.ndarray, begin, change) -> np.ndarray:
    """The rule of refined(). begin(side): what each taxon's move gains, and how much is satisfied then; change(side, t, gain, then): adds to these what the move of t changes."""
    while True:
        gain, then = begin(side)
        count = np.bincount(side, minlength=2)
        moves, total, best, keep = [], 0.0, 0.0, 0
        while True:
            able = gain if count.min() > 2 else np.where((count > 2)[side], gain, -np.inf)
            if (most := able.max()) == -np.inf:
                break
            able = np.flatnonzero(able == most)
            t = int(able[np.argmax(then[able])])
            total += gain[t]
            change(side, t, gain, then)
            count[side[t]] -= 1
            side[t] = 1 - side[t]
            count[side[t]] += 1
            # A taxon moves once a pass.
            gain[t] = -np.inf
            moves.append(t)
            if total >= best and total >= 0:
                best, keep = total, len(moves)
        for t in moves[keep:]:
            side[t] = 1 - side[t]
        if best <= 1e-9:
            return side


def refined(quartets: np.ndarray, weights: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Passes of single moves. Each pass moves every taxon that may, best gain first, and keeps the best prefix of its moves.

    The score is the weight of satisfied minus violated splits. Ties go to the larger satisfied weight after the move, then to
    the earlier taxon. A side keeps two taxa at least. Passes go on while they gain. Gains are kept per taxon; a move
    changes those of the taxa of the moved taxon's splits, by what these splits' patterns of sides gave before and give after it.
    """
    n = len(side)
    order = np.argsort(quartets.ravel(), kind="stable")
    starts = np.searchsorted(quartets.ravel()[order], np.arange(n + 1)).tolist()
    rows_of, place_of = order // 4, order % 4
    pattern = np.empty(len(quartets), np.int64)
    sums = lambda table: np.bincount(quartets.ravel(), (weights[:, None] * table[pattern]).ravel(), n)

    def begin(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pattern[:] = (side[quartets].astype(np.int64) << np.arange(4)).sum(1)
        return sums(_GAIN), sums(_THEN)

    def change(side: np.ndarray, t: int, gain: np.ndarray, then: np.ndarray) -> None:
        rows, own = rows_of[starts[t] : starts[t + 1]], place_of[starts[t] : starts[t + 1]]
        was = pattern[rows]
        pattern[rows] = was ^ (1 << own)
        taxa, w, key = quartets[rows].ravel(), weights[rows, None], 4 * was + own
        for values, table in ((gain, _GAIN_BY), (then, _THEN_BY)):
            np.add.at(values, taxa, (w * table[key]).ravel())

    return _passes(side, begin, change)


def _summed(rows: DataFrame, side: np.ndarray, t: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Sums over splits that lie in many tasks: of gains, or of their changes by the move of t. A task adds up its own, and only these sums, one a taxon, are merged."""
    n = len(side)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, n))
        for batch in batches:
            q = np.stack([batch.column(x).to_numpy() for x in SPLIT], 1).astype(np.int64)
            w = batch.column("w").to_numpy()[:, None]
            pattern = (side[q].astype(np.int64) << np.arange(4)).sum(1)
            after = pattern if t is None else pattern ^ ((q == t) << np.arange(4)).sum(1)
            for k, table in enumerate((_GAIN, _THEN)):
                value = table[pattern] if t is None else table[after] - table[pattern]
                total[k] += np.bincount(q.ravel(), (w * value).ravel(), n)
        some = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_pydict({"taxon": pa.array(some, pa.int32()), "gain": pa.array(total[0, some]), "then": pa.array(total[1, some])})

    found = rows.mapInArrow(add_up, "taxon int, gain double, then double").groupBy("taxon").agg(F.sum("gain").alias("gain"), F.sum("then").alias("then")).toPandas()
    out = np.zeros((2, n))
    out[:, found["taxon"]] = found[["gain", "then"]].to_numpy().T
    return out[0], out[1]


def sides_by_moves(splits: DataFrame, first: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """(taxa, sides) of one subproblem by fm_bipartition's rule, with its splits (a, b, c, d, w) left in many tasks.

    The heaviest splits place the taxa, as many as that takes. Splits are kept once as they are and once for each of their taxa, in order of that taxon: a move reads
    those of the taxon that moves, and the driver merges sums, as many as there are taxa. A pass reads all splits five times, whatever the number of moves.
    """
    taxa = np.array(sorted(r["taxon"] for r in splits.select(F.explode(F.array(*SPLIT)).alias("taxon")).distinct().collect()), np.int64)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(pa.array(np.searchsorted(taxa, batch.column(x).to_numpy()).astype(np.int32)) for x in SPLIT), batch.column("w")], [*SPLIT, "w"])

    rows = splits.select(*(F.col(x).cast("long").alias(x) for x in SPLIT), F.col("w").cast("double").alias("w"))
    rows = written(rows.mapInArrow(numbered, "a int, b int, c int, d int, w double"), "moves-splits")
    held = rows.withColumn("taxon", F.explode(F.array(*SPLIT))).repartitionByRange("taxon", F.xxhash64(*SPLIT)).sortWithinPartitions("taxon")
    held = written(held, "moves-held")
    side, total = None, rows.count()
    while side is None:
        top = rows.orderBy(F.desc("w"), *SPLIT).limit(first).toPandas()
        side = first_sides(top[list(SPLIT)].to_numpy(np.int64), len(taxa), first >= total)
        first *= 4
    _at_least_two(side)

    def change(side: np.ndarray, t: int, gain: np.ndarray, then: np.ndarray) -> None:
        for values, more in zip((gain, then), _summed(held.filter(F.col("taxon") == t), side.copy(), t)):
            values += more

    return taxa, _passes(side, lambda side: _summed(rows, side.copy(), None), change)


# ---- splits of many subproblems, packed ---------------------------------------------------------------------------


class Level:
    """The subproblems of a level, in order of number, and their taxa, in order, end to end. A taxon's place is its number there. The driver holds one number a taxon."""

    def __init__(self, taxa: dict[int, np.ndarray]) -> None:
        self.subs = np.array(sorted(taxa), np.int64)
        self.starts = np.cumsum([0, *(len(taxa[s]) for s in self.subs.tolist())])
        self.ids = np.concatenate([np.empty(0, np.int64), *(taxa[s] for s in self.subs.tolist())])
        self.own = np.repeat(np.arange(len(self.subs), dtype=np.int32), np.diff(self.starts))

    def part(self, k: int) -> slice:
        return slice(int(self.starts[k]), int(self.starts[k + 1]))

    def places(self, k: int, taxa: np.ndarray) -> np.ndarray:
        """Places of taxa of the k-th subproblem."""
        ids = self.ids[self.part(k)]
        low, high = int(ids[0]), int(ids[-1])
        if high - low > 4 * len(ids) + 1024:
            return (np.searchsorted(ids, taxa) + self.starts[k]).astype(np.int32)
        table = np.zeros(high - low + 1, np.int32)
        table[ids - low] = np.arange(self.starts[k], self.starts[k + 1])
        return table[taxa - low]


def _blobs(sub: int, q: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    """Splits of one subproblem, CHUNK to a row."""
    cuts = np.minimum(np.arange(-(-len(q) // CHUNK) + 1) * CHUNK, len(q)).astype(np.int32)
    blob = lambda x, size: pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts * np.int32(size)), pa.py_buffer(x.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts) - 1, sub)), pa.array(np.diff(cuts)), blob(q, 4 * q.itemsize), blob(w, 8)], ["sub_id", "n", "q", "w"])


def _unblobbed(batches: Iterator[pa.RecordBatch], kind: type = np.int32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, or taxa of 64 bits, weights), SLICE splits at a time."""

    def values(column: pa.Array, kind: type) -> np.ndarray:
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)

    for batch in batches:
        if batch.num_rows:
            q, w = values(batch.column("q"), kind).reshape(-1, 4), values(batch.column("w"), np.float64)
            for at in range(0, len(q), SLICE):
                yield q[at : at + SLICE], w[at : at + SLICE]


def packed(splits: DataFrame, level: Level | None = None) -> DataFrame:
    """(sub_id, a, b, c, d, w) -> (sub_id, n, q, w): splits in rows of CHUNK, by their taxa's places, or, without a level, by their taxa. Written, as it is read again and again."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, q, w = batch.column("sub_id").to_numpy(), np.stack([batch.column(x).to_numpy() for x in SPLIT], 1), batch.column("w").to_numpy()
            for s in np.unique(own):
                here = own == s
                yield _blobs(s, level.places(int(np.searchsorted(level.subs, s)), q[here]) if level else q[here], w[here])

    rows = splits.select(F.col("sub_id").cast("long").alias("sub_id"), *(F.col(x).cast("long").alias(x) for x in SPLIT), F.col("w").cast("double").alias("w"))
    return written(rows.mapInArrow(pack, _PACKED), "packed-splits")


def taxa_of(held: DataFrame) -> np.ndarray:
    """The taxa, in order, of splits that are packed by taxa."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.empty(0, np.int64)
        for q, _ in _unblobbed(batches, np.int64):
            low, high = int(q.min()), int(q.max())
            if high - low > 4 * q.size:
                some = np.unique(q)
            else:
                there = np.zeros(high - low + 1, bool)
                there[q - low] = True
                some = np.flatnonzero(there) + low
            seen = np.union1d(seen, some)
        yield pa.RecordBatch.from_pydict({"taxon": pa.array(seen, pa.int64())})

    return np.sort(held.mapInArrow(found, "taxon long").distinct().toArrow().column("taxon").to_numpy())


def numbered(held: DataFrame, level: Level) -> DataFrame:
    """Splits of a level's one subproblem, packed by taxa, packed by places."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, w in _unblobbed(batches, np.int64):
            yield _blobs(level.subs[0], level.places(0, q), w)

    return written(held.mapInArrow(number, _PACKED), "packed-splits")


def unpacked(held: DataFrame, level: Level, subs: list[int]) -> DataFrame:
    """(sub_id, a, b, c, d, w) of some subproblems, each split's taxa in order; equal ones are not added up."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, w in _unblobbed(batches):
            pairs = np.sort(level.ids[q].reshape(-1, 2, 2), axis=2)
            swap = pairs[:, 0, 0] > pairs[:, 1, 0]
            pairs[swap] = pairs[swap][:, ::-1]
            four = pairs.reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(level.subs[level.own[q[:, 0]]]), *(pa.array(four[:, k]) for k in range(4)), pa.array(w)], ["sub_id", *SPLIT, "w"])

    return held.filter(F.col("sub_id").isin(subs)).mapInArrow(unpack, "sub_id long, a long, b long, c long, d long, w double")


def children(held: DataFrame, level: Level, side: np.ndarray, cut: dict[int, tuple[int, int, int]], following: Level, sizes: np.ndarray | None = None) -> DataFrame:
    """divided() of packed splits, without a shuffle: those of the next level, by its places; equal ones are not added up.

    side: of each place; cut: subproblem -> its artificial taxon and the numbers of its children. sizes: (subproblems of the level, 2), by which weights are divided.
    """
    place, made, known = np.zeros(len(side), np.int32), np.zeros((len(level.subs), 2), np.int32), np.isin(level.subs, list(cut))
    for k in np.flatnonzero(known).tolist():
        artificial, *numbers = cut[int(level.subs[k])]
        for x, number in enumerate(numbers):
            at, here = int(np.searchsorted(following.subs, number)), level.starts[k] + np.flatnonzero(side[level.part(k)] == x)
            place[here] = following.places(at, level.ids[here])
            made[k, x] = following.places(at, np.array([artificial]))[0]

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, w in _unblobbed(batches):
            x, own = side[q], level.own[q[:, 0]]
            ones = x.sum(1)
            keep = (ones != 2) & known[own]
            q, w, x, own, ones = q[keep], w[keep], x[keep], own[keep], ones[keep]
            to = (ones > 2).astype(np.int8)
            new, moved = place[q], x != to[:, None]
            lone = moved.any(1)
            new[moved] = made[own[lone], to[lone]]
            if sizes is not None:
                w = np.where(lone, w / sizes[own, 1 - to], w)
            child = following.own[new[:, 0]]
            for c in np.unique(child).tolist():
                yield _blobs(following.subs[c], new[child == c], w[child == c])

    return written(held.filter(F.col("sub_id").isin(list(cut))).mapInArrow(divide, _PACKED), "packed-splits")


def _gains(held: DataFrame, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of packed splits: what each place's move gains, and the score of the splits whose first taxon it is. A task adds up its own, and sums meet in runs of places."""
    n, status = len(side), _statuses(_SIDES).astype(float)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, n))
        for q, w in _unblobbed(batches):
            x = side[q]
            pattern = x[:, 0] | x[:, 1] << 1 | x[:, 2] << 2 | x[:, 3] << 3
            for k in range(4):
                total[0] += np.bincount(q[:, k], w * _GAIN[pattern, k], n)
            total[1] += np.bincount(q[:, 0], w * status[pattern], n)
        runs = [at for at in range(0, n, RUN) if total[:, at : at + RUN].any()]
        yield pa.RecordBatch.from_pydict({"at": pa.array(runs, pa.int32()), "sums": pa.array([total[:, at : at + RUN].tobytes() for at in runs], pa.binary())})

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in rows.column("sums"))
        return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    found = held.mapInArrow(add_up, "at int, sums binary").groupBy("at").applyInArrow(meet, "at int, sums binary").toArrow()
    out = np.zeros((2, n))
    for at, sums in zip(found.column("at").to_pylist(), found.column("sums")):
        out[:, at : at + RUN] = np.frombuffer(sums.as_buffer()).reshape(2, -1)
    return out[0], out[1]


def _tried(side: np.ndarray, gain: np.ndarray, share: float) -> tuple[np.ndarray | None, float, int]:
    """(sides, share, moves): the share of the taxa whose moves gain, best first, moved at once; less, if a side would keep fewer than two taxa. None if no move is left."""
    able = np.flatnonzero(gain > 1e-9)
    able = able[np.argsort(-gain[able], kind="stable")]
    while len(able):
        some = able[: max(1, int(len(able) * share))]
        moved = side.copy()
        moved[some] = 1 - moved[some]
        if np.bincount(moved, minlength=2).min() >= 2:
            return moved, share, len(some)
        if len(some) == 1:
            able = able[1:]
        share /= 4
    return None, share, 0


def sides_by_rounds(splits: DataFrame, enough: float = 1e-4) -> DataFrame:
    """(sub_id, a, b, c, d, w) -> (sub_id, taxon, side) of all subproblems at once, with their splits left in many tasks.

    From sides drawn at random, of equal size, many taxa move in a round: all whose moves gain, or, where the score of a subproblem fell, a fourth of them, the best ones,
    and so on down to one, which always gains. A round is one job that reads all splits, whatever the number of taxa and subproblems; it ends in one sum a
    taxon. A subproblem is done when no move gains, or a round gained less than `enough` of its score. The score is that of refined(), whose moves may also lose for a while.
    """
    spark = splits.sparkSession
    places = splits.select(F.col("sub_id").cast("long").alias("sub_id"), F.explode(F.array(*(F.col(x).cast("long") for x in SPLIT))).alias("taxon")).distinct().toArrow().sort_by([("sub_id", "ascending"), ("taxon", "ascending")])
    subs, starts = np.unique(places.column("sub_id").to_numpy(), return_index=True)
    level = Level(dict(zip(subs.tolist(), np.split(places.column("taxon").to_numpy(), starts[1:]))))
    side = rounds(packed(splits, level), level, subs.tolist(), enough)
    return spark.createDataFrame(pa.table({"sub_id": places.column("sub_id"), "taxon": places.column("taxon"), "side": pa.array(side.astype(np.int32))}))


def rounds(held: DataFrame, level: Level, subs: list[int], enough: float = 1e-4) -> np.ndarray:
    """The sides that sides_by_rounds finds, of packed splits, for each place of these subproblems; 0 for others."""
    side = np.zeros(len(level.ids), np.int8)
    for k in np.searchsorted(level.subs, subs).tolist():
        part = level.part(k)
        side[part] = np.random.default_rng(1).permutation(part.stop - part.start) % 2
    some = lambda live: held.filter(F.col("sub_id").isin(level.subs[sorted(live)].tolist()))
    live, share = set(np.searchsorted(level.subs, subs).tolist()), np.ones(len(level.subs))
    gain, score = _gains(some(live), side)
    while live:
        tried, moves = side.copy(), {}
        for k in sorted(live):
            own = level.part(k)
            moved, share[k], moves[k] = _tried(side[own], gain[own], share[k])
            if moved is None:
                live.discard(k)
            else:
                tried[own] = moved
        if not live:
            break
        next_gain, next_score = _gains(some(live), tried)
        for k in sorted(live):
            own = level.part(k)
            was, now = score[own].sum(), next_score[own].sum()
            if now > was:
                side[own], gain[own], score[own], share[k] = tried[own], next_gain[own], next_score[own], min(1.0, 2 * share[k])
                if now - was < enough * abs(now):
                    live.discard(k)
            elif moves[k] == 1:
                live.discard(k)
            else:
                share[k] /= 4
    return side


def merged(q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Splits with their taxa in order, equal ones added up."""
    if not len(q):
        return q, w
    taxa, at = np.unique(q, return_inverse=True)
    pairs = np.sort(at.reshape(-1, 2, 2), axis=2)
    swap = pairs[:, 0, 0] > pairs[:, 1, 0]
    pairs[swap] = pairs[swap][:, ::-1]
    size = len(taxa)
    if size**4 < 1 << 63:
        # A split as one number, in the same order as its taxa.
        key = np.ravel_multi_index(tuple(pairs.reshape(-1, 4).T), (size,) * 4)
        each, first, where = np.unique(key, return_index=True, return_inverse=True)
        rows = pairs.reshape(-1, 4)[first]
    else:
        rows, where = np.unique(pairs.reshape(-1, 4), axis=0, return_inverse=True)
    return taxa[rows], np.bincount(where.ravel(), w, len(rows))


def fm_bipartition(quartets: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Sides of n taxa. quartets: (splits, 4) of taxon numbers."""
    order = np.lexsort((*quartets.T[::-1], -weights))
    quartets, weights = quartets[order], weights[order].astype(float)
    side = first_sides(quartets, n)
    _at_least_two(side)
    return refined(quartets, weights, side)


def _at_least_two(side: np.ndarray) -> None:
    for s in (0, 1):
        while len(side) >= 4 and (side == s).sum() < 2:
            side[np.flatnonzero(side != s)[-1]] = s


def graph_matrices(quartets: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    good, bad = np.zeros((n, n)), np.zeros((n, n))
    for x, y, m in ((0, 1, bad), (2, 3, bad), (0, 2, good), (0, 3, good), (1, 2, good), (1, 3, good)):
        np.add.at(m, (quartets[:, x], quartets[:, y]), weights)
    return good + good.T, bad + bad.T


def max_cut(weight: np.ndarray, rng: np.random.Generator, tries: int) -> tuple[float, np.ndarray]:
    """The best of several local searches over single moves and swaps."""
    n = len(weight)
    best = (-np.inf, np.zeros(n, np.int8))
    for _ in range(max(1, tries)):
        x = rng.choice([-1.0, 1.0], n)
        # pull: each taxon's weight to its own side less that to the other, which a move changes by one column.
        pull = weight @ x
        for _ in range(20 * n):
            gain = x * pull
            t = int(np.argmax(gain))
            if gain[t] > 1e-9:
                x[t] = -x[t]
                pull += 2 * x[t] * weight[:, t]
                continue
            swap = np.where(x[:, None] != x[None, :], gain[:, None] + gain[None, :] + 2 * weight, -np.inf)
            i, j = np.unravel_index(int(np.argmax(swap)), swap.shape)
            if swap[i, j] <= 1e-9:
                break
            x[[i, j]] = -x[[i, j]]
            pull = weight @ x
        value = float((weight * (x[:, None] != x[None, :])).sum() / 2)
        if value > best[0] + 1e-12:
            best = value, (x > 0).astype(np.int8)
    return best


def qmc_bipartition(quartets: np.ndarray, weights: np.ndarray, n: int, iter_limit: int = 3, seed: int = 1) -> np.ndarray | None:
    """Sides of n taxa by max-cut of their splits' graph."""
    return qmc_cut(*graph_matrices(quartets, weights.astype(float), n), iter_limit, seed)


def qmc_cut(good: np.ndarray, bad: np.ndarray, iter_limit: int = 3, seed: int = 1) -> np.ndarray | None:
    """Sides by max-cut of (good - alpha * bad) over its mean size. alpha is bisected in [0, 6] to a width of 0.1.

    The last alpha with a cut of 0.001 or more and two taxa on either side counts; None if there is none.
    """
    n = len(good)
    low, high, found = 0.0, 6.0, None
    rng = np.random.default_rng(seed)
    while high - low > 0.1:
        alpha = (low + high) / 2
        w = good - alpha * bad
        mean = np.abs(w[np.triu_indices(n, 1)]).mean()
        value, side = max_cut(w / mean if mean > 0 else w, rng, 8 * iter_limit)
        if value >= 0.001 and 2 <= side.sum() <= n - 2:
            found, low = side, alpha
        else:
            high = alpha
    return found


def bipartitions(splits: DataFrame, method: str = "qfm", iter_limit: int = 3, seed: int = 1) -> DataFrame:
    """(sub_id, a, b, c, d, w) -> (sub_id, taxon, side): each subproblem's bipartition; none where max-cut finds no cut.

    Max-cut needs a subproblem's graph only, whose edges are summed before they meet: taxa squared, however many splits. Moves of single
    taxa need the splits themselves.
    """
    rows = splits.select("sub_id", *(F.col(x).cast("long").alias(x) for x in SPLIT), F.col("w").cast("double").alias("w"))

    def cut(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pair = ["i", "j"] if method == "qmc" else list(SPLIT)
        held, weights = rows[pair].to_numpy(), None
        if method != "qmc":
            held, weights = merged(held, rows["w"].to_numpy(float))
        taxa, at = np.unique(held, return_inverse=True)
        at = at.reshape(-1, len(pair))
        if method == "qmc":
            good, bad = np.zeros((2, len(taxa), len(taxa)))
            for m, name in ((good, "good"), (bad, "bad")):
                m[at[:, 0], at[:, 1]] = m[at[:, 1], at[:, 0]] = rows[name].to_numpy(float)
            side = qmc_cut(good, bad, iter_limit, seed)
        else:
            side = fm_bipartition(at, weights, len(taxa))
        return pd.DataFrame({"sub_id": key[0], "taxon": taxa if side is not None else [], "side": side if side is not None else []})

    each = quartet_graph(rows, ("sub_id",)) if method == "qmc" else rows
    return each.groupBy("sub_id").applyInPandas(cut, "sub_id long, taxon long, side int")
