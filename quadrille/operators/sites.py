"""Sites, quartets and site patterns."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import GAP, pattern
from ..sources.tables import written

Q = ("q0", "q1", "q2", "q3")
#: Sites of a cut of the alignment, quartets of a tile without a block, and words of planes that a kernel takes at a time, of one taxon and in all.
CUT, TILE, PART, CHUNK_WORDS = 1 << 22, 1 << 14, 1 << 10, 1 << 18
#: Taxa whose states in a column are one whole number.
WORD = 21


def informative(sites: DataFrame) -> DataFrame:
    """(taxon, pos, state) without positions where all taxa have one state; a gap is a state. Positions are numbered anew.

    Positions are numbered through ranks of the kept positions' runs, so their order is not made in one task.
    """
    kept = sites.groupBy("pos").agg(F.min("state").alias("lo"), F.max("state").alias("hi")).filter("lo < hi").select("pos")
    return sites.join(renumbered(kept, "pos"), "pos").select("taxon", F.col("new").alias("pos"), "state")


def renumbered(values: DataFrame, column: str, run: int = 65536) -> DataFrame:
    """Distinct whole numbers with new, their rank from 0, counted within runs and then over the runs."""
    runs = values.select(column, F.floor(F.col(column) / run).alias("_run"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = runs.groupBy("_run").count().select("_run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_run").orderBy(column)
    return runs.withColumn("_n", F.row_number().over(inside) - 1).join(sizes, "_run").select(column, (F.col("_n") + F.col("_before")).alias("new"))


def quartets(members: DataFrame) -> DataFrame:
    """(block_id, taxon) -> (block_id, q0..q3): every four taxa of a block, in order."""
    m = members.select("block_id", "taxon")
    out = m.withColumnRenamed("taxon", "q0")
    for i in range(1, 4):
        nxt = m.select(F.col("block_id").alias("_b"), F.col("taxon").alias(f"q{i}"))
        out = out.join(nxt, (F.col("block_id") == F.col("_b")) & (F.col(f"q{i}") > F.col(f"q{i - 1}"))).drop("_b")
    return out.select("block_id", *Q)


def block_quartets(blocks: DataFrame) -> DataFrame:
    """(block_id, members ARRAY) -> quartets without any join: index combinations of the array are exploded in place."""
    level = blocks.select("block_id", F.array_sort("members").alias("m"), F.lit(-1).alias("i")).filter(F.size("m") >= 4)
    for k in range(4):
        level = level.withColumn(f"i{k}", F.explode(F.sequence(F.col("i") + 1, F.size("m") - (4 - k)))).withColumn("i", F.col(f"i{k}"))
    return level.select("block_id", *(F.get("m", F.col(f"i{k}")).alias(f"q{k}") for k in range(4)))


def columns(sites: DataFrame, ranks: DataFrame) -> DataFrame:
    """(taxon, pos, state) -> (col, sites): the distinct columns of the alignment, each with the number of its positions. ranks: taxon, new.

    A column is a list of (word, bits), WORD taxa to a word, three bits for each: 1 more than its base, 0 for a gap or where the taxon has no row.
    """
    bits = F.expr(f"shiftleft(cast(state + 1 as bigint), cast(3 * (new % {WORD}) as int))")
    placed = sites.filter(F.col("state") < GAP).join(ranks, "taxon").select("pos", F.floor(F.col("new") / WORD).cast("int").alias("word"), bits.alias("bits"))
    words = placed.groupBy("pos", "word").agg(F.bit_or("bits").alias("bits"))
    return words.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("col")).groupBy("col").agg(F.count("*").alias("sites"))


def site_patterns(quartet_rows: DataFrame, sites: DataFrame) -> DataFrame:
    """(q0..q3) and (taxon, pos, state) -> (q0..q3, pat, n, freq): how often each pattern of four bases occurs.

    Sites meet by position alone, once, and columns that are alike are counted before quartets meet them, so no row of a quartet and a position is shuffled: quartets
    go to the columns, and counts are partly aggregated there. Each quartet should be given once, and each taxon once a position.
    """
    ranks = written(renumbered(sites.select("taxon").distinct(), "taxon"), "ranks")
    quartets = quartet_rows.select(*Q)
    few = quartets.limit(TILE + 1).count() <= TILE
    for i, q in enumerate(Q):
        quartets = quartets.join(ranks.select(F.col("taxon").alias("_t"), F.floor(F.col("new") / WORD).cast("int").alias(f"_w{i}"), (3 * (F.col("new") % WORD)).cast("int").alias(f"_b{i}")), F.col(q) == F.col("_t")).drop("_t")
    met = columns(sites, ranks).select(F.map_from_entries("col").alias("_at"), "sites").crossJoin(F.broadcast(quartets) if few else quartets)
    state = [F.expr(f"cast(shiftright(_at[_w{i}], _b{i}) & 7 as int) - 1").alias(f"s{i}") for i in range(4)]
    out = met.select(*Q, "sites", *state).filter(" and ".join(f"s{i} >= 0" for i in range(4)))
    counted = out.groupBy(*Q, pattern(*(F.col(f"s{i}") for i in range(4))).cast("int").alias("pat")).agg(F.sum("sites").alias("n"))
    total = counted.groupBy(*(F.col(q).alias(f"_{q}") for q in Q)).agg(F.sum("n").alias("total"))
    same = [F.col(q) == F.col(f"_{q}") for q in Q]
    return counted.join(total, same).select(*Q, "pat", "n", (F.col("n") / F.col("total")).alias("freq"))


def planes(sites: DataFrame) -> DataFrame:
    """(taxon, pos, state) -> (cut, taxon, planes): for each base a bit for each site of a cut of CUT sites, 64 to a word; a gap has none."""
    cut = F.floor(F.col("pos") / CUT).cast("int")
    placed = sites.filter(F.col("state").between(0, GAP - 1)).select(cut.alias("cut"), F.col("taxon").cast("long").alias("taxon"), (F.col("pos") - cut * CUT).cast("int").alias("at"), F.col("state").cast("int").alias("state"))

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        at, state = rows.column("at").to_numpy(), rows.column("state").to_numpy()
        bits = np.zeros((GAP, -(-(int(at.max()) + 1) // 64) * 64), bool)
        bits[state, at] = True
        return pa.table({"cut": pa.array([key[0].as_py()], pa.int32()), "taxon": pa.array([key[1].as_py()], pa.int64()), "planes": pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary())})

    return placed.groupBy("cut", "taxon").applyInArrow(packed, "cut int, taxon long, planes binary")


def _words(rows: pa.Table, taxa: np.ndarray, at: slice) -> np.ndarray:
    """(taxa, bases, words): a part of the planes of some taxa; what a taxon lacks, at the end or at all, is zero."""
    held = {t: np.frombuffer(b.as_buffer(), np.uint64).reshape(GAP, -1)[:, at] for t, b in zip(rows.column("taxon").to_pylist(), rows.column("planes")) if b.is_valid}
    out = np.zeros((len(taxa), GAP, max([x.shape[1] for x in held.values()], default=0)), np.uint64)
    for i, t in enumerate(taxa.tolist()):
        if t in held:
            out[i, :, : held[t].shape[1]] = held[t]
    return out


def _parts(rows: pa.Table) -> Iterator[slice]:
    longest = max((len(b.as_buffer()) // (8 * GAP) for b in rows.column("planes") if b.is_valid), default=0)
    return (slice(k, k + PART) for k in range(0, longest, PART))


def block_class_counts(blocks: DataFrame, sites: DataFrame) -> DataFrame:
    """(block_id, members) and sites -> (block_id, q0..q3, c0, c1, c2): for every four members the sites that support each class by two states, two and two.

    A block's taxa, and no others, are sent to its task, as bit planes of one cut of the alignment: half a byte a site. There each pair's sites of equal bases are
    one plane, and a class is what two such planes have in common and a third has not, counted by words. Counts add up over the cuts.
    """
    members = blocks.select("block_id", F.array_sort(F.transform("members", lambda x: x.cast("long"))).alias("members")).filter(F.size("members") >= 4)
    sent = members.select("block_id", "members", F.explode("members").alias("taxon")).join(planes(sites), "taxon", "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    kind = blocks.schema["block_id"].dataType.simpleString()
    counted = sent.groupBy("block_id", "cut").applyInArrow(_classes, f"block_id {kind}, q0 long, q1 long, q2 long, q3 long, c0 long, c1 long, c2 long")
    return counted.groupBy("block_id", *Q).agg(*(F.sum(c).alias(c) for c in ("c0", "c1", "c2")))


def _classes(key: tuple, rows: pa.Table) -> pa.Table:
    taxa = np.array(rows.column("members")[0].as_py(), np.int64)
    q = np.array(list(itertools.combinations(range(len(taxa)), 4)))
    pair = np.zeros((len(taxa), len(taxa)), np.int64)
    i, j = np.triu_indices(len(taxa), 1)
    pair[i, j] = np.arange(len(i))
    ab, cd, ac, bd, ad, bc = (pair[q[:, x], q[:, y]] for x, y in ((0, 1), (2, 3), (0, 2), (1, 3), (0, 3), (1, 2)))
    counts = np.zeros((3, len(q)), np.int64)
    for part in _parts(rows):
        bases = _words(rows, taxa, part)
        equal = np.bitwise_or.reduce(bases[i] & bases[j], 1)
        step = max(1, CHUNK_WORDS // max(1, equal.shape[1]))
        for k in range(0, len(q), step):
            some = slice(k, k + step)
            for c, (x, y, other) in enumerate(((ab, cd, ac), (ac, bd, ab), (ad, bc, ab))):
                counts[c, some] += np.bitwise_count(equal[x[some]] & equal[y[some]] & ~equal[other[some]]).sum(1, dtype=np.int64)
    block = pa.array([key[0].as_py()] * len(q), rows.schema.field("block_id").type)
    return pa.table({"block_id": block} | {c: pa.array(taxa[q[:, k]]) for k, c in enumerate(Q)} | {f"c{k}": pa.array(counts[k]) for k in range(3)})


def pattern_counts(quartet_rows: DataFrame, sites: DataFrame) -> DataFrame:
    """site_patterns by an Arrow kernel: (q0..q3, pat, n). quartet_rows are distinct; a site that a taxon lacks is a gap.

    Quartets are dealt to tiles: by block_id, if they have it, else by hash. Each tile gets its own taxa's bit planes, cut by cut of the alignment. A pattern's
    count is that of the bits that a plane of each of its taxa has; histograms add up over the cuts, and nothing passes through the driver.
    """
    if "block_id" in quartet_rows.columns:
        tile = F.col("block_id").cast("long")
    else:
        count = quartet_rows.count()
        tiles = max(-(-count // TILE), min(count, 2 * sites.sparkSession.sparkContext.defaultParallelism), 1)
        tile = F.pmod(F.xxhash64("q0", "q1"), F.lit(tiles))
    quartets = quartet_rows.select(tile.alias("tile"), *(F.col(q).cast("long").alias(q) for q in Q))
    needed = quartets.select("tile", F.explode(F.array(*Q)).alias("taxon")).distinct()
    sent = needed.join(planes(sites), "taxon")
    cuts = (sites.agg(F.max("pos")).first()[0] or 0) // CUT + 1
    dealt = quartets.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1)))).select(*(F.col(c).alias(f"_{c}") for c in ("cut", "tile", *Q)))
    cells = dealt.groupBy("_tile", "_cut").cogroup(sent.groupBy("tile", "cut")).applyInArrow(_patterns, "q0 long, q1 long, q2 long, q3 long, pat int, n long")
    return cells.groupBy(*Q, "pat").agg(F.sum("n").alias("n"))


def _patterns(quartets: pa.Table, rows: pa.Table) -> pa.Table:
    """Histograms of a tile's quartets over a cut; the planes of its first two taxa's bases are combined once for the quartets that begin alike."""
    ids = np.stack([quartets.column(f"_{q}").to_numpy() for q in Q], 1) if quartets.num_rows else np.empty((0, 4), np.int64)
    ids = ids[np.lexsort(ids.T[::-1])]
    taxa = np.unique(ids)
    q = np.searchsorted(taxa, ids)
    hist = np.zeros((len(q), 256), np.int64)
    for part in _parts(rows) if rows.num_rows else ():
        bases, first = _words(rows, taxa, part), None
        for k, (a, b, c, d) in enumerate(q.tolist()):
            if first != (a, b):
                first, lead = (a, b), (bases[a][:, None] & bases[b][None]).reshape(16, -1)
            pair = (bases[c][:, None] & bases[d][None]).reshape(16, -1)
            for x in range(16):
                hist[k, 16 * x : 16 * x + 16] += np.bitwise_count(lead[x] & pair).sum(1, dtype=np.int64)
    of, pat = np.nonzero(hist)
    return pa.table({c: pa.array(ids[of, i]) for i, c in enumerate(Q)} | {"pat": pa.array(pat.astype(np.int32)), "n": pa.array(hist[of, pat])})


def class_counts(patterns: DataFrame) -> DataFrame:
    """(q0..q3, pat, n) -> (q0..q3, c0, c1, c2): sites that support each class by two states, two and two."""
    s = [F.floor(F.col("pat") / d) % 4 for d in (64, 16, 4, 1)]
    two = lambda a, b, c, d: F.sum(F.when((s[a] == s[b]) & (s[c] == s[d]) & (s[a] != s[c]), F.col("n")).otherwise(0))
    return patterns.groupBy(*Q).agg(two(0, 1, 2, 3).alias("c0"), two(0, 2, 1, 3).alias("c1"), two(0, 3, 1, 2).alias("c2"))


def scores(counts: DataFrame, *keep: str) -> DataFrame:
    """The default scorer: w_k = 100 * (c_k + 1) / (c0 + c1 + c2 + 3), which adds up to 100."""
    total = F.col("c0") + F.col("c1") + F.col("c2") + 3
    return counts.select(*keep, *Q, *((100.0 * (F.col(f"c{k}") + 1) / total).alias(f"w{k}") for k in range(3)))


def shared_taxon_pairs(quartet_rows: DataFrame, least: int = 3) -> DataFrame:
    """(qid, q0..q3) -> (l, r, shared): pairs of quartets with `least` taxa or more in common."""
    taxa = quartet_rows.select("qid", F.explode(F.array(*Q)).alias("taxon"))
    other = taxa.select(F.col("qid").alias("r"), F.col("taxon").alias("_t"))
    pairs = taxa.join(other, (F.col("taxon") == F.col("_t")) & (F.col("qid") < F.col("r")))
    return pairs.groupBy(F.col("qid").alias("l"), "r").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def one_hot(quartet_rows: DataFrame, n: int = 24) -> DataFrame:
    """Quartets with hot, an array of n zeros and ones that marks their taxa."""
    return quartet_rows.withColumn("hot", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(F.array(*Q), i).cast("int")))
