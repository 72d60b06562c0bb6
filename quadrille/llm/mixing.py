"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, n_words, written

#: Weights that the sources take in turn, in order of name.
WEIGHTS = (5, 2, 1)
#: No source, and so no document, is taken more often than this.
MOST = 3
#: Keys are placed on a line of 1 << PLACES points, and a source's points are cut into 1 << STEP bins, again and again, until the bin
#: that holds the source's cut has at most EDGE rows; only that bin is sorted.
PLACES, STEP, EDGE = 50, 10, 1 << 17
#: Sources up to which the plan, a short row for each, is broadcast; beyond, it is joined by shuffle.
PLANNED = 1 << 16
#: Copies of one document that one task writes.
CHUNK = 256


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target).

    The weights share the total size; a target stops at `most` times the source's size and the excess is
    shared anew by weight. With the sources in order of cap / weight the level that all open sources reach
    follows from running sums, so no loop is needed. One row per source: the only data that meet in one task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    n = F.row_number().over(by_name)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((n - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * most
    up = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, onward = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    every = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(every)["level"])
        .select("source", "source_size", "weight", F.when(F.col("ratio") > F.col("level"), F.col("level") * F.col("weight")).otherwise(F.col("cap").cast("double")).alias("target"))
    )


def quality(text: Column) -> Column:
    """A document's sampling weight: the share of letters among characters that aren't white space, 0.05 at least."""
    solid = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    marks = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D\p{L}]+", ""))
    return F.greatest(F.lit(0.05), F.coalesce((solid - marks) / F.when(solid > 0, solid), F.lit(0.05)))


def _measured(text: Column, doc_id: Column, seed: str) -> tuple[Column, Column]:
    """(size, key): words, and an Efraimidis-Spirakis key, an exponential variate over the quality weight."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return n_words(text), -F.log(u) / quality(text)


def _point(key: Column) -> Column:
    """A key's place on the line: in order of key, from 0 up to 1 << PLACES."""
    return F.floor(key / (1 + key) * float(1 << PLACES)).cast("long")


#: A row's place in its source's order.
ME = ("key", "doc_id", "size")


def _plan(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, doc_id, size, key, copies) -> a row for each source: s, source_size, target, epochs, cut, left.

    Rows before `cut` are in the sampled part; the rows at it have `left` words in it; without a cut no row is.
    """
    line = rows.withColumn("all", F.col("size") * F.col("copies")).withColumn("point", _point(F.col("key")))
    wanted = targets(line.groupBy("source").agg(F.sum("all").alias("source_size")), weights, most)
    epochs = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)).cast("int")
    gap = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    plan = written(wanted.withColumn("epochs", epochs).select(F.col("source").alias("s"), "source_size", "target", "epochs", gap.alias("gap")), "mix-plan")
    joined = _by_source(plan)
    # Cuts: for each source the bin, as the first bits of its points, that holds the cut, and the words before it.
    cuts = plan.filter("gap > 0").select("s", "gap", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("before"))
    shift = PLACES
    while shift > 0:
        shift -= STEP
        inside = joined(line, cuts).filter(F.shiftright("point", shift + STEP) == F.col("bin"))
        sums = inside.groupBy("s", "gap", "before", F.shiftright("point", shift).alias("bin")).agg(F.sum("all").alias("words"), F.count("*").alias("n"))
        up = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        placed = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(up), F.lit(0)))
        found = placed.filter(F.col("before") + F.col("words") >= F.col("gap")).groupBy("s", "gap").agg(F.min_by(F.struct("bin", "before", "n"), "bin").alias("e"))
        cuts = written(found.select("s", "gap", "e.bin", "e.before", "e.n"), "mix-cuts")
        if cuts.filter(F.col("n") > EDGE).isEmpty():
            break
    order = Window.partitionBy("s").orderBy(*ME).rowsBetween(Window.unboundedPreceding, -1)
    edge = joined(line, cuts).filter(F.shiftright("point", shift) == F.col("bin")).withColumn("left", F.col("gap") - F.col("before") - F.coalesce(F.sum("all").over(order), F.lit(0)))
    cut = edge.filter(F.col("left").between(1, F.col("all"))).groupBy("s").agg(F.min(F.struct(*ME, "left")).alias("c"))
    cut = cut.select(F.col("s").alias("c_s"), F.struct(*(F.col(f"c.{x}").alias(x) for x in ME)).alias("cut"), "c.left")
    return written(plan.join(cut, F.col("s").eqNullSafe(F.col("c_s")), "left").select("s", "source_size", "target", "epochs", "cut", "left"), "mix-plan")


def _by_source(plan: DataFrame):
    """A join of rows with a table of the plan's sources; broadcast if these are few, so that a large source isn't dealt to one task."""
    few = plan.count() <= PLANNED
    return lambda rows, other: rows.join(F.broadcast(other) if few else other, F.col("source").eqNullSafe(F.col("s")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix-1") -> DataFrame:
    """(doc_id, text, source) -> (doc_id, source, size, source_size, target, epochs, taken): how much of each document the mix takes.

    A source with target T and size S is taken whole floor(T / S) times; the rest R is sampled without
    replacement after Efraimidis and Spirakis: a document's key is an exponential variate, made from a digest of
    seed, doc_id and text, over its quality weight; in ascending order of key, documents are taken until R words are reached,
    the last of them in part. So a source's taken words are the whole part of its target, unless the source has no words.

    Where R is reached is found on sums of key bins, so no task gets a whole source. Nulls: a
    null text has size 0; null sources are one source, last in order; a null doc_id has the key of an empty string. Rows that agree in
    source, doc_id and text are documents of their own that follow each other in the order, so the cut may fall between
    them. Other columns are not read. An empty table gives an empty result. Documents of size 0 are taken 0 words.
    """
    size, key = _measured(F.col("text"), F.col("doc_id"), seed)
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), key.alias("key"))
    rows = written(each.groupBy("source", *ME).agg(F.count("*").alias("copies")), "mix-sizes")
    plan = _plan(rows, weights, most)
    me, nth = F.struct(*ME), F.col("n")
    at = F.when(F.col("left") >= nth * F.col("size"), F.col("size")).otherwise(F.greatest(F.lit(0), F.col("left") - (nth - 1) * F.col("size")))
    sampled = F.when(F.col("cut").isNull(), F.lit(0)).when(me < F.col("cut"), F.col("size")).when(me == F.col("cut"), at).otherwise(F.lit(0))
    return (
        _by_source(plan)(rows, plan)
        .withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs") + sampled).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix-1") -> DataFrame:
    """The documents that the mix takes, each as often as it is taken; the columns stay, whatever their names.

    A document taken in part, one a source at most, is there once more as its first words, joined by a space. Of rows that agree
    in source, doc_id and text and of which the cut takes some, any are taken. Nulls, ties, repeated rows and empty
    tables are as in mix(). Documents without words have nothing to take and go.
    """
    size, key = _measured(F.col("text"), F.col("doc_id"), seed)
    held = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    each = docs.select(held, F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), key.alias("key")).filter("size > 0")
    rows = written(each.groupBy("source", *ME).agg(F.count("*").alias("copies")), "mix-sizes")
    plan = _plan(rows, weights, most)
    me = F.struct(*ME)
    found = _by_source(plan)(each, plan)
    whole = found.withColumn("times", F.col("epochs") + F.coalesce(me < F.col("cut"), F.lit(False)).cast("int")).filter("times > 0")
    whole = whole.select(F.explode(F.sequence(F.lit(1), F.col("times"))), "row").select("row.*")
    # At the cut all rows are alike. One of them stands for those that are taken, and its copies are dealt evenly.
    last = found.filter(me == F.col("cut")).groupBy("source").agg(F.first("row").alias("row"), F.first("size").alias("size"), F.first("left").alias("left"))
    full, part = F.floor(F.col("left") / F.col("size")), (F.col("left") % F.col("size")).cast("int")
    chunks = last.filter(full > 0).select("row", full.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((full - 1) / CHUNK))).alias("chunk"))
    some = chunks.repartition("chunk").select("row", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("n")) - 1))).select("row.*")
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), 0), 1, part), " ")
    rest = last.filter(part > 0).select(*(cut.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
    return whole.unionAll(some).unionAll(rest)
