"""Point-in-time joins: the version that was in force, and known, at the time of a question."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import dropped, tasks, written

#: A chunk of a key's time is 1 << CHUNK units; versions valid for longer are in chunks of twice the length, or four times, and so on.
CHUNK = 10
#: Versions of one chunk that meet in one join; a chunk of more is cut into parts by hash, each of which all its questions ask. Rows of a bin of chunks.
PART, BIN = 1 << 18, 1 << 18


def _cells(questions: pa.Table, versions: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's cell (key, level, chunk, part), for questions and versions alike."""
    keys = pa.chunked_array([*questions.column("q_key").chunks, *versions.column("v_key").chunks]).combine_chunks().dictionary_encode()
    rest = [np.concatenate([np.asarray(questions.column(f"q_{c}")), np.asarray(versions.column(f"v_{c}"))]).astype(np.int64) for c in ("level", "chunk", "part")]
    cell = np.unique(np.stack([np.asarray(keys.indices).astype(np.int64), *rest]), axis=1, return_inverse=True)[1].ravel()
    return cell[: questions.num_rows], cell[questions.num_rows :]


def _joined(questions: pa.Table, versions: pa.Table) -> pa.Table:
    """The best version of each question of one bin, by DuckDB's sorted join on two inequalities.

    The cells of the bin lie end to end on one line, each with a stretch as long as its chunk, and versions are cut to their chunk: one join over start
    and expiry serves all cells, without a condition on keys. Of the versions it finds, arg_max takes that of the highest priority.
    """
    fields = {"key": questions.schema.field("q_key").type, "at": pa.int64(), "version": versions.schema.field("version").type}
    if not (questions.num_rows and versions.num_rows):
        return pa.table({n: pa.array([], t) for n, t in fields.items()})
    whole = lambda t, c: np.asarray(t.column(c)).astype(np.int64)
    of_q, of_v = _cells(questions, versions)
    size = np.zeros(max(of_q.max(), of_v.max()) + 1, np.int64)
    size[of_q], size[of_v] = 1 << (CHUNK + whole(questions, "q_level")), 1 << (CHUNK + whole(versions, "v_level"))
    begin = np.cumsum(size) - size
    q_low, v_low = whole(questions, "q_chunk") * size[of_q], whole(versions, "v_chunk") * size[of_v]
    version = versions.column("version").combine_chunks()
    priority = np.empty(len(version), np.int64)
    columns = {n: pc.struct_field(version, n) for n in ("event", "arrival", "id")} | {"expiry": versions.column("expiry").combine_chunks()}
    priority[np.asarray(pc.sort_indices(pa.table(columns), sort_keys=[(n, "ascending") for n in columns], null_placement="at_start"))] = np.arange(len(version))
    with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as con:
        # Without thresholds the join is the sorted one for a few rows, too.
        con.execute("SET merge_join_threshold = 0; SET nested_loop_join_threshold = 0")
        con.register("questions", pa.table({"i": np.arange(len(of_q)), "at": begin[of_q] + whole(questions, "at") - q_low}))
        con.register("versions", pa.table({
            "i": np.arange(len(of_v)), "start": begin[of_v] + np.maximum(whole(versions, "start") - v_low, 0),
            "expiry": begin[of_v] + np.minimum(whole(versions, "expiry") - v_low, size[of_v]), "priority": priority,
        }))
        got = con.sql("SELECT q.i AS q, arg_max(v.i, v.priority) AS v FROM questions q JOIN versions v ON v.start <= q.at AND v.expiry > q.at GROUP BY q.i").to_arrow_table()
    q, v = got.column("q").combine_chunks(), got.column("v").combine_chunks()
    return pa.table({"key": questions.column("q_key").combine_chunks().take(q), "at": questions.column("at").combine_chunks().take(q), "version": version.take(v)})


def point_in_time(questions: DataFrame, versions: DataFrame, key: str, at: str, event: str, arrival: str, expiry: str, id_col: str, payload: tuple[str, ...] = ()) -> DataFrame:
    """(question, version): each question as it was, with the version of its key that is in force at its time; null where none is.

    at, event, arrival and expiry are whole numbers of one unit. A version is usable at a time t with event <= t and arrival <= t < expiry. The latest
    event wins, then the latest arrival, then the largest id, then the latest expiry, then the largest payload. version holds event, arrival, id and the payload's columns.

    The answer depends on key and time alone, so each such pair is asked once; of versions of one key, start and expiry the best alone is kept: both
    are combined before they are shuffled. A key's time is cut into chunks, a version is in the two chunks at most that it overlaps, and
    questions and versions of a chunk meet in one of many bins. A chunk of very many versions is dealt to parts, whose answers are merged. So no
    key, however frequent, is one task's work, and nothing goes to the driver but counts.

    Versions with a null key, event, arrival or expiry are never usable; a null id is the smallest. Questions with a null key or time have no version. Repeated rows
    of either kind change nothing but the number of answers: each question row has one. Columns of any names may be there. Empty tables are no special case. Times and
    validities are to be below 2^50 units.
    """
    asked = questions.select(F.struct("*").alias("question"), F.col(key).alias("key"), F.col(at).cast("long").alias("at"))
    v = versions.select(F.col(key).alias("key"), F.col(event).cast("long").alias("event"), F.col(arrival).cast("long").alias("arrival"), F.col(expiry).cast("long").alias("expiry"), F.col(id_col).cast("long").alias("id"), F.struct(*payload).alias("payload") if payload else F.lit(0).alias("payload"))
    v = v.dropna(subset=["key", "event", "arrival", "expiry"]).withColumn("start", F.greatest("event", "arrival")).filter("start < expiry")
    v = v.groupBy("key", "start", "expiry").agg(F.max(F.struct("event", "arrival", "id", "payload")).alias("version"))
    # The level is the number of binary digits of what the validity has beyond one chunk.
    over = F.shiftright(F.col("expiry") - F.col("start") - 1, CHUNK)
    v = v.withColumn("level", F.when(over == 0, 0).otherwise(F.length(F.bin(over))))
    of = lambda time: F.expr(f"shiftright({time}, {CHUNK} + level)")
    v = written(v.withColumn("chunk", F.explode(F.sequence(of("start"), of("expiry - 1")))), "asof-versions")
    sizes = v.groupBy("key", "level", "chunk").agg(F.count("*").alias("n"))
    known = sizes.groupBy("level").agg(F.max("n").alias("most"), F.sum("n").alias("n")).collect()
    levels = [r["level"] for r in known] or [0]
    q = asked.select("key", "at").dropna().distinct().withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    q = written(q.withColumn("chunk", of("at")), "asof-questions")

    if any(r["most"] > PART for r in known):
        sizes = sizes.select("key", "level", "chunk", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
        v2 = v.join(sizes, ["key", "level", "chunk"]).withColumn("part", F.pmod(F.xxhash64("start", "expiry"), "parts").cast("int"))
        q2 = q.join(sizes, ["key", "level", "chunk"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    else:
        v2, q2 = (t.withColumn("part", F.lit(0)) for t in (v, q))
    bins = max(tasks(v.sparkSession), -(-(sum(r["n"] for r in known) + q.count()) // BIN))
    place = F.pmod(F.xxhash64("key", "level", "chunk", "part"), F.lit(bins)).cast("int")
    left = q2.select(place.alias("q_bin"), F.col("key").alias("q_key"), F.col("level").alias("q_level"), F.col("chunk").alias("q_chunk"), F.col("part").alias("q_part"), "at")
    right = v2.select(place.alias("v_bin"), F.col("key").alias("v_key"), F.col("level").alias("v_level"), F.col("chunk").alias("v_chunk"), F.col("part").alias("v_part"), "start", "expiry", "version")
    kind = f"key {left.schema['q_key'].dataType.simpleString()}, at long, version {right.schema['version'].dataType.simpleString()}"
    best = left.repartition(bins, "q_bin").groupBy("q_bin").cogroup(right.repartition(bins, "v_bin").groupBy("v_bin")).applyInArrow(_joined, kind)
    best = best.groupBy("key", "at").agg(F.max("version").alias("version"))
    # Rows that no version can match are spread by a number of their own.
    asked = asked.withColumn("_at", F.when(F.col("key").isNull() | F.col("at").isNull(), F.monotonically_increasing_id()).otherwise(F.col("at")))
    best = best.select(F.col("key").alias("_k"), F.col("at").alias("_t"), "version")
    names = [f"version.payload.{c}" for c in payload]
    done = asked.join(best, (F.col("key") == F.col("_k")) & (F.col("_at") == F.col("_t")), "left")
    version = F.when(F.col("version").isNotNull(), F.struct("version.event", "version.arrival", "version.id", *names))
    return done.select("question", version.alias("version"))


def status(age: Column, stale: int) -> Column:
    """none without a version, stale beyond that age, else fresh."""
    return F.when(age.isNull(), "none").when(age > stale, "stale").otherwise("fresh")
