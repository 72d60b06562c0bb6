"""Chat formatting: every speaker in turn as the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a dialogue whose offsets are summed together; longer dialogues are cut into such runs.
RUN = 256


def _rank(c: DataFrame) -> DataFrame:
    """Adds k, a turn's place in its dialogue from 0, without dealing a whole dialogue to one task.

    Turns are placed by (turn, role, text), nulls first. Numbers within a run of turn values are added to
    the sizes of the runs before it; null turns are a run of their own, before all others.
    """
    runs = c.withColumn("run", F.floor(F.col("turn") / RUN))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = runs.groupBy("conv_id", "run").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("conv_id", "run").orderBy("turn", "role", "text")
    k = runs.withColumn("k", F.row_number().over(inside) - 1)
    same = k["conv_id"].eqNullSafe(sizes["conv_id"]) & k["run"].eqNullSafe(sizes["run"])
    return k.join(sizes, same).select(*[k[x] for x in c.columns], (k["k"] + sizes["before"]).alias("k"))


def segment(speaker: Column, role: Column, text: Column) -> tuple[Column, Column]:
    """(header, body) of a turn: the speaker's own as the assistant's, the system's as such, others' under their name."""
    header = (
        F.when(role == speaker, F.lit("<|im_start|>assistant\n"))
        .when(role == "system", F.lit("<|im_start|>system\n"))
        .otherwise(F.concat(F.lit("<|im_start|>user name="), F.coalesce(role, F.lit("unknown")), F.lit("\n")))
    )
    return header, F.concat(F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def rotated(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> for each dialogue and participant, its rendered turns.

    Columns: conv_id, speaker (who is the assistant), k (place of the turn, from 0), turn, role, segment (the rendered turn),
    seg_start, mask_start, mask_end (offsets in characters within the dialogue as rendered for that speaker; a
    model trained on it learns from mask_start up to mask_end: the body of the speaker's own turns with its end mark. For
    other turns both are the segment's end). The segments of a dialogue and speaker, in order of k, joined, are the dialogue.

    Participants are the distinct roles of a dialogue other than null and system. A dialogue without any has no rows. A null
    role is named unknown, a null text is empty, a null turn comes first, null conv_ids are one dialogue. Repeated rows
    are turns of their own. Texts are kept whole. An empty table gives an empty result.

    A dialogue may hold any share of the rows: offsets are summed within runs of RUN turns, then over the runs.
    """
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    people = c.filter("role is not null and role <> 'system'").groupBy("conv_id", F.col("role").alias("speaker")).agg(F.lit(1).alias("one")).select(F.col("conv_id").alias("p"), "speaker")
    header, body = segment(F.col("speaker"), F.col("role"), F.col("text"))
    rows = (
        _rank(c)
        .join(people, F.col("conv_id").eqNullSafe(F.col("p")))
        .select("conv_id", "speaker", "k", "turn", "role", header.alias("header"), body.alias("body"))
        .withColumn("run", F.floor(F.col("k") / RUN))
        .withColumn("len", (F.length("header") + F.length("body")).cast("long"))
    )
    key = ("conv_id", "speaker")
    before = Window.partitionBy(*key).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(*key, "run").agg(F.sum("len").alias("sum")).withColumn("offset", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum")
    inside = Window.partitionBy(*key, "run").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("at", F.coalesce(F.sum("len").over(inside), F.lit(0)))
    same = local["conv_id"].eqNullSafe(runs["conv_id"]) & (local["speaker"] == runs["speaker"]) & (local["run"] == runs["run"])
    start = local["at"] + runs["offset"]
    own = F.coalesce(local["role"] == local["speaker"], F.lit(False))
    return local.join(runs, same).select(
        local["conv_id"], local["speaker"], "k", "turn", "role", F.concat("header", "body").alias("segment"), start.alias("seg_start"),
        (start + F.when(own, F.length("header")).otherwise(F.col("len"))).cast("long").alias("mask_start"), (start + F.col("len")).alias("mask_end"),
    )


def dialogues(segments: DataFrame) -> DataFrame:
    """(conv_id, speaker, text): each rendered dialogue as one string, for dialogues that fit in a row."""
    turns = F.array_sort(F.collect_list(F.struct("k", "segment")))
    return segments.groupBy("conv_id", "speaker").agg(F.array_join(F.transform(turns, lambda x: x["segment"]), "").alias("text"))
