"""Dialogues with several speakers, rendered once from the seat of every speaker.

For each participant of a dialogue the whole dialogue is written with that speaker as the
assistant and every other speaker as a user under a name. Only the assistant's own words (and
the mark that ends them) are to be learned; ``mask`` gives their places. Narrators, such as
``system``, set the scene: they are written under their own role and have no seat.

Long dialogues are cut into parts of ``PART_TURNS`` turn numbers, so that no task holds an unbounded
dialogue; the parts of a seat, in order, joined, are its rendering.

Defined cases: a row that repeats whole counts once. Turns with equal numbers are ordered by speaker, then
text; null turn numbers form the last part. A null text is an empty message. A null speaker is an
unnamed user without a seat. Rows with a null dialogue id are one dialogue. A dialogue without a participant
gives no row, and an empty table gives none. Other columns are never read.

Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TURNS = 1024
NARRATORS = ("system",)
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def header(speaker: Column, seat: Column, narrators: tuple[str, ...]) -> Column:
    """The line that opens a message, as seen from ``seat``."""
    role = (
        F.when(speaker == seat, F.lit("assistant"))
        .when(speaker.isin(*narrators), speaker)
        .when(speaker.isNull(), F.lit("user"))
        .otherwise(F.concat(F.lit("user name="), speaker))
    )
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE))


def rotate(
    turns: DataFrame,
    dialogue: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    narrators: tuple[str, ...] = NARRATORS,
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """One row for each (dialogue, participant, part): its text and the spans to learn from.

    Columns: ``dialogue``, ``participant``, ``part`` (turn number divided by ``part_turns``, floored), ``n_turns``,
    ``n_own`` (turns of the participant), ``text``, ``mask`` (array of ``start``, ``end`` in characters of ``text``, end exclusive).
    """
    said = turns.select(
        F.col(dialogue).alias("_id"),
        F.floor(F.col(turn) / part_turns).cast("long").alias("_part"),
        F.struct(
            F.col(turn).isNull().alias("late"),
            F.col(turn).alias("turn"),
            F.col(speaker).cast("string").alias("who"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("what"),
        ).alias("_turn"),
    )
    parts = said.groupBy("_id", "_part").agg(F.sort_array(F.collect_set("_turn")).alias("_turns"))
    seats = (
        said.select("_id", F.col("_turn.who").alias("_seat"))
        .filter(F.col("_seat").isNotNull() & ~F.col("_seat").isin(*narrators))
        .distinct()
        .withColumnRenamed("_id", "_of")
    )
    seen = parts.join(seats, parts["_id"].eqNullSafe(seats["_of"])).select("_id", "_part", "_seat", "_turns")
    written = seen.select(
        "*",
        F.transform(
            "_turns",
            lambda t: F.struct(
                header(t["who"], F.col("_seat"), narrators).alias("head"),
                F.concat(t["what"], F.lit(CLOSE)).alias("body"),
                F.coalesce(t["who"] == F.col("_seat"), F.lit(False)).alias("own"),
            ),
        ).alias("_said"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(done: Column, s: Column) -> Column:
        begin = done["at"] + F.length(s["head"])
        end = begin + F.length(s["body"])
        # The line end after the closing mark belongs to no one.
        own = F.array(F.struct(begin.alias("start"), (end - 1).alias("end")))
        spans = F.when(s["own"], F.concat(done["spans"], own)).otherwise(done["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return written.select(
        F.col("_id").alias(dialogue),
        F.col("_seat").alias("participant"),
        F.col("_part").alias("part"),
        F.size("_said").cast("long").alias("n_turns"),
        F.size(F.filter("_said", lambda s: s["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("_said", lambda s: F.concat(s["head"], s["body"])), "").alias("text"),
        F.aggregate("_said", start, step, lambda done: done["spans"]).alias("mask"),
    )
