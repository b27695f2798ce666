"""Multi-party chat formatting by perspective rotation.

Every participant of a conversation gets a rendering of the whole dialogue in which it is the
assistant and all others are named users; the mask covers what the assistant says with its end
mark. System turns are instructions, not a participant. A conversation is rendered in parts of
PART turn numbers, so that no task holds an unbounded one; a part's rows carry its place in
the whole, and parts in order join to the whole text.

Defined results: a null text is empty, a null role is named "unknown"; a repeated row is one
turn; turns of one number follow by role, then text; null numbers come first in part -1; the
mark "<|" inside a text is written "< |"; a conversation of system turns alone has no
participant and gives no row; a null conv_id is a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = 256
INSTRUCTIONS = "system"


def head(role: Column, speaker: Column) -> Column:
    return (
        F.when(role == INSTRUCTIONS, F.lit("<|system|>\n"))
        .when(role == speaker, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))
    )


def rotate(turns: DataFrame, part_turns: int = PART) -> DataFrame:
    """(conv_id, speaker, part, n_turns, start, text, mask, n_masked) per perspective and part.

    ``mask`` lists start:end of the assistant's words in code points of the whole rendering.
    """
    clean = turns.select(
        F.col("conv_id"),
        F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long").alias("part"),
        F.col("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n")).alias("said"),
    )
    # repeated rows fall away where a part is put together, in the one shuffle of texts
    parts = clean.groupBy("conv_id", "part").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "said"))).alias("turns"))
    speakers = clean.where(F.col("role") != INSTRUCTIONS).groupBy("conv_id", "role").agg(F.lit(1).alias("one"))
    speakers = speakers.groupBy("conv_id").agg(F.array_sort(F.collect_list("role")).alias("speakers"))
    speakers = speakers.withColumnRenamed("conv_id", "conv")
    each = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("conv")))
    each = each.select("conv_id", "part", "turns", F.explode("speakers").alias("speaker"))
    rendered = F.transform("turns", lambda t: F.concat(head(t["role"], F.col("speaker")), t["said"]))
    each = each.select("*", rendered.alias("pieces")).withColumn("text", F.array_join("pieces", ""))
    order = Window.partitionBy("conv_id", "speaker").orderBy("part")
    before = F.sum(F.length("text").cast("long")).over(order) - F.length("text")
    each = each.withColumn("start", before)
    spans = F.aggregate(
        F.arrays_zip("turns", "pieces"),
        F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).cast("long").alias("n")),
        lambda a, x: masked(a, x["turns"], x["pieces"]),
    )
    return each.withColumn("masked", spans).select(
        "conv_id", "speaker", "part", F.size("turns").cast("long").alias("n_turns"), "start", "text",
        F.array_join("masked.spans", ",").alias("mask"), F.col("masked.n").alias("n_masked"),
    )


def masked(so_far: Column, turn: Column, piece: Column) -> Column:
    """Move on by one turn; an assistant's turn adds the span behind its head."""
    end = so_far["at"] + F.length(piece)
    size = F.length(turn["said"])
    own = (turn["role"] == F.col("speaker")) & (turn["role"] != INSTRUCTIONS)
    span = F.concat_ws(":", end - size, end)
    return F.struct(
        end.cast("long").alias("at"),
        F.when(own, F.concat(so_far["spans"], F.array(span))).otherwise(so_far["spans"]).alias("spans"),
        (so_far["n"] + F.when(own, size).otherwise(0)).cast("long").alias("n"),
    )
