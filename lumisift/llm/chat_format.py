"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the
assistant and all others as named users; system turns stay system turns. The loss mask covers what the assistant says, with
its end mark. One row is one turn of one rendering, with its place in it: the rendering is its
segments one after the other, and neither a long conversation nor a conversation of many participants meets in one row.
Offsets come from sums within blocks of turns and sums of earlier blocks, so that a conversation of any length is dealt out.

Roles other than ``system`` are participants. A null role speaks as ``unknown``, a null text is empty, a null turn comes first, and
rows of a null conv_id form one conversation. Turns of equal number stand in order of role and text; repeated rows are
turns each. Marks in names and texts are broken up, so that no text forges a turn. A conversation
of system turns only has no rendering. Very long texts are read whole. Columns other than those named are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Turns in a block (a power of two).
BLOCK = 256


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, position, turn, role, segment, begin, end, loss_begin, loss_end), offsets in characters of the rendering.

    turns: (conv_id, turn, role, text).
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("block", F.shiftright("turn", BLOCK.bit_length() - 1))
    speakers = rows.where("role <> 'system'").select(F.col("conv_id").alias("conv"), F.col("role").alias("perspective")).distinct()
    head = F.when(F.col("role") == "system", F.lit("<|system|>\n")).when(F.col("role") == F.col("perspective"), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user "), _plain("role"), F.lit("|>\n")))
    body = F.concat(_plain("text"), F.lit("<|end|>\n"))
    seen = (
        rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
        .withColumn("head", F.length(head)).withColumn("segment", F.concat(head, body)).withColumn("size", F.length("segment").cast("long"))
    )
    blocks = seen.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*(F.col(c).alias("b_" + c) for c in ("conv_id", "perspective", "block")), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("size_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"))
    within = Window.partitionBy("conv_id", "perspective", "block").orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = seen.withColumn("upto", F.sum("size").over(within)).withColumn("rank", F.count("*").over(within))
    same = F.col("conv_id").eqNullSafe(F.col("b_conv_id")) & (F.col("perspective") == F.col("b_perspective")) & F.col("block").eqNullSafe(F.col("b_block"))
    speaks = F.col("role") == F.col("perspective")
    return (
        placed.join(blocks, same)
        .withColumn("end", F.col("size_before") + F.col("upto"))
        .withColumn("begin", F.col("end") - F.col("size"))
        .select("conv_id", "perspective", (F.col("n_before") + F.col("rank") - 1).alias("position"), "turn", "role", "segment", "begin", "end", F.when(speaks, F.col("begin") + F.col("head")).alias("loss_begin"), F.when(speaks, F.col("end") - 1).alias("loss_end"))
    )
