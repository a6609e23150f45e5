"""Dialogues from each speaker's side, as segments with loss masks (operator 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Turns of a conversation whose places are summed in one task.
SPAN = 512


def escaped(text: Column) -> Column:
    """A text that cannot be taken for a mark: in each `<` and `|` with only backslashes between, one more of these.

    Taking one away from each such place gives the text back.
    """
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _header(role: Column, name: Column) -> Column:
    # a name is one line
    shown = F.regexp_replace(escaped(name), r"[\r\n]+", " ")
    return F.concat(F.lit("<|im_start|>"), role, F.when(name.isNotNull(), F.concat(F.lit(" name="), shown)).otherwise(F.lit("")), F.lit("\n"))


def segments(turns: DataFrame, setting: str = "system") -> DataFrame:
    """conv_id, perspective, turn, role, name, segment, start, mask_start, mask_end of each turn from each side.

    turns has conv_id, turn, role (the speaker) and text. Each speaker of a conversation but setting is a
    perspective: its own turns become the assistant's, those of others the user's with the speaker's name, and those
    of setting stay. The segments of a perspective in the order of start, a character count, are its dialogue. The
    loss covers mask_start to mask_end, the text and end mark of the assistant's turns; both are null elsewhere. A
    null role is the speaker `unknown`, a null text is empty. Marks inside texts and names are escaped(), and line ends in
    names become blanks, so no text can begin a turn of its own; the column name has the name as it is. A conversation with no speaker but setting has no
    perspective. Turns of one number come by speaker and text; a null number comes first, as does a null conv_id's
    conversation as one of its own. Repeated rows get segments of their own, an empty table none; further columns are
    left out. Starts are summed in two steps, within
    spans of 512 turn numbers and over the spans, so a long conversation is many tasks' work.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), escaped(F.coalesce("text", F.lit(""))).alias("text"))
    sides = rows.filter(F.col("speaker") != setting).select(F.col("conv_id").alias("side_conv"), F.col("speaker").alias("perspective")).distinct()
    joined = rows.join(sides, F.col("conv_id").eqNullSafe(F.col("side_conv"))).drop("side_conv")
    own, fixed = F.col("speaker") == F.col("perspective"), F.col("speaker") == setting
    joined = joined.withColumns({"role": F.when(own, "assistant").when(fixed, "system").otherwise("user"), "name": F.when(~own & ~fixed, F.col("speaker")), "span": F.floor(F.coalesce("turn", F.lit(0)) / SPAN)})
    joined = joined.withColumn("head", _header(F.col("role"), F.col("name"))).withColumn("segment", F.concat("head", "text", F.lit("<|im_end|>\n")))
    joined = joined.withColumn("size", F.length("segment"))
    inside = Window.partitionBy("conv_id", "perspective", "span").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    spans = joined.groupBy("conv_id", "perspective", "span").agg(F.sum("size").alias("size"))
    over = Window.partitionBy("conv_id", "perspective").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("span").alias("s"), F.coalesce(F.sum("size").over(over), F.lit(0)).alias("before"))
    start = F.col("before") + F.col("inside")
    return placed.join(spans, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("span") == F.col("s"))).select(
        "conv_id", "perspective", "turn", "role", "name", "segment", start.alias("start"), F.when(F.col("role") == "assistant", start + F.length("head")).alias("mask_start"), F.when(F.col("role") == "assistant", start + F.col("size") - 1).alias("mask_end")
    )
