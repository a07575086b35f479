"""Chat formatting by rotating the perspective among a dialogue's participants, with DataFrame functions only.

For every participant the whole dialogue is rendered with that speaker as the assistant and the others as named users, and a mask
says which characters count towards the loss: what that speaker says, and the end mark after it. The rendering is kept as one row
for each turn, with its place in the rendered string, so that a dialogue of any length is never gathered in one task; joining a
perspective's rows in order of ``start`` gives its string. Places are sums of lengths over ranges of turns and then inside a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm._util import cut_lineage

OPEN, CLOSE = "<|", "|>"
END = "<|end|>\n"
#: Turns whose lengths are summed together.
RANGE_TURNS = 256
UNKNOWN = "unknown"


#: The word joiner parts what would read like a mark; where a text has one itself, it is doubled, so that different texts stay different.
_PART = "\u2060"


def _plain(c: Column) -> Column:
    """Text in which nothing reads like the opening of a mark of this format."""
    doubled = F.replace(F.coalesce(c, F.lit("")), F.lit(_PART), F.lit(_PART * 2))
    return F.replace(doubled, F.lit(OPEN), F.lit(f"<{_PART}|"))


def _name(c: Column) -> Column:
    """A speaker's name in which, besides, nothing closes a mark or ends its line."""
    closed = F.replace(_plain(c), F.lit(CLOSE), F.lit(f"|{_PART}>"))
    return F.replace(F.replace(closed, F.lit("\n"), F.lit(f"{_PART}n")), F.lit("\r"), F.lit(f"{_PART}r"))


def rotate_perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", never: tuple[str, ...] = ("system",)
) -> DataFrame:
    """(conv_id, perspective, turn, speaker, role, message, mask, start, end) for each turn and participant of its dialogue.

    ``role`` is ``assistant`` for the perspective's own turns, ``system`` for speakers in ``never``, which are no participants, else
    ``user``. ``message`` is the rendered turn, ``mask`` 1 where its text counts; ``text_from`` and ``text_to`` bound that text
    in the perspective's string, and ``start`` and ``end`` the whole turn, in characters from 0.

    Marks inside texts and names are parted by a word joiner, see ``_plain``. Null text is empty. A null speaker is named ``unknown`` and is no participant. Turns are ordered by number, null first, then
    by speaker and text; equal rows all stay. Null dialogue ids form one dialogue. A dialogue without participants has no rows.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), _name(F.coalesce(F.col(speaker_col), F.lit(UNKNOWN))).alias("speaker"),
        F.col(speaker_col).isNull().alias("nobody"), _plain(F.col(text_col)).alias("text"),
    )
    system = F.col("speaker").isin(*never)
    people = rows.where(~F.col("nobody") & ~system).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    own = (F.col("speaker") == F.col("perspective")) & ~F.col("nobody")
    role = F.when(own, F.lit("assistant")).when(system, F.lit("system")).otherwise(F.lit("user"))
    head = F.concat(F.lit(OPEN), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(":"), F.col("speaker"))).otherwise(F.lit("")), F.lit(CLOSE + "\n"))
    seen = seen.withColumn("role", role).withColumn("mask", own.cast("int")).withColumn("head", head)
    seen = seen.withColumn("message", F.concat("head", "text", F.lit(END)))
    seen = seen.withColumn("range", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / RANGE_TURNS))

    dialogue = ["conv_id", "perspective"]
    length = F.length("message").cast("long")
    sums = cut_lineage(seen.groupBy(*dialogue, "range").agg(F.sum(length).alias("chars")))
    before = F.coalesce(F.sum("chars").over(W.partitionBy(*dialogue).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = sums.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("range").alias("r"), before.alias("before"))
    inside = W.partitionBy(*dialogue, "range").orderBy("turn", "speaker", "text").rowsBetween(W.unboundedPreceding, 0)
    placed = seen.withColumn("upto", F.sum(length).over(inside))
    placed = placed.join(ranges, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("range") == F.col("r")))
    end = F.col("before") + F.col("upto")
    start, text_from = end - length, end - length + F.length("head")
    return placed.select(
        *dialogue, "turn", "speaker", "role", "message", "mask", start.alias("start"), end.alias("end"),
        F.when(F.col("mask") == 1, text_from).alias("text_from"), F.when(F.col("mask") == 1, end - 1).alias("text_to"),
    )
