"""Chat formatting by perspective rotation (DataFrame operations only).

Every participant of a dialogue gets a rendering of it in which the
participant's turns are the assistant's (and are learned), all other
participants' turns are those of named users, and context speakers keep their
own mark.  A dialogue of more than ``max_turns`` turns is rendered in parts of
that many, so no task ever holds an unbounded dialogue; nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.operators.ordered import add_position

MAX_TURNS = 256
END = "<|end|>\n"


def rotate_perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text",
    context: Sequence[str] = ("system",), max_turns: int = MAX_TURNS,
) -> DataFrame:
    """One row per (conversation, participant, part): conv_id, perspective, part, n_turns, n_own, rendered, mask.

    ``mask`` lists the spans of ``rendered`` (characters, end exclusive) that are learned: the participant's texts with
    their end marks.  The order is turn (nulls first), speaker, text.

    * A null text is an empty turn; a null speaker is the participant "unknown"; rows with a null conversation form
      one dialogue with a null id.  A marker inside a text or name ("<|") is broken by a blank, so it cannot forge a turn.
    * Repeated rows are turns of their own.  A dialogue with context speakers only has no participant and no row.
    * A part in which the participant says nothing has an empty mask.  Other columns are not looked at; empty in, empty out.
    """
    plain = lambda c, missing: F.regexp_replace(F.coalesce(turns[c].cast("string"), F.lit(missing)), r"<\|", "< |")
    said = turns.select(
        turns[conv_col].alias("conv_id"),
        turns[turn_col].alias("turn"),
        plain(speaker_col, "unknown").alias("speaker"),
        plain(text_col, "").alias("text"),
        F.monotonically_increasing_id().alias("row"),  # tells repeated rows apart
    )
    placed = add_position(said, [F.col("turn").asc_nulls_first(), "speaker", "text", "row"], by=["conv_id"], name="pos")
    part = F.expr(f"pos div {max_turns}").cast("int")
    parts = placed.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("pos", "speaker", "text"))).alias("turns"))
    people = said.filter(~F.col("speaker").isin(*context)).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    both = parts.join(people, F.col("conv_id").eqNullSafe(F.col("of")))

    def segment(t):
        own = t["speaker"] == F.col("perspective")
        head = F.when(own, F.lit("<|assistant|>\n")).when(t["speaker"].isin(*context), F.concat(F.lit("<|"), t["speaker"], F.lit("|>\n")))
        head = head.otherwise(F.concat(F.lit("<|user:"), t["speaker"], F.lit("|>\n")))
        return F.struct(own.alias("own"), F.length(head).alias("head"), F.concat(head, t["text"], F.lit(END)).alias("text"))

    cut = both.withColumn("segments", F.transform("turns", segment))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, s):
        end = acc["at"] + F.length(s["text"])
        span = F.array(F.struct((acc["at"] + s["head"]).alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(s["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return cut.select(
        "conv_id",
        "perspective",
        "part",
        F.size("segments").alias("n_turns"),
        F.size(F.filter("segments", lambda s: s["own"])).alias("n_own"),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("rendered"),
        F.aggregate("segments", start, step)["spans"].alias("mask"),
    )
