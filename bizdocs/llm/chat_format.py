"""Multi-party chat formatting: every participant's view of a dialogue.

For each participant the dialogue is rendered with that speaker as the assistant and all others as named users;
the mask marks the speaker's own messages, the only text to learn from. System messages are context in every view.
Dialogues are rendered in blocks of ``block_turns`` turn numbers, so one of any length never meets in one task or
one cell; a block's text continues the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
CONTEXT = ("system",)


def plain(c: Column) -> Column:
    """Text that can't be taken for markup."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def perspectives(turns: DataFrame, context: tuple[str, ...] = CONTEXT, block_turns: int = 64) -> DataFrame:
    """conv_id, perspective, block, n_turns, text, mask (array of code-point spans [start, end) of own messages).

    ``turns``: conv_id, turn, role, text. Exactly repeated rows are one message. Messages of one turn number are
    ordered by role and text, a null turn comes first (in block 0), a null role speaks as ``unknown``, a null text is
    empty. Rows without conv_id belong to no dialogue. A dialogue of context messages only has no participant and
    no view. Other columns are ignored.
    """
    rows = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    block = F.greatest(F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(0)), F.lit(0)).cast("long").alias("block")
    blocks = rows.distinct().groupBy("conv_id", block).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    speakers = rows.filter(~F.col("role").isin(list(context))).groupBy("conv_id").agg(F.collect_set("role").alias("speakers"))
    views = blocks.join(speakers, "conv_id").withColumn("perspective", F.explode("speakers"))

    def head(m: Column) -> Column:
        who = F.when(m["role"].isin(list(context)), plain(m["role"])).when(m["role"] == F.col("perspective"), "assistant")
        return F.concat(F.lit(START), who.otherwise(F.concat(F.lit("user name="), plain(m["role"]))), F.lit("\n"))

    parts = F.transform("m", lambda m: F.struct(head(m).alias("head"), F.concat(plain(m["text"]), F.lit(END)).alias("body"), (m["role"] == F.col("perspective")).alias("own")))
    views = views.withColumn("parts", parts)
    lengths = F.transform("parts", lambda p: (F.length(p["head"]) + F.length(p["body"]) + 1).cast("long"))
    views = views.withColumn("lengths", lengths)
    before = lambda i: F.aggregate(F.slice("lengths", 1, i), F.lit(0).cast("long"), lambda a, x: a + x)
    spans = F.transform("parts", lambda p, i: F.struct((before(i) + F.length(p["head"])).alias("start"), (before(i) + F.length(p["head"]) + F.length(p["body"])).alias("end"), p["own"].alias("own")))
    mask = F.transform(F.filter(spans, lambda s: s["own"]), lambda s: F.struct(s["start"], s["end"]))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    return views.select("conv_id", "perspective", "block", F.size("m").cast("long").alias("n_turns"), text.alias("text"), mask.alias("mask"))
