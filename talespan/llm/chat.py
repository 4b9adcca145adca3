"""Multi-party perspective rotation of chats.

Every participant of a conversation is once the assistant. For each of them each turn is rendered:
the participant's own turns as `assistant`, all others as `user` with the speaker's name, system
turns as `system`. The mask holds the character ranges to learn from: the participant's own words
and the end mark; -1 where a turn has none. Turns stay rows, ordered by (conv_id, perspective, turn, part), so that a
conversation of any length is never gathered in one task; the participants alone are aggregated,
by partial sums. `dialogues()` joins runs of `turns_each` turn numbers into texts.

Defined results: a turn with a null or empty role, or with role "system", is no participant's; null
text is rendered as empty. A conversation without participants gives no rows. Repeated turns (equal
conv_id, turn, role and text) are each rendered; ties of turn are ordered by role and text. A null conv_id
is a conversation of its own. Other columns are dropped. Marks that a role or a text has itself are not escaped: they are
rendered as they are, and places are counted with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _header(role: Column, speaker: Column) -> Column:
    own = F.concat(F.lit(OPEN + "assistant\n"))
    other = F.concat(F.lit(OPEN + "user name="), role, F.lit("\n"))
    system = F.lit(OPEN + "system\n")
    return F.when(role.isNull() | (role == "") | (role == "system"), system).when(role == speaker, own).otherwise(other)


def rotations(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, role, rendered, is_target, mask_start, mask_stop, n_chars."""
    turns = conversations.select("conv_id", "turn", F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    participants = turns.where("role is not null and role not in ('', 'system')").groupBy("conv_id", F.col("role").alias("perspective")).agg(F.lit(1).alias("_one")).drop("_one")
    joined = turns.alias("t").join(participants.alias("p"), F.col("t.conv_id").eqNullSafe(F.col("p.conv_id"))).select("t.*", "p.perspective")
    header = _header(F.col("role"), F.col("perspective"))
    target = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    start = F.char_length(header).cast("long")
    rendered = F.concat(header, "text", F.lit(CLOSE + "\n"))
    stop = F.char_length(rendered).cast("long") - 1
    return joined.select("conv_id", "perspective", "turn", "role", rendered.alias("rendered"), target.alias("is_target"), F.when(target, start).otherwise(-1).alias("mask_start"), F.when(target, stop).otherwise(-1).alias("mask_stop"), F.char_length(rendered).cast("long").alias("n_chars"))


def dialogues(conversations: DataFrame, turns_each: int = 64) -> DataFrame:
    """Texts of at most `turns_each` consecutive turn numbers and their masks in the whole text."""
    part = F.floor(F.coalesce("turn", F.lit(0)) / turns_each)
    rows = rotations(conversations).withColumn("part", part)
    seen = F.sort_array(F.collect_list(F.struct("turn", "role", "rendered", "mask_start", "mask_stop")))
    grouped = rows.groupBy("conv_id", "perspective", "part").agg(seen.alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: t["rendered"]), "")
    step = lambda a, t: F.struct((a["at"] + F.char_length(t["rendered"])).alias("at"), F.when(t["mask_start"] < 0, a["masks"]).otherwise(F.concat(a["masks"], F.array(F.struct((a["at"] + t["mask_start"]).alias("start"), (a["at"] + t["mask_stop"]).alias("stop"))))).alias("masks"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("masks"))
    return grouped.select("conv_id", "perspective", "part", text.alias("text"), F.aggregate("turns", zero, step, lambda a: a["masks"]).alias("masks"))
