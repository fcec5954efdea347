"""Chat formatting: every participant's view of a dialogue, with that speaker as the assistant.

Turns are gathered once per part of a conversation (``part_turns`` turn numbers each, so that no conversation, however
long, is gathered whole in one task) and rendered from there for each participant by array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def safe_text(c: Column) -> Column:
    """Null becomes empty, and marks within a text lose their meaning: <| is written <\\|."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("<\\|"))


#: How characters that would break a head are written, and the name of a participant without one; no two roles meet.
ESCAPES = {"%": "%25", " ": "%20", "\t": "%09", "\n": "%0A", "\r": "%0D", "<": "%3C", ">": "%3E", "|": "%7C"}
NOBODY = "%unknown"


def name_of(role: Column) -> Column:
    """The role as it stands in heads, another for every role."""
    for character, code in ESCAPES.items():
        role = F.replace(role, F.lit(character), F.lit(code))
    return F.coalesce(role, F.lit(NOBODY))


def rotate_perspectives(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = 1024) -> DataFrame:
    """(conv, perspective, part, n_turns, rendered, mask) with one row per participant and part of a conversation.

    The perspective's own turns read ``<|im_start|>assistant``, system turns keep their name, all others read
    ``<|im_start|>user name=ROLE``. mask is an array of (start, end) character ranges of rendered, end excluded, over the
    perspective's texts and their end marks: what a loss should count. Parts in order, joined, are the whole dialogue.

    Turns are ordered by turn, then role, then text; repeated rows are rendered each. White space, <, >, | and % in a role
    are written as % and their code, so that no two roles become one; a null role is the participant ``%unknown``, a null text is empty, null turns come first and belong to part 0, a null conv is a conversation of its
    own. A conversation of system turns only has no participant and thus no row; an empty table gives none. Texts of any
    length are rendered whole. Other columns are ignored.
    """
    t = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), name_of(F.col(role_col)).alias("role"), safe_text(F.col(text_col)).alias("text"),
        F.coalesce(F.floor(F.col(turn_col) / part_turns), F.lit(0)).cast("bigint").alias("part"),
    )
    people = t.filter(F.col("role") != SYSTEM).select("conv", "role").distinct().groupBy("conv").agg(F.sort_array(F.collect_set("role")).alias("people"))
    parts = t.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    each = parts.join(people.withColumnRenamed("conv", "of"), F.col("conv").eqNullSafe(F.col("of"))).select("conv", "part", "turns", F.explode("people").alias("perspective"))

    me = F.col("perspective")

    def head(x: Column) -> Column:
        name = F.when(x["role"] == SYSTEM, F.lit(SYSTEM)).when(x["role"] == me, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), x["role"]))
        return F.concat(F.lit(OPEN), name, F.lit("\n"))

    pieces = F.transform("turns", lambda x: F.struct(head(x).alias("head"), F.concat(x["text"], F.lit(CLOSE)).alias("body"), (x["role"] == me).alias("own")))
    each = each.withColumn("pieces", pieces)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.char_length(x["head"])
        end = begin + F.char_length(x["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(x["own"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return each.select(
        F.col("conv").alias(conv_col), "perspective", "part", F.size("turns").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("rendered"),
        F.aggregate("pieces", start, step, lambda s: s["spans"]).alias("mask"),
    )
