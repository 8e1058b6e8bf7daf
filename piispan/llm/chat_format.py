"""Preference formatting: chosen and rejected conversations that begin alike.

The longest common prefix of turns (same role, same text) is rendered once as the prompt; the rest
of each side is its completion.
A completion's mask is a list of character ranges [start, end) of the texts (with their end marks) of
the roles that are learned; headers and other roles are masked out.

All in DataFrame expressions: turns are gathered for each conversation (a conversation is one training
example, so it has to fit a row; a row holds 2 GB at most), labelled pairs meet by equi-joins of their keys.

Defined results: null roles and texts count as empty strings; turns are ordered by turn number, ties by
role and text, repeated rows are turns of their own; a side without turns has an empty completion; equal sides have the
whole conversation as prompt and empty completions; rows with a null conversation id are ignored;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piispan.llm.common import narrow

LEARNED_ROLES = ("assistant",)
HEAD, NECK, END = "<|", "|>\n", "<|end|>\n"


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(NECK), text, F.lit(END))


def gathered(turns: DataFrame) -> DataFrame:
    """conv_id, turns: array of (turn, role, text) in order."""
    t = narrow(turns, "conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull())
    t = t.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")})
    return t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def _content(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _mask(turns: Column, first: Column) -> Column:
    """Ranges of learned text in the completion rendered from turns[first:]."""
    body = F.expr("0")
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(rendered_turn(t["role"], t["text"]))).cast("int").alias("at"),
        F.when(t["role"].isin(*LEARNED_ROLES), F.concat(acc["ranges"], F.array(F.struct((acc["at"] + len(HEAD) + F.length(t["role"]) + len(NECK)).cast("int").alias("start"), (acc["at"] + F.length(rendered_turn(t["role"], t["text"]))).cast("int").alias("end"))))).otherwise(acc["ranges"]).alias("ranges"),
    )
    empty = F.struct(body.cast("int").alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("ranges"))
    return F.aggregate(F.slice(turns, first + 1, F.greatest(F.size(turns) - first, F.lit(0))), empty, step)["ranges"]


def preference_rows(pairs: DataFrame) -> DataFrame:
    """`pairs`: pair_id, chosen, rejected (arrays of role, text). Adds the prompt, both completions and their masks."""
    n = F.least(F.size("chosen"), F.size("rejected"))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at("chosen", i) == F.element_at("rejected", i))
    first_other = F.array_position(same, F.lit(False)).cast("int")
    p = pairs.withColumn("n_prompt", F.when(n == 0, 0).when(first_other > 0, first_other - 1).otherwise(n))
    render = lambda turns: F.array_join(F.transform(turns, lambda t: rendered_turn(t["role"], t["text"])), "")
    rest = lambda c: F.slice(c, F.col("n_prompt") + 1, F.greatest(F.size(c) - F.col("n_prompt"), F.lit(0)))
    return p.select(
        "pair_id",
        F.col("n_prompt").cast("long").alias("n_prompt_turns"),
        render(F.slice("chosen", 1, F.col("n_prompt"))).alias("prompt"),
        render(rest(F.col("chosen"))).alias("chosen"),
        render(rest(F.col("rejected"))).alias("rejected"),
        _mask(F.col("chosen"), F.col("n_prompt")).alias("chosen_mask"),
        _mask(F.col("rejected"), F.col("n_prompt")).alias("rejected_mask"),
    )


def cut_replies(turns: DataFrame) -> DataFrame:
    """Pairs of a table without preference labels: a conversation is chosen over itself with its last learned reply broken off half-way."""
    learned = lambda t: t["role"].isin(*LEARNED_ROLES)
    g = gathered(turns).withColumn("last", F.array_max(F.transform("turns", lambda t, i: F.when(learned(t), i))))
    half = lambda t: F.struct(t["role"].alias("role"), F.left(t["text"], F.floor(F.length(t["text"]) / 2).cast("int")).alias("text"))
    whole = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    rejected = F.transform("turns", lambda t, i: F.when(i == F.col("last"), half(t)).otherwise(whole(t)))
    return g.select(F.col("conv_id").alias("pair_id"), _content(F.col("turns")).alias("chosen"), rejected.alias("rejected"))


def labelled_pairs(turns: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs by a table of labels (pair_id, chosen_id, rejected_id: conversations); a side without turns is empty."""
    g = gathered(turns).select("conv_id", _content(F.col("turns")).alias("t"))
    none = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    p = narrow(labels, "pair_id", "chosen_id", "rejected_id")
    for side in ("chosen", "rejected"):
        one = g.select(F.col("conv_id").alias("c"), F.col("t").alias(side))
        p = p.join(one, F.col(f"{side}_id") == F.col("c"), "left").drop("c").withColumn(side, F.coalesce(side, none))
    return p.select("pair_id", "chosen", "rejected")


def format_preferences(turns: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Prompts and completions of the labelled pairs, or, without labels, of conversations against their broken-off selves."""
    return preference_rows(cut_replies(turns) if labels is None else labelled_pairs(turns, labels))
