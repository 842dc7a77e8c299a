"""Chat formatting: preference pairs with a shared prompt.

A pair has a chosen and a rejected conversation. Their longest common prefix of turns (same role
and same text) is rendered once as the prompt; the rest of either side is its completion, with
the character ranges of assistant turns as the loss mask.

Defined results: turns are ordered by (turn, role, text), so ties and repeated rows have one
order; null roles and texts count as empty; rows with a null pair id are dropped, as is a pair
that lacks a side; equal sides give empty completions; other columns are not read. One shuffle,
on the pair id; a pair's turns are held by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = "concat('<|', x.role, '|>\\n', x.text, '<|end|>\\n')"
#: Ranges of one side's assistant turns after their headers, with the end mark: 'start:end;...'.
MASK = """array_join(aggregate({turns}, named_struct('at', 0, 'spans', cast(array() as array<string>)),
  (acc, x) -> named_struct('at', acc.at + length(x.role) + length(x.text) + 13,
    'spans', if(x.role = 'assistant', array_append(acc.spans, concat(acc.at + length(x.role) + 5, ':', acc.at + length(x.role) + length(x.text) + 13)), acc.spans)),
  acc -> acc.spans), ';')"""


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) of each pair."""

    def side(df: DataFrame, k: int) -> DataFrame:
        return df.select(
            F.col(pair_col).alias("pair_id"), F.lit(k).alias("side"),
            F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("x"),
        )

    turns = side(chosen, 0).unionByName(side(rejected, 1)).filter("pair_id is not null")
    pairs = turns.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.when(F.col("side") == 0, F.col("x")))).alias("c"), F.sort_array(F.collect_list(F.when(F.col("side") == 1, F.col("x")))).alias("r"))
    pairs = pairs.filter("size(c) > 0 and size(r) > 0")
    pairs = pairs.withColumn("prompt_turns", F.expr("coalesce(array_min(filter(sequence(0, least(size(c), size(r)) - 1), i -> c[i].role <> r[i].role or c[i].text <> r[i].text)), least(size(c), size(r)))"))
    pairs = pairs.withColumns({"p": F.expr("slice(c, 1, prompt_turns)"), "c": F.expr("slice(c, prompt_turns + 1, size(c))"), "r": F.expr("slice(r, prompt_turns + 1, size(r))")})
    render = lambda a: F.expr(f"array_join(transform({a}, x -> {SEGMENT}), '')")
    return pairs.select(
        "pair_id", "prompt_turns", render("p").alias("prompt"), render("c").alias("chosen"), render("r").alias("rejected"),
        F.expr(MASK.format(turns="c")).alias("chosen_mask"), F.expr(MASK.format(turns="r")).alias("rejected_mask"),
    )


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """A rejected side for each conversation: its last assistant turn has the text of its partner's.

    The partner of conversation c is c xor 1; without a partner's reply the text is empty.
    """
    last = conversations.filter("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("l"))
    own = last.select("conv_id", F.col("l.turn").alias("last_turn"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.col("l.text").alias("other_text"))
    joined = conversations.join(own, "conv_id", "left").join(other, "conv_id", "left")
    swap = (F.col("role") == "assistant") & (F.col("turn") == F.col("last_turn"))
    return joined.select("conv_id", "turn", "role", F.when(swap, F.coalesce("other_text", F.lit(""))).otherwise(F.col("text")).alias("text"))
