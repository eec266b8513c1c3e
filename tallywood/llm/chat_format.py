"""Preference formatting (DataFrame and SQL functions only).

A pair has a chosen and a rejected conversation. The turns that both begin with
are rendered once, as the prompt; what follows is each one's completion, with
the spans that a loss may look at: the contents of assistant turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """start-end of each assistant content, in code points from the completion's start, end to end in a list."""
    start = F.lit(0).cast("long")
    state = F.struct(start.alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + len(OPEN) + F.length(t["role"]) + 1
        stop = begin + F.length(t["text"])
        span = F.struct(begin.cast("long").alias("start"), stop.cast("long").alias("stop"))
        more = F.when(t["role"] == "assistant", F.concat(s["spans"], F.array(span))).otherwise(s["spans"])
        return F.struct((stop + len(CLOSE)).cast("long").alias("at"), more.alias("spans"))

    return F.aggregate(turns, state, step, lambda s: s["spans"])


def preference_pairs(turns: DataFrame, pair: Column | None = None, chosen: Column | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per pair: pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    ``pair`` and ``chosen`` say of each conversation which pair it belongs to and
    whether it is the chosen one; by default conversations 2k and 2k+1 are pair k
    and the even one is chosen. Turns go by number; of repeated equal turns one
    counts, turns that tie otherwise go by role and text. A null role or text is
    empty. Turns with a null conversation are left out, a null turn number comes
    first. A pair with one side alone has that side's turns as completion and the
    empty text on the other. Masks are lists of (start, stop) in code points of
    the completion. Extra columns are ignored; an empty table gives an empty result.

    Grouping is by conversation and pair, which hold a dialogue each, so a turn
    that many conversations share costs nothing extra.
    """
    of = pair if pair is not None else F.floor(F.col(conv) / 2)
    good = chosen if chosen is not None else F.pmod(F.col(conv), F.lit(2)) == 0
    rows = turns.where(F.col(conv).isNotNull()).select(
        of.cast("long").alias("pair_id"), good.alias("good"), F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).where("pair_id IS NOT NULL")
    one = F.struct("turn", "role", "text")
    sides = rows.groupBy("pair_id").agg(
        F.min(F.when(F.col("good"), F.col("conv"))).alias("chosen_id"), F.min(F.when(~F.col("good"), F.col("conv"))).alias("rejected_id"),
        F.sort_array(F.collect_set(F.when(F.col("good"), one))).alias("a"), F.sort_array(F.collect_set(F.when(~F.col("good"), one))).alias("b"),
    )
    same = F.transform(F.arrays_zip(F.col("a").alias("x"), F.col("b").alias("y")), lambda z: (z["x"]["role"] == z["y"]["role"]) & (z["x"]["text"] == z["y"]["text"]))
    differ = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), False)
    shared = F.when(differ == 0, F.greatest(F.size("a"), F.size("b"))).otherwise(differ - 1).cast("int")
    cut = sides.withColumn("n", shared)
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.greatest(F.size(c), F.lit(1)))
    cut = cut.select("pair_id", "chosen_id", "rejected_id", "n", F.slice("a", F.lit(1), F.col("n")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return cut.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n").cast("long").alias("n_prompt_turns"), _render(F.col("p")).alias("prompt"),
        _render(F.col("a")).alias("chosen"), _render(F.col("b")).alias("rejected"), _mask(F.col("a")).alias("chosen_mask"), _mask(F.col("b")).alias("rejected_mask"),
    )
