"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns is rendered once as the prompt. What follows
in each conversation is a completion, with the character spans of its assistant
texts as the mask of what a model is trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEARNED = "assistant"


def render(role: Column, text: Column) -> Column:
    """One turn as text; a null role or text is empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """One row for each pair of conversations.

    turns(pair_id, side, conv_id, turn, role, text), side being `chosen` or
    `rejected` -> pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen,
    rejected, chosen_mask, rejected_mask (arrays of (start, length) in characters,
    start from 0).

    Turns count in order of turn number, then role and text; a turn given twice
    stays twice. Turns are common if role and text are equal, nulls included. Of
    equal conversations all is prompt and both completions are empty. A side
    without turns has a null id and a null completion, and the prompt is empty.
    Turns without a pair_id or a known side are left out. A conversation is one
    row's text, so its length is bounded only by what a row may hold. Other
    columns are ignored. An empty table gives an empty result.
    """
    rows = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")).select("pair_id", "side", "conv_id", "turn", "role", "text")
    at = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    rows = rows.withColumn("at", F.row_number().over(at))
    same = F.min("role").eqNullSafe(F.max("role")) & F.min("text").eqNullSafe(F.max("text")) & (F.count("role") != 1) & (F.count("text") != 1) & (F.count("*") == 2)
    level = rows.groupBy("pair_id", "at").agg(same.alias("same"))
    prefix = level.groupBy("pair_id").agg((F.coalesce(F.min(F.when(~F.col("same"), F.col("at"))), F.max("at") + 1) - 1).cast("long").alias("n_prompt_turns"))
    full = rows.join(prefix, "pair_id").withColumn("shown", render(F.col("role"), F.col("text"))).withColumn("after", F.col("at") > F.col("n_prompt_turns"))
    running = Window.partitionBy("pair_id", "side", "after").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("start", F.coalesce(F.sum(F.length("shown")).over(running), F.lit(0)) + F.length("shown") - F.length(F.coalesce("text", F.lit(""))) - 1)

    def joined(cond: Column) -> Column:
        parts = F.array_sort(F.collect_list(F.when(cond, F.struct("at", "shown"))))
        return F.array_join(F.transform(parts, lambda x: x["shown"]), "")

    def mask(cond: Column) -> Column:
        learned = cond & (F.col("role") == LEARNED) & (F.length("text") > 0)
        return F.array_sort(F.collect_list(F.when(learned, F.struct(F.col("start").cast("long").alias("start"), F.length("text").cast("long").alias("length")))))

    chosen, rejected = F.col("side") == "chosen", F.col("side") == "rejected"
    out = full.groupBy("pair_id").agg(
        F.min(F.when(chosen, F.col("conv_id"))).alias("chosen_id"),
        F.min(F.when(rejected, F.col("conv_id"))).alias("rejected_id"),
        F.max(F.when(chosen, 1)).alias("_c"),
        F.max(F.when(rejected, 1)).alias("_r"),
        F.min("n_prompt_turns").alias("n_prompt_turns"),
        joined(chosen & ~F.col("after")).alias("prompt"),
        joined(chosen & F.col("after")).alias("chosen"),
        joined(rejected & F.col("after")).alias("rejected"),
        mask(chosen & F.col("after")).alias("chosen_mask"),
        mask(rejected & F.col("after")).alias("rejected_mask"),
    )
    for flag, name in (("_c", "chosen"), ("_r", "rejected")):
        out = out.withColumn(name, F.when(F.col(flag) == 1, F.col(name))).withColumn(f"{name}_mask", F.when(F.col(flag) == 1, F.col(f"{name}_mask")))
    return out.drop("_c", "_r")


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """Pair conversations 2k (chosen) and 2k + 1 (rejected) of a table without a preference column."""
    side = F.when(F.pmod(F.col("conv_id"), F.lit(2)) == 0, F.lit("chosen")).otherwise(F.lit("rejected"))
    return conversations.where("conv_id is not null").select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), side.alias("side"), "conv_id", "turn", "role", "text")
