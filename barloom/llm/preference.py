"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation is rendered once as the
prompt; what follows in each is rendered as its completion, with the spans that a loss counts.

A turn is rendered as <|role|>, line end, text, <|end|>, line end. In completions the spans cover the text and the end
mark of assistant turns, as half-open ranges of code points "12-40,60-80".

Defined results: turns go by turn number, nulls first, then role and text; rows equal in all three are one turn, other rows with one
number stay as turns of their own. A null role is written as "user", a null text as empty, and both compare
as written. "<|" inside a role or text is written "< |", so content can't pass for a mark. When the two sides are alike, or one
goes on after the other, the completion with nothing left is empty and without spans. A pair with one side missing has an
empty other side and an empty prompt. A conversation is one training row, so its turns meet in one row here as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import only

#: Role whose turns count in the loss.
LEARNED = "assistant"


def _plain(c: str, default: str) -> Column:
    return F.replace(F.coalesce(F.col(f"`{c}`"), F.lit(default)), F.lit("<|"), F.lit("< |"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def _spans(turns: Column) -> Column:
    """Code-point ranges of learned turns: a running length over the turns; role takes 5 signs more than its letters, the end 8."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        lo = acc["at"] + F.length(t["role"]) + 5
        hi = lo + F.length(t["text"]) + 7
        here = F.when(t["role"] == LEARNED, F.array(F.concat(lo.cast("string"), F.lit("-"), hi.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct((hi + 1).alias("at"), F.concat(acc["out"], here).alias("out"))

    return F.array_join(F.reduce(turns, start, step)["out"], ",")


def preference_rows(pairs: DataFrame, turns: DataFrame) -> DataFrame:
    """pairs: pair_id, chosen_id, rejected_id. turns: conv_id, turn, role, text. One row per pair: pair_id, chosen_id,
    rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans."""
    talks = (turns.select(F.col("`conv_id`").alias("conv_id"), F.struct(F.col("`turn`").alias("turn"), _plain("role", "user").alias("role"),
                                                                        _plain("text", "").alias("text")).alias("t"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns")))
    p = only(pairs, pair_id="pair_id", chosen_id="chosen_id", rejected_id="rejected_id")
    side = lambda c: talks.select(F.col("conv_id").alias(c), F.col("turns").alias(f"{c}_turns"))
    both = p.join(side("chosen_id"), "chosen_id", "left").join(side("rejected_id"), "rejected_id", "left")
    return formatted(both.select("pair_id", "chosen_id", "rejected_id", F.col("chosen_id_turns").alias("a"), F.col("rejected_id_turns").alias("b")))


def formatted(sides: DataFrame) -> DataFrame:
    """sides: pair_id, chosen_id, rejected_id and the turn arrays a and b, null where a side is missing."""
    none = F.array().cast(sides.schema["a"].dataType)
    s = sides.withColumns({"a": F.coalesce("a", none), "b": F.coalesce("b", none)})
    shorter = F.least(F.size("a"), F.size("b"))
    same = lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"])
    differ = F.filter(F.transform(F.arrays_zip("a", "b"), lambda z, i: F.when(~F.coalesce(same(z["a"], z["b"]), F.lit(False)), i)), lambda i: i.isNotNull())
    s = s.withColumn("n", F.least(shorter, F.coalesce(F.try_element_at(differ, F.lit(1)), shorter)))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    s = s.withColumns({"p": F.slice("a", F.lit(1), F.col("n")), "c": rest("a"), "r": rest("b")})
    return s.select("pair_id", "chosen_id", "rejected_id", F.col("n").cast("long").alias("n_prompt_turns"), _rendered(F.col("p")).alias("prompt"),
                    _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"),
                    _spans(F.col("c")).alias("chosen_spans"), _spans(F.col("r")).alias("rejected_spans"))


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Sides for a table without preferences: conversations 2i and 2i + 1 are a pair, the even one is chosen. One aggregation by pair
    instead of two joins by conversation. A null conv_id belongs to no pair."""
    t = turns.select(F.col("`conv_id`").alias("conv_id"), F.struct(F.col("`turn`").alias("turn"), _plain("role", "user").alias("role"),
                                                                    _plain("text", "").alias("text")).alias("t")).filter("conv_id is not null")
    # Whole-number arithmetic: a quotient by way of doubles would merge neighbours of ids beyond 2**53.
    pair, odd = F.shiftright(F.col("conv_id").cast("long"), 1), F.pmod("conv_id", F.lit(2))
    return (t.groupBy(pair.alias("pair_id"))
            .agg(F.max(F.when(odd == 0, F.col("conv_id"))).alias("chosen_id"), F.max(F.when(odd == 1, F.col("conv_id"))).alias("rejected_id"),
                 F.sort_array(F.collect_set(F.when(odd == 0, F.col("t")))).alias("a"), F.sort_array(F.collect_set(F.when(odd == 1, F.col("t")))).alias("b")))
