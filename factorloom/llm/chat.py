"""Preference formatting of chosen and rejected conversations.

The longest common turn prefix of both is rendered once as the prompt; what follows it in
each is a completion with its training mask.  Built-in functions only.

Undefined cases: turns are ordered by (turn, role, text), nulls first, so repeated turn
numbers have a fixed order and a fully repeated row is a turn of its own; a null role is rendered
as ``unknown`` and a null text as empty, and two nulls are equal; rows without a
pair id belong to no pair.  A pair whose other conversation is absent has an empty
completion there and the prompt is empty (there is nothing common).  If both are equal
throughout, the last turn is left to the completions, so that neither is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, TAIL = "<|{role}|>\n", "\n<|end|>\n"
TRAINED_ROLE = "assistant"


def swapped_answers(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn",
                    role: str = "role", text: str = "text") -> DataFrame:
    """Pairs made from single conversations: ``pair_id``, ``side``, ``turn``, ``role``, ``text``.

    The chosen side is the conversation; in the rejected one the last trained turn has the
    text of the last trained turn of its neighbour (the id with the last bit flipped), or
    is left out if there is none.  Only one text for each conversation is joined.
    """
    rows = turns.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).cast("long").alias("pair_id"), F.col(turn).alias("turn"),
        F.col(role).alias("role"), F.col(text).alias("text"))
    last = rows.where(F.col("role") == TRAINED_ROLE).groupBy("pair_id").agg(F.max(
        F.struct(F.col("turn"), F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id"),
                        F.col("last.text").alias("other"))
    own = last.select("pair_id", F.col("last.turn").alias("at"))
    wide = rows.join(own, "pair_id", "left").join(other, "pair_id", "left")
    swap = (F.col("role") == TRAINED_ROLE) & F.col("turn").eqNullSafe(F.col("at"))
    rejected = F.when(F.coalesce(swap, F.lit(False)), F.col("other")).otherwise(F.coalesce("text", F.lit("")))
    return wide.select("pair_id", "turn", "role", F.explode(F.array(
        F.struct(F.lit("chosen").alias("side"), F.coalesce("text", F.lit("")).alias("text")),
        F.struct(F.lit("rejected").alias("side"), rejected.alias("text")))).alias("one")).select(
        "pair_id", "one.side", "turn", "role", "one.text").where(F.col("text").isNotNull())


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(TAIL))), "")


def _segments(turns: Column) -> Column:
    """The pieces of a completion with its mask: headers and other roles are masked, the
    text and end mark of a trained turn are not."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(F.concat(F.lit("<|"), t["role"], F.lit("|>\n")).alias("text"), F.lit(False).alias("trained")),
        F.struct(F.concat(t["text"], F.lit(TAIL)).alias("text"), (t["role"] == TRAINED_ROLE).alias("trained")))))


def _spans(segments: Column) -> Column:
    """``[start, end)`` in characters of the trained pieces, from left to right."""
    zero = F.struct(F.lit(0).cast("long").alias("at"),
                    F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece["text"])
        span = F.array(F.struct(state["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(piece["trained"], F.concat(state["spans"], span))
                        .otherwise(state["spans"]).alias("spans"))

    return F.aggregate(segments, zero, step)["spans"]


def format_preferences(turns: DataFrame, pair: str = "pair_id", side: str = "side", turn: str = "turn",
                       role: str = "role", text: str = "text") -> DataFrame:
    """``side`` is ``chosen`` or ``rejected``.  A row for each pair: ``pair_id``, ``common_turns``, ``prompt``, and for either side its
    completion, the number of its turns and its trained spans.

    One shuffle brings the turns of a pair together; a pair is one training example, so it
    is as large as one record and not as a group of records.
    """
    shaped = turns.where(F.col(pair).isNotNull()).select(
        F.col(pair).alias("pair_id"), F.col(side).alias("side"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
                 F.coalesce(F.col(text), F.lit("")).alias("text")).alias("one"))

    def gathered(name: str) -> Column:
        mine = F.array_sort(F.collect_list(F.when(F.col("side") == name, F.col("one"))))
        return F.transform(mine, lambda t: F.struct(t["role"], t["text"]))

    grouped = shaped.groupBy("pair_id").agg(gathered("chosen").alias("chosen"),
                                            gathered("rejected").alias("rejected"))
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    places = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    differs = F.filter(places, lambda k: F.element_at("chosen", k) != F.element_at("rejected", k))
    equal = F.when(F.size(differs) > 0, F.element_at(differs, 1) - 1).otherwise(shorter)
    both = (F.size("chosen") == F.size("rejected")) & (equal == F.size("chosen"))
    found = grouped.withColumn("common_turns", F.when(both & (equal > 0), equal - 1).otherwise(equal))
    for name in ("chosen", "rejected"):
        found = found.withColumn(f"{name}_after", F.slice(
            name, F.col("common_turns") + 1, F.greatest(F.size(name) - F.col("common_turns"), F.lit(0))))
    return found.select(
        "pair_id", "common_turns",
        _rendered(F.slice("chosen", F.lit(1), F.col("common_turns"))).alias("prompt"),
        *[c for name in ("chosen", "rejected") for c in (
            _rendered(F.col(f"{name}_after")).alias(f"{name}_completion"),
            F.size(f"{name}_after").alias(f"{name}_turns"),
            _spans(_segments(F.col(f"{name}_after"))).alias(f"{name}_trained"))])
