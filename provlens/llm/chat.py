"""Operator 7: preference pairs as one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def render(role: Column, text: Column) -> Column:
    """A turn in the template; markers inside a role or text are broken up, so a turn can't forge one."""
    safe = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"<\|(im_(?:start|end)\|>)", "<| $1")
    return F.concat(F.lit(OPEN), safe(role), F.lit("\n"), safe(text), F.lit(CLOSE + "\n"))


def preference_segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rendered turns of every pair: pair_id, part, turn, role, rendered, loss.

    Both sides have ``pair_id``, ``turn``, ``role`` and ``text``; other columns are not looked
    at. The longest run of first turns that are equal on both sides comes once, as part
    ``prompt``; the rest comes as parts ``chosen`` and ``rejected``, where ``loss`` marks the
    turns of the assistant. A part's text is its turns in order of turn, role and text.

    A null turn comes before all others; a row that repeats counts once; rows of one turn
    that differ all belong to it, so a turn is equal where all its rows are. A pair that only
    one side has is all completion, equal sides are all prompt. Turns are compared where they
    meet by hash, so a conversation of any length is never in one task.
    """
    side = lambda df, n: df.select("pair_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.lit(n).alias("side"))
    turns = side(chosen, 0).unionByName(side(rejected, 1)).groupBy("pair_id", "turn", "role", "text").agg(
        F.min("side").alias("low"), F.max("side").alias("high"))
    place = F.struct(F.col("turn").isNotNull().alias("k"), F.col("turn").alias("t"))
    differs = turns.filter("low = high").groupBy("pair_id").agg(F.min(place).alias("_from"))
    joined = turns.join(differs.withColumnRenamed("pair_id", "_pair"), F.col("pair_id").eqNullSafe(F.col("_pair")), "left")
    part = (F.when(F.col("_from").isNull() | (place < F.col("_from")), F.array(F.lit("prompt")))
            .when(F.col("low") < F.col("high"), F.array(F.lit("chosen"), F.lit("rejected")))
            .when(F.col("low") == 0, F.array(F.lit("chosen"))).otherwise(F.array(F.lit("rejected"))))
    return (joined.withColumn("part", F.explode(part))
            .select("pair_id", "part", "turn", "role", render(F.col("role"), F.col("text")).alias("rendered"),
                    ((F.col("part") != "prompt") & F.coalesce(F.col("role") == TRAINED_ROLE, F.lit(False))).alias("loss")))


def assembled(segments: DataFrame) -> DataFrame:
    """A row per pair: prompt, chosen, rejected, and for each completion the spans to train on.

    Spans are (start, length) in characters of the completion. One row holds a whole pair,
    so this is for conversations that fit in one.
    """
    ordered = F.sort_array(F.collect_list(F.struct(F.col("turn").isNotNull().alias("k"), "turn", "role", "rendered", "loss")))
    parts = segments.groupBy("pair_id", "part").agg(ordered.alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["rendered"]), "")
    spans = F.aggregate("s", F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start: int, length: int>>)").alias("out")),
                        lambda a, x: F.struct(
                            (a["at"] + F.length(x["rendered"])).alias("at"),
                            F.when(x["loss"], F.concat(a["out"], F.array(F.struct(
                                a["at"].alias("start"), F.length(x["rendered"]).alias("length"))))).otherwise(a["out"]).alias("out")),
                        lambda a: a["out"])
    made = parts.select("pair_id", "part", text.alias("text"), spans.alias("spans"))
    of = lambda p, c: F.max(F.when(F.col("part") == p, F.col(c)))
    return made.groupBy("pair_id").agg(
        F.coalesce(of("prompt", "text"), F.lit("")).alias("prompt"), F.coalesce(of("chosen", "text"), F.lit("")).alias("chosen"),
        F.coalesce(of("rejected", "text"), F.lit("")).alias("rejected"), of("chosen", "spans").alias("chosen_spans"),
        of("rejected", "spans").alias("rejected_spans"))


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """A worse version of each conversation: its last answer is the partner's (id 2k and 2k + 1).

    Turns after the last answer are left out; without a partner the answer is left out too, and
    a conversation without an answer stays as it is. Columns: pair_id, turn, role, text.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    answers = turns.filter((F.col("role") == TRAINED_ROLE) & F.col("turn").isNotNull()).groupBy("pair_id").agg(
        F.max(F.struct("turn", "text")).alias("a")).select("pair_id", "a.turn", "a.text")
    last = answers.select(F.col("pair_id").alias("_pair"), F.col("turn").alias("_last"))
    before = turns.join(last, F.col("pair_id") == F.col("_pair"), "left") \
        .filter("_last IS NULL OR turn IS NULL OR turn < _last").select("pair_id", "turn", "role", "text")
    other = answers.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), "text")
    swapped = last.join(other, F.col("_pair") == F.col("pair_id")).select(
        "pair_id", F.col("_last").alias("turn"), F.lit(TRAINED_ROLE).alias("role"), "text")
    return before.unionByName(swapped)


def preferences(conversations: DataFrame) -> DataFrame:
    """Segments for each conversation against its version with the partner's answer."""
    chosen = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), "turn", "role", "text")
    return preference_segments(chosen, swapped_answers(conversations))
