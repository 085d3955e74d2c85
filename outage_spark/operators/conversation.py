"""Chat turns: cleaning, pending chats, question/answer pairs and the context of every turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outage_spark.operators.spread import OrderedRows, concat_text, lookup_join, top_per_key

SEP = "\n"


def clean_turns(conv: DataFrame) -> DataFrame:
    """Drop malformed messages: those without a role."""
    return conv.where(F.col("role").isNotNull())


def pending_turns(conv: DataFrame) -> DataFrame:
    """Last turn of every chat that waits for an answer: its last message, well-formed or not, is the user's."""
    rows = conv.select("conv_id", "turn", "role", "text")
    last = top_per_key(rows, ["conv_id"], [F.desc("turn"), F.desc("role"), F.desc("text")], 1, "_rank")
    return last.where(F.col("role") == "user").select("conv_id", "turn", "text")


def pending_context(conv: DataFrame, part_chars: int = 1_000_000, runs: int | None = None) -> DataFrame:
    """The whole earlier transcript of every pending chat, in numbered parts (see ``join_parts``).

    Needed once per chat that is answered, hence as large as those chats and no larger. A chat without
    earlier turns has one empty part 0.
    """
    pending = pending_turns(conv).select("conv_id", F.col("turn").alias("_asked"))
    chats = lookup_join(clean_turns(conv), pending, ["conv_id"], "inner")
    earlier = chats.where(F.col("turn") < F.col("_asked")).drop("_asked")
    parts = concat_text(earlier, ["conv_id"], ["turn"], "text", SEP, part_chars, runs)
    rows = pending.join(parts, "conv_id", "left")
    return rows.select(
        "conv_id",
        F.col("_asked").alias("turn"),
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("text", F.lit("")).alias("context"),
    )


def join_parts(parts: DataFrame, keys: list[str], text: str, sep: str = SEP) -> DataFrame:
    """Numbered parts put together again, for texts that fit into one row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", F.col(text).alias("t")))), lambda p: p.t)
    return parts.groupBy(*keys).agg(F.array_join(ordered, sep).alias(text))


def question_answer_pairs(conv: DataFrame, runs: int | None = None) -> DataFrame:
    """Every user turn with the assistant turn that follows it directly."""
    rows = OrderedRows(clean_turns(conv), ["conv_id"], ["turn"], runs).with_next(["role", "text"], "_next").rows
    answered = (F.col("role") == "user") & (F.col("_next.role") == "assistant")
    return rows.where(answered).select(
        "conv_id", "turn", F.col("text").alias("question"), F.col("_next.text").alias("answer")
    )


def transcript(conv: DataFrame, part_chars: int = 1_000_000, runs: int | None = None) -> DataFrame:
    """The text of every chat, turns joined by newlines, in numbered parts."""
    return concat_text(clean_turns(conv), ["conv_id"], ["turn"], "text", SEP, part_chars, runs)


def context_turns(conv: DataFrame, max_turns: int | None = None, runs: int | None = None) -> DataFrame:
    """The context of every turn: all earlier turns of its chat, newest last.

    A context is a beginning of the chat's transcript, so it is given by its length: the first
    ``context_chars`` characters of ``transcript`` (parts joined by newlines), which is
    ``context_turns`` turns. Copying the text into every turn would grow with the square of the
    chat. With ``max_turns`` the text of that many latest turns is added as ``recent``.
    """
    turns = clean_turns(conv).withColumn("_chars", F.coalesce(F.length("text") + len(SEP), F.lit(0)))
    rows = OrderedRows(turns, ["conv_id"], ["turn"], runs).with_number("_no").with_sum_before("_chars", "_before").rows
    columns = [
        "conv_id",
        "turn",
        "role",
        (F.col("_no") - 1).alias("context_turns"),
        F.greatest(F.col("_before") - len(SEP), F.lit(0)).alias("context_chars"),
    ]
    if max_turns is None:
        return rows.select(*columns)
    # Turn n is recent context for turns n+1 .. n+max_turns: a fixed number of copies per turn.
    numbered = rows.select(*columns, F.col("_no"), F.col("text"))
    offered = numbered.select(
        "conv_id",
        F.explode(F.sequence(F.col("_no") + 1, F.col("_no") + max_turns)).alias("_no"),
        F.struct(F.col("_no").alias("n"), "text").alias("_piece"),
    )
    recent = offered.groupBy("conv_id", "_no").agg(F.array_sort(F.collect_list("_piece"))["text"].alias("_texts"))
    joined = numbered.join(recent, ["conv_id", "_no"], "left")
    text = F.coalesce(F.array_join("_texts", SEP), F.lit(""))
    return joined.select("conv_id", "turn", "role", "context_turns", "context_chars", text.alias("recent"))


def append_answers(conv: DataFrame, answers: DataFrame, order=("text",), runs: int | None = None) -> DataFrame:
    """Add (conv_id, text) answers as assistant turns after the last turn of their chat, in the given order."""
    last = conv.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    tied = answers.withColumn("_tie", F.monotonically_increasing_id())
    numbered = OrderedRows(tied, ["conv_id"], [*order, "_tie"], runs).with_number("_no").rows
    turns = lookup_join(numbered, last, ["conv_id"], "left").select(
        "conv_id",
        (F.coalesce("_last", F.lit(-1)) + F.col("_no")).cast("bigint").alias("turn"),
        F.lit("assistant").alias("role"),
        "text",
    )
    return conv.select("conv_id", "turn", "role", "text").unionByName(turns)
