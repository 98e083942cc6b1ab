"""Stop rule and speaking order over tables of conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a conversation has at most this many rounds.
MAX_ROUNDS = 12


def last_message(
    messages: DataFrame,
    *,
    conv: str = "conv_id",
    order: str = "turn",
    author: str = "role",
    text: str = "text",
    system: str = "system",
) -> DataFrame:
    """Newest message of each conversation that has an author other than ``system``.

    Conversations without one are kept with NULL.
    """
    spoken = (F.col(author) != "") & (F.col(author) != system)
    newest = F.max(F.when(spoken, F.struct(order, author, F.coalesce(text, F.lit("")).alias(text))))
    return messages.groupBy(conv).agg(newest.alias("m")).select(
        conv, F.col(f"m.{order}").alias("last_turn"), F.col(f"m.{author}").alias("last_author"), F.col(f"m.{text}").alias("last_text")
    )


def is_terminated(messages: DataFrame, marker: str, **columns: str) -> DataFrame:
    """Whether the last spoken message holds the approval marker; of a text only the marker is exchanged."""
    text = columns.get("text", "text")
    held = F.when(F.contains(text, F.lit(marker)), F.lit(marker)).otherwise(F.lit(""))
    last = last_message(messages.withColumn(text, held), **columns)
    done = F.coalesce(F.contains("last_text", F.lit(marker)), F.lit(False))
    return last.select(last.columns[0], done.alias("terminated"))


def expected_speaker(round_no: Column, opening: Sequence[str], cycle: Sequence[str]) -> Column:
    """The opening list once, then the cycle over and over."""
    first = F.array(*[F.lit(s) for s in opening])
    again = F.array(*[F.lit(s) for s in cycle])
    place = F.pmod(round_no - len(opening), F.lit(len(cycle)))
    return F.when(round_no < len(opening), F.get(first, round_no.cast("int"))).otherwise(F.get(again, place.cast("int")))


def turn_order_check(
    messages: DataFrame,
    opening: Sequence[str],
    cycle: Sequence[str],
    *,
    round_no: str = "turn",
    author: str = "role",
    max_rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """Add who should have spoken, whether they did, and whether the round was within the limit. A narrow step."""
    expected = expected_speaker(F.col(round_no), opening, cycle)
    return messages.withColumns(
        {
            "expected_role": expected,
            "in_order": F.coalesce(F.col(author) == expected, F.lit(False)),
            "within_limit": F.col(round_no) < max_rounds,
        }
    )
