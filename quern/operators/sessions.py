"""Conversation memory as a batch: the last turns within a turn and a character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNS, CHARS = 6, 18_000


def session_id_valid(value: Column) -> Column:
    return F.rlike(value, F.lit("^[A-Za-z0-9_-]{1,128}$"))


def session_key(path: Column, session: Column) -> Column:
    return F.concat_ws("::", F.lower(path), session)


def remembered(turns: DataFrame, session: str, order: str, chars: Column, max_turns: int = TURNS, max_chars: int = CHARS) -> DataFrame:
    """The rows kept: the last ``max_turns`` whose running sum from the newest fits; the newest always stays.

    Dropping strictly from the oldest end makes the kept rows a suffix, so one window from the newest decides.
    """
    newest = Window.partitionBy(session).orderBy(F.desc(order))
    rows = turns.withColumns(
        {"_n": F.row_number().over(newest), "_sum": F.sum(chars).over(newest.rowsBetween(Window.unboundedPreceding, 0))}
    )
    return rows.where((F.col("_n") <= max_turns) & ((F.col("_sum") <= max_chars) | (F.col("_n") == 1))).drop("_n", "_sum")


def memory_status(kept: DataFrame, session: str, chars: Column, max_turns: int = TURNS, max_chars: int = CHARS) -> DataFrame:
    return kept.groupBy(session).agg(
        F.count(F.lit(1)).alias("turn_count"), F.sum(chars).cast("long").alias("character_count"),
        F.lit(max_turns).cast("long").alias("max_turns"), F.lit(max_chars).cast("long").alias("max_chars"),
    )
