"""Turns: one measurement for each call of a model, the last record of a message winning."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A source of turns: reads a path and returns the columns of ``TURN_COLUMNS``.
TurnSource = Callable[[SparkSession, str], DataFrame]

TURN_COLUMNS = [
    "agent", "session_id", "msg_id", "ts", "ts_raw", "type", "model", "input", "cache_write", "cache_read", "output",
    "web_search", "web_fetch", "path", "file_order", "line_no",
]


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the one that ``order`` puts first."""
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def dedup_turns(records: DataFrame) -> DataFrame:
    """The last record of each message of a session, by file and line order.

    Messages whose last record has no time are dropped after that choice, so a late record
    without a time removes its turn.
    """
    order = [F.desc("file_order"), F.desc("line_no")]
    return last_wins(records, ["agent", "session_id", "msg_id"], order).where("ts is not null")


def context_size() -> Column:
    """Tokens that a turn sends: fresh, written to and read from cache."""
    return F.col("input") + F.col("cache_write") + F.col("cache_read")


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Turns of several independent sources."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def carry_forward(value: Column, by: list[str], order: list[str]) -> Column:
    """The last non-null value up to the current row."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def compaction_events(records: DataFrame, by: list[str], order: str, ahead: int = 7) -> DataFrame:
    """One row per context compaction in ``records`` (raw, parsed records of one file each).

    ``records`` has ``is_boundary``, ``context`` (the record's context size or null), ``model``
    (null if none) and ``summary`` (text, null unless the record is a summary). The peak is the
    largest context since the previous boundary, the boundary's own included. The model is the
    last seen, across boundaries. The summary is the first among the boundary and the ``ahead``
    records after it.
    """
    ordered = W.partitionBy(*by).orderBy(order)
    so_far = ordered.rowsBetween(W.unboundedPreceding, 0)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    segment = F.coalesce(F.sum(F.col("is_boundary").cast("int")).over(before), F.lit(0))
    seen = records.withColumn("_segment", segment).withColumn("_model", F.last("model", ignorenulls=True).over(so_far))
    seen = seen.withColumn("_summary", F.first("summary", ignorenulls=True).over(ordered.rowsBetween(0, ahead)))
    inside = W.partitionBy(*by, "_segment").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return seen.withColumn("_peak", F.max("context").over(inside)).where("is_boundary").select(
        *[c for c in records.columns if c not in ("model", "context", "summary", "is_boundary")],
        F.coalesce("_model", F.lit("?")).alias("model"),
        F.coalesce("_peak", F.lit(0)).cast("long").alias("peak_context_tokens"),
        F.length(F.coalesce("_summary", F.lit(""))).cast("long").alias("summary_chars"),
    )
