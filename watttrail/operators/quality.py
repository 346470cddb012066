"""Health of a ledger and of the transcripts behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Transcripts kept for fewer days risk vanishing before they are recorded.
SAFE_RETENTION_DAYS, DEFAULT_RETENTION_DAYS = 90, 30


def ledger_health(lines: DataFrame) -> DataFrame:
    """Readable and corrupt rows and files of ledger ``lines(path, src_order, corrupt)``."""
    return lines.agg(
        F.count(F.when(~F.col("corrupt"), 1)).alias("readable_rows"),
        F.count(F.when(F.col("corrupt"), 1)).alias("corrupt_rows"),
        F.count_distinct("path").alias("files"),
        F.count(F.when(~F.col("corrupt") & (F.col("src_order") > 0), 1)).alias("note_rows"),
    )


def retention_risk(retention: DataFrame, oldest: DataFrame) -> DataFrame:
    """Agents with their retention days and the age of their oldest transcript.

    ``retention(agent, days)`` may lack agents or days; ``oldest(agent, age_days)`` likewise.
    """
    days = F.coalesce("days", F.lit(DEFAULT_RETENTION_DAYS))
    joined = oldest.join(retention, "agent", "left")
    return joined.select("agent", days.alias("retention_days"), "age_days", (days < SAFE_RETENTION_DAYS).alias("at_risk"))


def source_coverage(agents: DataFrame, repos: DataFrame, matched: DataFrame) -> DataFrame:
    """For each repository and registered agent, the number of sessions found.

    ``agents`` is the short list of registered sources, a configuration.
    """
    counts = matched.groupBy("repo", "agent").agg(F.count_distinct("session_id").alias("sessions"))
    listed = F.array(*(F.lit(r.agent) for r in agents.collect()))
    grid = repos.select("repo", F.explode(listed).alias("agent"))
    return grid.join(counts, ["repo", "agent"], "left").select("repo", "agent", F.coalesce("sessions", F.lit(0)).alias("sessions"))
