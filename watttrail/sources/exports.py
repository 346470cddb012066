"""Readers of small exports: commits, claims, tool calls, price scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watttrail.plans.packs import SCENARIOS, read_document, scenario_table


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``(repo, sha, commit_ts, commit_ts_raw)`` from CSV lines ``repo,sha,time`` as git prints it."""
    rows = spark.read.schema("repo string, sha string, commit_ts_raw string").csv(path)
    return rows.select("repo", "sha", F.try_to_timestamp("commit_ts_raw").alias("commit_ts"), "commit_ts_raw")


def claims(spark: SparkSession, path: str) -> DataFrame:
    """Latest claim of each session and repository from a log; rows that lack a field are skipped."""
    rows = spark.read.schema("session_id string, repo string, ts_hi string").json(path)
    rows = rows.withColumn("ts_hi", F.try_to_timestamp("ts_hi")).na.drop()
    return rows.groupBy("session_id", "repo").agg(F.max("ts_hi").alias("ts_hi"))


def tool_calls(spark: SparkSession, path: str) -> DataFrame:
    """``(session_id, cwd, command, transcript_path)`` from a log of tool calls."""
    kind = "session_id string, transcript_path string, cwd string, tool_input struct<command: string>"
    return spark.read.schema(kind).json(path).select("session_id", "cwd", F.col("tool_input.command").alias("command"), "transcript_path")


def scenarios(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Price scenarios from a document with ``price_scenarios``, or the built-in ones."""
    return scenario_table(spark, read_document(spark, path).get("price_scenarios") or {} if path else SCENARIOS)
