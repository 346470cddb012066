"""The ledger: an append-only table of measurements, read with the latest version of each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watttrail.operators.turns import last_wins

TOKENS = ["input", "cache_write", "cache_read", "output"]
TOOLS = ["web_search", "web_fetch"]
MEASURED, COMPACTION = "measured", "compaction-estimate"
MODEL_TOKENS = "struct<input: bigint, cache_write: bigint, cache_read: bigint, output: bigint>"

SCHEMA = (
    "commit string, session_id string, agent string, kind string, activity string, models array<string>, turns bigint, "
    + ", ".join(f"{c} bigint" for c in [*TOKENS, "billable_input", *TOOLS])
    + f", by_model map<string, {MODEL_TOKENS}>, wall_clock_s double, ts_lo timestamp, ts_hi timestamp, commit_ts timestamp, "
    "recorded_at timestamp, boundary_ts timestamp, peak_context_tokens bigint, summary_chars bigint, repo string"
)


def span_seconds(lo: Column, hi: Column) -> Column:
    """Seconds between two times to one decimal; null if either is missing."""
    return F.round((F.unix_micros(hi) - F.unix_micros(lo)) / 1e6, 1)


def billable(tokens: Column | None = None) -> Column:
    get = (lambda c: tokens[c]) if tokens is not None else F.col
    return get("input") + get("cache_write") + get("cache_read")


def measured_rows(turns: DataFrame, recorded_at: Column) -> DataFrame:
    """One complete ledger row per repository, commit, session and agent.

    ``turns`` has ``repo``, ``commit``, ``commit_ts`` and optionally ``activity`` beside the turn
    columns. The activity is carried, not a part of the row's identity. Turns are first summed by
    model, so the second step handles a row per model; its sums come from the list of models,
    so that no figure passes its exchange twice.
    """
    keys = ["repo", "commit", "session_id", "agent"]
    activity = F.max("activity") if "activity" in turns.columns else F.lit(None).cast("string")
    by_model = turns.groupBy(*keys, "model").agg(
        *(F.sum(c).alias(c) for c in [*TOKENS, *TOOLS]),
        F.count("*").alias("turns"),
        F.min("ts").alias("ts_lo"),
        F.max("ts").alias("ts_hi"),
        F.max("commit_ts").alias("commit_ts"),
        activity.alias("activity"),
    )
    counts = [*TOOLS, "turns"]
    rows = by_model.groupBy(*keys).agg(
        F.collect_list(F.struct("model", F.struct(*TOKENS).alias("tokens"), *counts)).alias("_models"),
        F.min("ts_lo").alias("ts_lo"),
        F.max("ts_hi").alias("ts_hi"),
        F.max("commit_ts").alias("commit_ts"),
        F.max("activity").alias("activity"),
    )
    each = F.col("_models")
    total = lambda x: F.aggregate(x, F.lit(None).cast("long"), lambda a, b: F.coalesce(a + b, a, b))
    rows = rows.withColumns({
        **{c: total(each["tokens"][c]) for c in TOKENS},
        **{c: total(each[c]) for c in counts},
        "models": F.array_sort(F.array_compact(each["model"])),
        "by_model": F.map_from_arrays(each["model"], each["tokens"]),
    })
    return rows.select(
        *keys,
        F.lit(MEASURED).alias("kind"),
        "activity",
        "models",
        "turns",
        *TOKENS,
        billable().alias("billable_input"),
        *TOOLS,
        "by_model",
        span_seconds(F.col("ts_lo"), F.col("ts_hi")).alias("wall_clock_s"),
        "ts_lo",
        "ts_hi",
        "commit_ts",
        recorded_at.alias("recorded_at"),
        F.lit(None).cast("timestamp").alias("boundary_ts"),
        F.lit(None).cast("long").alias("peak_context_tokens"),
        F.lit(None).cast("long").alias("summary_chars"),
    )


def compaction_rows(compactions: DataFrame, recorded_at: Column) -> DataFrame:
    """Ledger rows of compactions: the measured payload is empty."""
    none = {"activity": "string", "turns": "long", "billable_input": "long", "wall_clock_s": "double", "ts_lo": "timestamp", "ts_hi": "timestamp"}
    none |= dict.fromkeys([*TOKENS, *TOOLS], "long") | {"by_model": f"map<string, {MODEL_TOKENS}>"}
    return compactions.select(
        "repo", "commit", "session_id", "agent",
        F.lit(COMPACTION).alias("kind"),
        F.array("model").alias("models"),
        *(F.lit(None).cast(t).alias(c) for c, t in none.items()),
        "commit_ts",
        recorded_at.alias("recorded_at"),
        "boundary_ts", "peak_context_tokens", "summary_chars",
    )


def identity() -> list[Column]:
    """What makes two ledger rows versions of one: see ``latest_rows``."""
    compaction = F.col("kind") == COMPACTION
    pending = F.col("commit").startswith("pending@")
    return [
        F.col("repo"),
        F.coalesce("agent", F.lit("unknown")),
        F.coalesce("session_id", F.lit("")),
        F.when(compaction, F.lit("compaction")).otherwise(F.coalesce("commit", F.lit(""))),
        F.when(compaction, F.col("boundary_ts")).when(pending, F.col("ts_hi")),
    ]


def latest_rows(rows: DataFrame) -> DataFrame:
    """The latest version of each row.

    Measured rows are one by repository, agent, session and commit; pending ones also by their
    last turn; compactions by boundary. The latest ``recorded_at`` wins, then the later source
    and line (``src_order``, ``line_no`` where present).
    """
    keyed = rows
    for k, part in enumerate(identity()):
        keyed = keyed.withColumn(f"_k{k}", part)
    order = [F.desc_nulls_last("recorded_at"), *(F.desc(c) for c in ("src_order", "line_no") if c in rows.columns)]
    keys = [f"_k{k}" for k in range(5)]
    return last_wins(keyed, keys, order).drop(*keys)


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to the ledger; nothing is ever rewritten."""
    rows.write.mode("append").partitionBy("repo").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return latest_rows(spark.read.parquet(path))
