"""The compact JSON form of ledger rows: short keys, token counts by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watttrail.operators.ledger import COMPACTION, MEASURED, TOKENS, TOOLS, billable

VERSION = 3
#: Keys of the wire form (fixed values) and of the older long form, which is read as it is.
_SCHEMA = """
v int, rec string, r string, c string, ct string, a string, sid string, m array<string>, act string, k string, bt string,
cp array<bigint>, n bigint, t array<bigint>, bm map<string, array<bigint>>, st array<bigint>, w double, tr array<string>,
schema string, recorded_at string, repo string, commit string, commit_ts string, agent string, activity string,
session_id string, models array<string>, kind string, turns bigint, boundary_ts string, turn_ts_range array<string>,
tokens struct<input: bigint, cache_write: bigint, cache_read: bigint, output: bigint>,
by_model map<string, struct<input: bigint, cache_write: bigint, cache_read: bigint, output: bigint>>,
server_tools struct<web_search: bigint, web_fetch: bigint>, time struct<wall_clock_s: double>,
compaction struct<peak_context_tokens: bigint, summary_chars: bigint>
"""
_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _text(ts: str) -> Column:
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), _TIME)


def encode(rows: DataFrame) -> DataFrame:
    """``(repo, value)``: each row as one line of compact JSON. Absent keys mean null, 0 or empty."""
    measured = F.col("kind") == MEASURED
    four = lambda t: F.array(*(F.coalesce(t[c], F.lit(0)) for c in TOKENS))
    counts = F.array(*(F.coalesce(c, F.lit(0)) for c in TOKENS))
    tools = F.array(*(F.coalesce(c, F.lit(0)) for c in TOOLS))
    split = F.transform_values("by_model", lambda _, t: four(t))
    line = F.struct(
        F.lit(VERSION).alias("v"),
        _text("recorded_at").alias("rec"),
        F.col("repo").alias("r"),
        F.col("commit").alias("c"),
        _text("commit_ts").alias("ct"),
        F.col("agent").alias("a"),
        F.col("session_id").alias("sid"),
        F.coalesce("models", F.array().cast("array<string>")).alias("m"),
        F.col("activity").alias("act"),
        F.when(~measured, "cx").alias("k"),
        F.when(~measured, _text("boundary_ts")).alias("bt"),
        F.when(~measured, F.array(F.coalesce("peak_context_tokens", F.lit(0)), F.coalesce("summary_chars", F.lit(0)))).alias("cp"),
        F.when(measured, F.coalesce("turns", F.lit(0))).alias("n"),
        F.when(measured, counts).alias("t"),
        F.when(measured & (F.size("by_model") > 0), split).alias("bm"),
        F.when(measured & (tools[0] + tools[1] > 0), tools).alias("st"),
        F.when(measured, F.col("wall_clock_s")).alias("w"),
        F.when(measured, F.array(_text("ts_lo"), _text("ts_hi"))).alias("tr"),
    )
    return rows.select("repo", F.to_json(line).alias("value"))


def decode(lines: DataFrame, value: str = "value") -> DataFrame:
    """Ledger rows from lines of compact or long JSON, beside the other columns of ``lines``.

    ``corrupt`` is true, and all else null, where a line is no JSON object. Counts given as too
    few positions are filled with 0, surplus positions are ignored.
    """
    parsed = F.from_json(value, f"{_SCHEMA}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.withColumn("_d", parsed).withColumn("_ok", F.col("_d").isNotNull() & F.col("_d._corrupt").isNull() & F.trim(value).startswith("{"))
    rows = rows.where(F.trim(value) != "").withColumn("_d", F.when(F.col("_ok"), F.col("_d")))
    d = lambda c: F.col(f"_d.{c}")
    long_form = d("tokens").isNotNull() | d("schema").isNotNull() | d("v").isNull()
    pick = lambda short, full: F.when(long_form, d(full)).otherwise(d(short))
    at = lambda array, k: F.coalesce(F.get(array, F.lit(k)), F.lit(0).cast("long"))
    compaction = F.when(long_form, d("kind") == COMPACTION).otherwise(F.coalesce(d("k") == "cx", F.lit(False)))
    compaction = F.coalesce(compaction, F.lit(False))
    counts = {c: F.when(~compaction, F.when(long_form, F.coalesce(d(f"tokens.{c}"), F.lit(0))).otherwise(at(d("t"), k))) for k, c in enumerate(TOKENS)}
    tools = {c: F.when(~compaction, F.when(long_form, F.coalesce(d(f"server_tools.{c}"), F.lit(0))).otherwise(at(d("st"), k))) for k, c in enumerate(TOOLS)}
    four = lambda a: F.struct(*(at(a, k).alias(c) for k, c in enumerate(TOKENS)))
    split = F.when(long_form, d("by_model")).otherwise(F.transform_values(d("bm"), lambda _, a: four(a)))
    time = lambda c: F.try_to_timestamp(c)
    span = pick("tr", "turn_ts_range")
    out = rows.select(
        *[c for c in lines.columns if c not in (value, "repo")],
        (~F.col("_ok")).alias("corrupt"),
        pick("r", "repo").alias("repo"),
        pick("c", "commit").alias("commit"),
        pick("sid", "session_id").alias("session_id"),
        pick("a", "agent").alias("agent"),
        F.when(F.col("_ok"), F.when(compaction, COMPACTION).otherwise(MEASURED)).alias("kind"),
        pick("act", "activity").alias("activity"),
        pick("m", "models").alias("models"),
        F.when(~compaction, F.coalesce(pick("n", "turns"), F.lit(0))).alias("turns"),
        *(v.alias(c) for c, v in counts.items()),
        *(v.alias(c) for c, v in tools.items()),
        split.alias("by_model"),
        F.when(long_form, d("time.wall_clock_s")).otherwise(d("w")).alias("wall_clock_s"),
        time(F.get(span, F.lit(0))).alias("ts_lo"),
        time(F.get(span, F.lit(1))).alias("ts_hi"),
        time(pick("ct", "commit_ts")).alias("commit_ts"),
        time(pick("rec", "recorded_at")).alias("recorded_at"),
        time(pick("bt", "boundary_ts")).alias("boundary_ts"),
        F.when(compaction, F.when(long_form, d("compaction.peak_context_tokens")).otherwise(at(d("cp"), 0))).alias("peak_context_tokens"),
        F.when(compaction, F.when(long_form, d("compaction.summary_chars")).otherwise(at(d("cp"), 1))).alias("summary_chars"),
    )
    return out.withColumn("billable_input", billable())
