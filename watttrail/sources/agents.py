"""Readers of coding agents' session logs, each giving the columns of a turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watttrail.functions.text import time_of_millis
from watttrail.operators.turns import TurnSource, carry_forward, compaction_events
from watttrail.sources.lines import amount, get, parsed, read_lines, text_or, with_file_order

_USAGE = "coalesce(try_variant_get(v, '$.message.usage', 'variant'), try_variant_get(v, '$.usage', 'variant'))"


def claude_records(lines: DataFrame) -> DataFrame:
    """Records that report usage, whatever their type; one message may be logged several times."""
    rows = parsed(with_file_order(lines)).withColumn("u", F.expr(_USAGE))
    rows = rows.where(F.schema_of_variant("u").startswith("OBJECT<") & (F.to_json("u") != "{}"))
    count = lambda name: amount(f"$.{name}", of="u")
    return rows.select(
        F.lit("claude-code").alias("agent"),
        "session_id",
        text_or(get("$.message.id"), get("$.requestId"), get("$.uuid"), get("$.timestamp")).alias("msg_id"),
        F.try_to_timestamp(get("$.timestamp")).alias("ts"),
        get("$.timestamp").alias("ts_raw"),
        get("$.type").alias("type"),
        F.coalesce(get("$.message.model"), F.lit("?")).alias("model"),
        count("input_tokens").alias("input"),
        count("cache_creation_input_tokens").alias("cache_write"),
        count("cache_read_input_tokens").alias("cache_read"),
        count("output_tokens").alias("output"),
        count("server_tool_use.web_search_requests").alias("web_search"),
        count("server_tool_use.web_fetch_requests").alias("web_fetch"),
        "path",
        "file_order",
        "line_no",
    )


def claude_turns(spark: SparkSession, path: str) -> DataFrame:
    return claude_records(read_lines(spark, path))


def summary_text(content: str) -> F.Column:
    """Text of a message: a string, or the text parts of a list joined."""
    parts = F.try_variant_get("v", content, "array<struct<type: string, text: string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return F.coalesce(joined, get(content), F.lit(""))


def claude_compactions(lines: DataFrame) -> DataFrame:
    """Compactions of main transcripts: peak context and length of the summary."""
    rows = parsed(with_file_order(lines)).where("v is not null and file_order = ''").withColumn("u", F.expr(_USAGE))
    has_usage = F.coalesce(F.schema_of_variant("u").startswith("OBJECT<") & (F.to_json("u") != "{}"), F.lit(False))
    size = amount("$.input_tokens", of="u") + amount("$.cache_creation_input_tokens", of="u") + amount("$.cache_read_input_tokens", of="u")
    numbered = rows.withColumn("record_no", F.row_number().over(W.partitionBy("path").orderBy("line_no")))
    records = numbered.select(
        F.lit("claude-code").alias("agent"),
        "session_id",
        "path",
        "record_no",
        get("$.timestamp").alias("boundary_raw"),
        F.try_to_timestamp(get("$.timestamp")).alias("boundary_ts"),
        F.coalesce((get("$.type") == "system") & (get("$.subtype") == "compact_boundary"), F.lit(False)).alias("is_boundary"),
        F.when(has_usage, size).alias("context"),
        F.when(has_usage, get("$.message.model")).alias("model"),
        F.when(get("$.isCompactSummary", "boolean"), summary_text("$.message.content")).alias("summary"),
    )
    return compaction_events(records, ["path"], "record_no").where("boundary_raw is not null")


def claude_sessions(lines: DataFrame) -> DataFrame:
    """``(session_id, path, mtime, cwd)``: the first working directory each main transcript names."""
    rows = parsed(with_file_order(lines)).where("file_order = ''")
    first = F.min(F.when(get("$.cwd").isNotNull(), F.struct("line_no", get("$.cwd").alias("cwd"))))
    return rows.groupBy("session_id", "path").agg(F.max("mtime").alias("mtime"), first["cwd"].alias("cwd"))


def codex_records(lines: DataFrame) -> DataFrame:
    """Token-count events, which report the last call alone; the model comes from the last context."""
    rows = parsed(with_file_order(lines)).where("v is not null")
    named = F.when(get("$.type") == "turn_context", text_or(get("$.payload.model")))
    rows = rows.withColumn("model", F.coalesce(carry_forward(named, ["session_id"], ["file_order", "path", "line_no"]), F.lit("?")))
    rows = rows.withColumn("u", get("$.payload.info.last_token_usage", "variant"))
    rows = rows.where((get("$.payload.type") == "token_count") & F.schema_of_variant("u").startswith("OBJECT") & (text_or(get("$.timestamp")) != ""))
    total, cached, out = (amount(f"$.{c}", of="u") for c in ("input_tokens", "cached_input_tokens", "output_tokens"))
    zero = F.lit(0).cast("long")
    return rows.select(
        F.lit("codex").alias("agent"),
        "session_id",
        F.concat_ws(":", get("$.timestamp"), total.cast("string"), cached.cast("string"), out.cast("string")).alias("msg_id"),
        F.try_to_timestamp(get("$.timestamp")).alias("ts"),
        get("$.timestamp").alias("ts_raw"),
        F.lit("token_count").alias("type"),
        "model",
        F.greatest(zero, total - cached).alias("input"),
        zero.alias("cache_write"),
        cached.alias("cache_read"),
        out.alias("output"),
        zero.alias("web_search"),
        zero.alias("web_fetch"),
        "path",
        "file_order",
        "line_no",
    )


def codex_turns(spark: SparkSession, path: str) -> DataFrame:
    return codex_records(read_lines(spark, path))


def codex_sessions(lines: DataFrame) -> DataFrame:
    """``(session_id, path, mtime, cwd, workspace_roots)`` of each transcript's first mention."""
    rows = parsed(with_file_order(lines))
    where = lambda c: F.min(F.when(c.isNotNull(), F.struct(F.col("line_no"), c.alias("x"))))["x"]
    roots = F.flatten(F.collect_set(F.coalesce(get("$.payload.workspace_roots", "array<string>"), F.array().cast("array<string>"))))
    return rows.groupBy("session_id", "path").agg(
        F.max("mtime").alias("mtime"), where(get("$.payload.cwd")).alias("cwd"), F.array_distinct(roots).alias("workspace_roots")
    )


def opencode_records(messages: DataFrame) -> DataFrame:
    """Billed assistant messages of an exported ``message(id, session_id, time_created, data)`` table."""
    rows = messages.withColumn("v", F.try_parse_json("data"))
    tokens = {c: amount(f"$.tokens.{c}") for c in ("input", "output", "reasoning", "cache.write", "cache.read")}
    rows = rows.where((get("$.role") == "assistant") & (F.greatest(*(F.abs(t) for t in tokens.values())) > 0))
    made = F.coalesce(time_of_millis(get("$.time.completed")), time_of_millis(get("$.time.created")), time_of_millis(F.col("time_created").cast("string")))
    zero = F.lit(0).cast("long")
    return rows.select(
        F.lit("opencode").alias("agent"),
        "session_id",
        F.col("id").alias("msg_id"),
        made.alias("ts"),
        F.lit(None).cast("string").alias("ts_raw"),
        F.lit("assistant").alias("type"),
        F.coalesce(get("$.modelID"), F.lit("?")).alias("model"),
        tokens["input"].alias("input"),
        tokens["cache.write"].alias("cache_write"),
        tokens["cache.read"].alias("cache_read"),
        (tokens["output"] + tokens["reasoning"]).alias("output"),
        zero.alias("web_search"),
        zero.alias("web_fetch"),
        F.lit(None).cast("string").alias("path"),
        F.lit("").alias("file_order"),
        zero.alias("line_no"),
    )


def opencode_turns(spark: SparkSession, path: str) -> DataFrame:
    return opencode_records(spark.read.parquet(f"{path}/message"))


SOURCES: dict[str, TurnSource] = {"claude-code": claude_turns, "codex": codex_turns, "opencode": opencode_turns}


def register(name: str, source: TurnSource) -> None:
    SOURCES[name] = source


def source(name: str) -> TurnSource:
    if name not in SOURCES:
        raise ValueError(f"no such source: {name}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[name]


def latest_transcript(sessions: DataFrame, by: list[str]) -> DataFrame:
    """The most recently changed transcript of each group; of equal times the greatest path."""
    top = F.max(F.struct("mtime", "path", "session_id")).alias("top")
    return sessions.groupBy(*by).agg(top).select(*by, "top.session_id", "top.path")


