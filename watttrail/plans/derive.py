"""The ledger's input tables, derived from ``events`` and ``conversations``, in Spark and in SQL.

A purchase is a commit and any other event a turn: its user is the session, ten repositories
share the users, and every fifth turn is logged twice with one more output token the second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watttrail.operators import ledger as ledgers
from watttrail.operators.attribution import commit_label, next_boundary
from watttrail.operators.turns import compaction_events, dedup_turns
from watttrail.plans.packs import BASELINE, Pack
from watttrail.session import table

SWEEP = "2024-02-01"
#: The baseline with prices for two of the models here, a grid by date and regions.
PACK = Pack.of(
    {
        **BASELINE,
        "electricity_usd_per_kwh": 0.12,
        "server_tool_kwh_per_call": 0.0005,
        "models": {
            "m-view": {"wh_per_output_token": 0.0005, "pricing_usd_per_mtok": {"input": 15.0, "cache_write": 18.75, "cache_read": 1.5, "output": 75.0}},
            "m-click": {"pricing_usd_per_mtok": {"input": 1.25, "output": 10.0}},
        },
    }
)
DATED = Pack.of(
    {
        **PACK.document,
        "grid": {"gco2e_per_kwh": 475, "intensity_by_date": [{"from": "2024-01-05", "gco2e_per_kwh": 100}, {"from": "2024-01-15", "gco2e_per_kwh": [300, 500, 800]}]},
    }
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", k.alias("k"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn records with repeats."""
    e = events(spark, sf_dir).where("event_type <> 'purchase'")
    once = e.selectExpr(
        "case user_id % 3 when 0 then 'claude-code' when 1 then 'codex' else 'opencode' end agent",
        "concat('s', user_id) session_id",
        "cast(event_id as string) msg_id",
        "ts",
        "concat('m-', event_type) model",
        "k * 10 input",
        "k * (user_id % 5) cache_write",
        "k * 100 cache_read",
        "cast(floor(value) as bigint) output",
        "cast(if(event_id % 7 = 0, 1, 0) as bigint) web_search",
        "0L web_fetch",
        "concat('repo', user_id % 10) repo",
        "case event_id % 4 when 1 then 'impl' when 2 then 'review' when 3 then 'planning' end activity",
        "'' file_order",
        "0L line_no",
        "event_id",
    )
    again = once.where("event_id % 5 = 0").withColumns({"output": F.col("output") + 1, "line_no": F.lit(1).cast("long")})
    return once.unionByName(again).drop("event_id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_turns(records(spark, sf_dir))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'purchase'").selectExpr("md5(cast(event_id as string)) sha", "concat('repo', user_id % 10) repo", "ts commit_ts")


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = next_boundary(turns(spark, sf_dir), commits(spark, sf_dir), ["repo"], times=records(spark, sf_dir))
    return placed.withColumn("commit", commit_label(F.lit(SWEEP).cast("date")))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.measured_rows(attributed(spark, sf_dir), F.coalesce("commit_ts", F.lit(SWEEP).cast("timestamp")))


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id",
        "turn",
        "turn % 3 = 2 is_boundary",
        "cast(length(text) as bigint) context",
        "if(role = 'assistant', concat('m', conv_id % 2), null) model",
        "if(role = 'user' and turn % 3 <> 2, text, null) summary",
    )


def compactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compaction_events(conversation_records(spark, sf_dir), ["conv_id"], "turn")
    at = F.lit("2024-01-01").cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, cast(conv_id * 100 + turn as decimal(18, 6)))")
    return found.select(
        F.expr("concat('repo', conv_id % 10) repo"),
        F.lit(f"pending@{SWEEP}").alias("commit"),
        F.expr("concat('c', conv_id) session_id"),
        F.lit("claude-code").alias("agent"),
        F.lit(None).cast("timestamp").alias("commit_ts"),
        at.alias("boundary_ts"),
        "model",
        "peak_context_tokens",
        "summary_chars",
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledgers.compaction_rows(compactions(spark, sf_dir), F.lit(SWEEP).cast("timestamp"))
    return measured(spark, sf_dir).unionByName(rows)


#: The same tables for DuckDB, to stand before a final select.
SQL = """
with e as (
  select event_id, ts, user_id, event_type, value, cast(json_extract_string(props, '$.k') as bigint) k from events),
once as (
  select case user_id % 3 when 0 then 'claude-code' when 1 then 'codex' else 'opencode' end agent,
         's' || user_id session_id, cast(event_id as varchar) msg_id, ts, 'm-' || event_type model, k * 10 input,
         k * (user_id % 5) cache_write, k * 100 cache_read, cast(floor(value) as bigint) output,
         case when event_id % 7 = 0 then 1::bigint else 0::bigint end web_search, 0::bigint web_fetch, 'repo' || (user_id % 10) repo,
         case event_id % 4 when 1 then 'impl' when 2 then 'review' when 3 then 'planning' end activity, 0 line_no, event_id
  from e where event_type <> 'purchase'),
raw as (
  select * from once
  union all select * replace (output + 1 as output, 1 as line_no) from once where event_id % 5 = 0),
turns as (
  select * exclude (rn) from (
    select *, row_number() over (partition by agent, session_id, msg_id order by line_no desc) rn from raw) where rn = 1),
commits as (
  select md5(cast(event_id as varchar)) sha, 'repo' || (user_id % 10) repo, ts commit_ts from e where event_type = 'purchase'),
marks as (select repo, commit_ts, min(sha) sha from commits group by all),
attributed as (
  select t.*, c.sha, c.commit_ts, coalesce(c.sha, 'pending@2024-02-01') as commit
  from turns t asof left join marks c on t.repo = c.repo and t.ts <= c.commit_ts),
row_model as (
  select repo, commit, session_id, agent, model, sum(input)::bigint input, sum(cache_write)::bigint cache_write,
         sum(cache_read)::bigint cache_read, sum(output)::bigint output, sum(web_search)::bigint web_search,
         sum(web_fetch)::bigint web_fetch, count(*) turns, min(ts) ts_lo, max(ts) ts_hi, max(commit_ts) commit_ts,
         max(activity) activity
  from attributed group by all),
measured as (
  select repo, commit, session_id, agent, 'measured' kind, max(activity) activity,
         string_agg(distinct model, ',' order by model) models, count(*) n_models, sum(turns)::bigint turns, sum(input)::bigint input,
         sum(cache_write)::bigint cache_write, sum(cache_read)::bigint cache_read, sum(output)::bigint output,
         sum(input + cache_write + cache_read)::bigint billable_input, sum(web_search)::bigint web_search,
         sum(web_fetch)::bigint web_fetch, round((epoch_us(max(ts_hi)) - epoch_us(min(ts_lo))) / 1e6, 1) wall_clock_s,
         min(ts_lo) ts_lo, max(ts_hi) ts_hi, max(commit_ts) commit_ts,
         coalesce(max(commit_ts), timestamp '2024-02-01') recorded_at
  from row_model group by repo, commit, session_id, agent),
recs as (
  select conv_id, turn, turn % 3 = 2 is_boundary, length(text) context,
         case when role = 'assistant' then 'm' || (conv_id % 2) end model,
         case when role = 'user' and turn % 3 <> 2 then text end summary
  from conversations),
seg as (
  select *, coalesce(sum(is_boundary::int) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) segment,
         last_value(model ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) last_model,
         first_value(summary ignore nulls) over (partition by conv_id order by turn rows between current row and 7 following) next_summary
  from recs),
compactions as (
  select conv_id, turn, peak peak_context_tokens, coalesce(last_model, '?') model, length(coalesce(next_summary, '')) summary_chars,
         'repo' || (conv_id % 10) repo, 'c' || conv_id session_id, timestamp '2024-01-01' + to_seconds(conv_id * 100 + turn) boundary_ts
  from (select *, max(context) over (partition by conv_id, segment order by turn rows between unbounded preceding and current row) peak from seg)
  where is_boundary),
ledger as (
  select repo, commit, session_id, agent, kind, activity, models, turns, input, cache_write, cache_read, output, billable_input,
         web_search, web_fetch, wall_clock_s, ts_lo, ts_hi, commit_ts, recorded_at, null::timestamp boundary_ts,
         null::bigint peak_context_tokens, null::bigint summary_chars
  from measured
  union all
  select repo, 'pending@2024-02-01', session_id, 'claude-code', 'compaction-estimate', null, model, null, null, null, null, null, null,
         null, null, null, null, null, null, timestamp '2024-02-01', boundary_ts, peak_context_tokens, summary_chars
  from compactions)
"""
