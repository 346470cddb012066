"""Totals and reports over the latest ledger rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watttrail.operators.ledger import COMPACTION, MEASURED, TOKENS, TOOLS

KINDS = [*TOKENS, "billable_input"]


def is_compaction() -> Column:
    return F.coalesce(F.col("kind") == COMPACTION, F.lit(False))


def _sum(column: str | Column, kind: str = "long") -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.sum(F.when(~is_compaction(), value)), F.lit(0)).cast(kind)


def _token_sums() -> list[Column]:
    return [_sum(c).alias(c) for c in KINDS]


def _wall() -> Column:
    return F.round(_sum(F.coalesce("wall_clock_s", F.lit(0.0)), "double"), 1)


def real_commit() -> Column:
    """The commit of a measured row unless it is pending."""
    return F.when(~is_compaction() & ~F.col("commit").startswith("pending@"), F.col("commit"))


def report_key(by: str) -> Column:
    """Group of a row: commits by ten characters, days of recording, named activities and agents."""
    named = {"activity": "unlabeled", "agent": "unknown"}
    if by in named:
        return F.coalesce(F.nullif(F.col(by), F.lit("")), F.lit(named[by]))
    if by == "commit":
        return F.substring("commit", 1, 10)
    if by == "day":
        return F.date_format("recorded_at", "yyyy-MM-dd")
    raise ValueError(f"no such grouping: {by}")


def totals(ledger: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Lifetime totals (of each group): measured sums, rows with compactions, commits, compactions."""
    figures = [
        *_token_sums(),
        _sum("turns").alias("turns"),
        _wall().alias("wall_clock_s"),
        *(_sum(c).alias(c) for c in TOOLS),
        F.count("*").alias("ledger_rows"),
        F.count_distinct(real_commit()).alias("commits"),
        F.max("recorded_at").alias("through"),
        F.count(F.when(is_compaction(), 1)).alias("compactions"),
        F.coalesce(F.sum("peak_context_tokens"), F.lit(0)).alias("peak_context_tokens"),
        F.coalesce(F.sum("summary_chars"), F.lit(0)).alias("summary_chars"),
    ]
    return ledger.groupBy(*(by or [])).agg(*figures)


def by_model(ledger: DataFrame) -> DataFrame:
    """Tokens of each model."""
    split = ledger.where(~is_compaction()).select(F.explode("by_model").alias("model", "tokens"))
    sums = [F.sum(F.col("tokens")[c]).alias(c) for c in TOKENS]
    return split.groupBy("model").agg(*sums).withColumn("billable_input", F.col("input") + F.col("cache_write") + F.col("cache_read"))


def by_label(ledger: DataFrame, label: str) -> DataFrame:
    """Tokens of each activity or agent."""
    return ledger.where(~is_compaction()).groupBy(report_key(label).alias(label)).agg(*_token_sums())


def _keyed(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.alias("value"))


def totals_document(ledger: DataFrame) -> DataFrame:
    """The totals as one nested JSON document, keys sorted: one row, column ``value``.

    Tokens are split by model, activity and agent. Each row is spread over the groups it counts
    in, and one aggregation sums all of them before the exchange; what is put together after it
    has one row for each label, as the document has. The same rows give the same bytes.
    """
    measured = ~is_compaction()
    tokens = F.struct(*KINDS)
    own = [_keyed(label, report_key(label)) for label in ("activity", "agent")]
    entries = F.coalesce(F.map_entries("by_model"), F.array())
    billable = lambda t: (t["input"] + t["cache_write"] + t["cache_read"]).alias("billable_input")
    named = lambda g, label, t: F.struct(g.alias("part"), label.alias("label"), t.alias("tokens"))
    groups = F.concat(
        F.array(named(F.lit("all"), F.lit(""), tokens)),
        F.when(measured, F.array(*(named(g["key"], g["value"], tokens) for g in own))).otherwise(F.array()),
        F.when(
            measured,
            F.transform(entries, lambda e: named(F.lit("model"), e["key"], F.struct(*(e["value"][c].alias(c) for c in TOKENS), billable(e["value"])))),
        ).otherwise(F.array()),
    )
    spread = ledger.withColumn("_group", F.explode(groups))
    part, label = F.col("_group.part").alias("part"), F.col("_group.label").alias("label")
    once = F.col("_group.part") == "all"
    only = lambda c: F.when(once, c)
    sums = [_sum(F.col("_group.tokens")[c]).alias(c) for c in sorted(KINDS)]
    figures = [
        _sum(only(F.col("turns"))).alias("turns"),
        _sum(only(F.coalesce("wall_clock_s", F.lit(0.0))), "double").alias("wall_clock_s"),
        *(_sum(only(F.col(c))).alias(c) for c in TOOLS),
        F.count(only(F.lit(1))).alias("ledger_rows"),
        F.max(only(F.col("recorded_at"))).alias("through"),
        F.count(F.when(is_compaction(), 1)).alias("events"),
        F.coalesce(F.sum(only(F.col("peak_context_tokens"))), F.lit(0)).alias("peak_context_tokens"),
        F.coalesce(F.sum(only(F.col("summary_chars"))), F.lit(0)).alias("summary_chars"),
    ]
    # commits are made distinct by the exchange of the same aggregation, not in a second pass
    commit = F.when(once, F.coalesce(real_commit(), F.lit("")))
    by_commit = spread.groupBy(part, label, commit.alias("commit")).agg(*sums, *figures)
    adds = [*sorted(KINDS), "turns", "wall_clock_s", *TOOLS, "ledger_rows", "events", "peak_context_tokens", "summary_chars"]
    summed = by_commit.groupBy("part", "label").agg(
        *(F.sum(c).alias(c) for c in adds), F.max("through").alias("through"), F.count(F.when(F.col("commit") != "", 1)).alias("commits")
    )
    tokens_of = F.struct(*sorted(KINDS)).alias("tokens")
    split = lambda name: F.map_from_entries(
        F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("label", tokens_of))))
    ).alias(f"by_{name}")
    only_all = lambda c: F.when(F.col("part") == "all", F.col(c))
    whole = lambda c: F.coalesce(F.max(only_all(c)), F.lit(0))
    through = F.date_format(F.max(only_all("through")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    document = F.struct(
        split("activity"),
        split("agent"),
        split("model"),
        whole("commits").alias("commits_accounted"),
        F.struct(*(whole(c).alias(c) for c in ("events", "peak_context_tokens", "summary_chars"))).alias("compaction_signals"),
        whole("ledger_rows").alias("ledger_rows"),
        F.struct(*(whole(c).alias(c) for c in sorted(TOOLS))).alias("server_tool_calls"),
        through.alias("through"),
        F.struct(F.round(whole("wall_clock_s"), 1).alias("wall_clock_s")).alias("time"),
        F.struct(*(whole(c).alias(c) for c in sorted(KINDS))).alias("tokens"),
        whole("turns").alias("turns"),
    )
    return summed.agg(document.alias("d")).select(F.to_json("d", {"ignoreNullFields": "false"}).alias("value"))


def report(ledger: DataFrame, by: str) -> DataFrame:
    """A report of measured rows by commit, day, activity, agent or model.

    A model's group has token sums only: turns and time belong to whole rows.
    """
    measured = ledger.where(~is_compaction())
    if by == "model":
        return by_model(ledger).select(
            F.col("model").alias("key"), F.lit(0).cast("long").alias("turns"), *KINDS, F.lit(0.0).alias("wall_clock_s"), F.col("model").alias("models")
        )
    # a row's figures go with its first model, so that models and figures are summed in one pass
    figures = ["turns", "wall_clock_s", *KINDS]
    rows = measured.select(report_key(by).alias("key"), *figures, F.posexplode_outer("models").alias("_pos", "_model"))
    first = F.coalesce("_pos", F.lit(0)) == 0
    split = rows.groupBy("key", "_model").agg(*(F.sum(F.when(first, F.col(c))).alias(c) for c in figures)).withColumn("kind", F.lit(MEASURED))
    listed = F.array_join(F.array_sort(F.collect_set("_model")), ",")
    return split.groupBy("key").agg(_sum("turns").alias("turns"), *_token_sums(), _wall().alias("wall_clock_s"), listed.alias("models"))


def fleet(ledger: DataFrame) -> DataFrame:
    """Totals of every repository and their plain sum, in which nothing is distinct across them."""
    each = totals(ledger, ["repo"])
    summed = [c for c in each.columns if c not in ("repo", "through")]
    total = each.agg(*(F.sum(c).alias(c) for c in summed), F.max("through").alias("through"))
    rounded = total.withColumn("wall_clock_s", F.round("wall_clock_s", 1)).withColumn("repo", F.lit("TOTAL"))
    return each.unionByName(rounded)


def human(n: Column) -> Column:
    """A count as 950, 1.2k, 66.6M or 1.0B."""
    steps = [(1e9, "B"), (1e6, "M"), (1e3, "k")]
    plain = F.format_string("%d", n.cast("long"))
    return reduce(lambda out, s: F.when(F.abs(n) >= s[0], F.format_string(f"%.1f{s[1]}", n / s[0])).otherwise(out), reversed(steps), plain)


def badge(totals_row: DataFrame) -> DataFrame:
    """One row for a badge: label, message, colour."""
    spent = F.col("billable_input") + F.col("output")
    parts = [human(spent), F.lit(" tok · "), human(F.col("turns")), F.lit(" turns · "), F.col("commits").cast("string"), F.lit(" commits")]
    return totals_row.select(F.lit("LLM usage").alias("label"), F.concat(*parts).alias("message"), F.lit("blue").alias("color"))


def show(ledger: DataFrame) -> DataFrame:
    """A line for every row, oldest first."""
    return ledger.select("recorded_at", "repo", "commit", "agent", "session_id", "kind", "turns", "output", "billable_input").orderBy("recorded_at", "repo", "commit", "agent", "session_id")
