"""Energy, carbon and cost of a ledger under an assumption pack.

All metrics are linear in a row's usage, so usage is summed by model and day before any rate is
applied: the joins with the pack see one row for each model and day, whatever the ledger's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watttrail.functions import interval as iv
from watttrail.operators.ledger import TOKENS
from watttrail.operators.report import is_compaction
from watttrail.plans.packs import DESCRIPTIVE, PRICES, RATES, Pack, constant

METRICS = ["inference_seconds", "energy_kwh", "carbon_gco2e", "electricity_cost_usd", "api_cost_usd"]
DIGITS = {"energy_kwh": 6, "carbon_gco2e": 3, "api_cost_usd": 4, "electricity_cost_usd": 4, "inference_seconds": 3}


def row_day(ledger: DataFrame) -> Column:
    """Date that decides a row's grid: of the commit as git printed it, else of the last turn or recording."""
    shown = F.date_format(F.coalesce("commit_ts", "ts_hi", "recorded_at"), "yyyy-MM-dd")
    return F.coalesce(F.substring("commit_ts_raw", 1, 10), shown) if "commit_ts_raw" in ledger.columns else shown


def model_shares(ledger: DataFrame) -> DataFrame:
    """Measured rows by model: ``day``, tokens, and ``turns``, the row's turns by share of tokens.

    A row without a split by model belongs to its first model.
    """
    first = F.coalesce(F.get("models", F.lit(0)), F.lit("unknown"))
    own = F.struct(*(F.coalesce(c, F.lit(0)).alias(c) for c in TOKENS))
    split = F.when(F.coalesce(F.size("by_model"), F.lit(0)) > 0, F.col("by_model")).otherwise(F.create_map(first, own))
    size = lambda t: sum((t[c] for c in TOKENS[1:]), t[TOKENS[0]])
    whole = F.aggregate(F.map_values("_split"), F.lit(0).cast("long"), lambda n, t: n + size(t))
    rows = ledger.where(~is_compaction()).withColumn("_split", split).withColumn("_whole", whole).withColumn("_n", F.size("_split"))
    rows = rows.withColumn("day", row_day(ledger)).select("*", F.explode("_split").alias("model", "_t"))
    share = F.when(F.col("_whole") > 0, size(F.col("_t")) / F.col("_whole")).otherwise(1 / F.col("_n"))
    rows = rows.withColumn("share", share).withColumn("turns", F.coalesce("turns", F.lit(0)) * F.col("share"))
    return rows.drop(*TOKENS).select("*", *(F.col("_t")[c].alias(c) for c in TOKENS)).drop("_split", "_whole", "_n", "_t")


def usage(ledger: DataFrame, pack: Pack) -> DataFrame:
    """Usage by ``kind`` (model, compaction, tool), model and day."""
    sums = [F.sum(F.col(c).cast("double")).alias(c) for c in TOKENS]
    nothing = [F.lit(0.0).alias(c) for c in TOKENS]
    zero = F.lit(0.0)
    models = model_shares(ledger).groupBy("model", "day").agg(*sums, F.sum("turns").alias("turns"))
    models = models.select(F.lit("model").alias("kind"), "model", "day", *TOKENS, "turns", zero.alias("chars"), zero.alias("calls"))
    dated = ledger.withColumn("day", row_day(ledger))
    calls = dated.where(~is_compaction()).groupBy("day").agg(F.sum(F.coalesce("web_search", F.lit(0)) + F.coalesce("web_fetch", F.lit(0))).cast("double").alias("calls"))
    tools = calls.select(F.lit("tool").alias("kind"), F.lit(None).cast("string").alias("model"), "day", *nothing, zero.alias("turns"), zero.alias("chars"), "calls")
    out = models if pack.tool_kwh is None else models.unionByName(tools)
    if pack.energy_model != "serving-stack":
        return out
    name = F.coalesce(F.get("models", F.lit(0)), F.lit("unknown")).alias("model")
    peaks = dated.where(is_compaction()).groupBy(name, "day").agg(
        F.sum(F.coalesce("peak_context_tokens", F.lit(0)).cast("double")).alias("input"),
        F.sum(F.coalesce("summary_chars", F.lit(0)).cast("double")).alias("chars"),
        F.count("*").cast("double").alias("turns"),
    )
    rest = [c for c in nothing[1:]]
    return out.unionByName(peaks.select(F.lit("compaction").alias("kind"), "model", "day", "input", *rest, "turns", "chars", zero.alias("calls")))


def with_rates(rows: DataFrame, pack: Pack) -> DataFrame:
    """Adds the rates of each row's model, the pack's defaults where it has none of its own."""
    spark, names = rows.sparkSession, [*RATES, *PRICES]
    own = pack.model_table(spark).select("model", *(F.col(n).alias(f"_{n}") for n in names))
    joined = rows.join(F.broadcast(own), "model", "left")  # as many rows as the pack names models
    defaults = pack.models[None]
    filled = [F.coalesce(f"_{n}", constant(defaults[n])).alias(n) for n in names]
    return joined.select(*rows.columns, *filled)


def with_grid(rows: DataFrame, pack: Pack, region: str | None = None, day: str = "day") -> DataFrame:
    """Adds ``grid``: of the region, else of the day in a series, else the pack's figure."""
    if region:
        return rows.withColumn("grid", iv.const(pack.region(region)))
    if not pack.series:
        return rows.withColumn("grid", iv.const(pack.grid))
    spans = F.broadcast(pack.grid_table(rows.sparkSession))  # one row a date in the pack
    joined = rows.join(spans, (F.col(day) >= F.col("valid_from")) & (F.col(day) < F.col("valid_to")), "left")
    return joined.withColumn("grid", F.coalesce("intensity", iv.const(pack.series[0][1]))).drop("valid_from", "valid_to", "intensity")


def with_region_grid(rows: DataFrame, pack: Pack, region: str = "region") -> DataFrame:
    """Adds ``grid`` of each row's own region; a region that the pack does not know is an error."""
    known = F.broadcast(pack.region_table(rows.sparkSession)).withColumnsRenamed({"region": region, "intensity": "grid"})
    missing = F.raise_error(F.concat(F.lit("unknown region "), F.coalesce(region, F.lit("null")))).cast(iv.TYPE)
    return rows.join(known, region, "left").withColumn("grid", F.coalesce("grid", missing))


def _sum(*parts: Column) -> Column:
    return reduce(iv.add, parts)


def _exact(name: str) -> Column:
    return iv.exact(F.col(name))


def per_token_energy(pack: Pack) -> Column:
    inputs = F.col("input") + F.col("cache_write") + F.col("cache_read")
    wh = iv.add(iv.mul(_exact("output"), F.col("wh_output")), iv.mul(iv.exact(inputs), F.col("wh_input")))
    return iv.scaled(iv.mul(wh, iv.const(pack.pue)), 0.001)


def serving_seconds(pack: Pack) -> Column:
    effective = _sum(
        _exact("input"), iv.mul(_exact("cache_write"), F.col("cache_write_work")), iv.mul(_exact("cache_read"), F.col("cache_read_work"))
    )
    written = F.when(F.col("kind") == "compaction", iv.div(_exact("chars"), iv.const(pack.chars_per_token))).otherwise(_exact("output"))
    return _sum(iv.div(effective, F.col("prefill")), iv.div(written, F.col("decode")), iv.mul(_exact("turns"), F.col("fixed")))


def api_cost(pack: Pack) -> Column:
    """Tokens at list price; the tokens of a compaction's summary count at their central value."""
    written = F.when(F.col("kind") == "compaction", F.col("chars") / F.lit(pack.chars_per_token[1])).otherwise(F.col("output"))
    kinds = {t: F.col(t) for t in TOKENS} | {"output": written}
    return _sum(*(iv.scaled(iv.mul(iv.exact(v), F.col(f"price_{t}")), 1e-6) for t, v in kinds.items()))


def metrics(rows: DataFrame, pack: Pack, region: str | None = None) -> DataFrame:
    """Adds the five metrics, as intervals, to rows of ``usage``."""
    serving = pack.energy_model == "serving-stack"
    if serving and any(pack.models[None][c] is None for c in ("prefill", "decode", "power")):
        raise ValueError("a serving-stack pack needs default speeds and power")
    rows = with_grid(with_rates(rows, pack), pack, region)
    zero = iv.const(0)
    tool = F.col("kind") == "tool"
    seconds = F.when(tool, zero).otherwise(serving_seconds(pack)) if serving else zero
    rows = rows.withColumn("inference_seconds", seconds)
    if serving:
        model = iv.mul(iv.scaled(iv.mul(F.col("inference_seconds"), F.col("power")), 1 / 3600), iv.const(pack.pue))
    else:
        model = per_token_energy(pack)
    spent = iv.mul(_exact("calls"), iv.const(pack.tool_kwh)) if pack.tool_kwh is not None else zero
    rows = rows.withColumn("energy_kwh", F.when(tool, spent).otherwise(model))
    return (
        rows.withColumn("carbon_gco2e", iv.mul(F.col("energy_kwh"), F.col("grid")))
        .withColumn("electricity_cost_usd", iv.mul(F.col("energy_kwh"), iv.const(pack.electricity)))
        .withColumn("api_cost_usd", F.when(tool, zero).otherwise(api_cost(pack)))
    )


def estimate(ledger: DataFrame, pack: Pack, region: str | None = None) -> DataFrame:
    """Metrics of the ledger's usage by kind, model and day."""
    return metrics(usage(ledger, pack), pack, region)


def totals(estimated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each metric's sum as three columns; by model, server tools belong to none and are left out."""
    rows = estimated.where("kind <> 'tool'") if by and "model" in by else estimated
    return rows.groupBy(*(by or [])).agg(*(c for m in METRICS for c in iv.total(m)))


def rounded(total: DataFrame, bound: str = "central") -> list[Column]:
    return [F.round(F.col(f"{m}_{bound}"), d).alias(m) for m, d in DIGITS.items()]


def report(ledger: DataFrame, pack: Pack, region: str | None = None) -> DataFrame:
    """The estimate: a row for the total (``model`` null) and one for each model, with what they rest on.

    Each metric has its rounded central value and, as ``<metric>_low`` and ``_high``, its bounds.
    Server tools belong to the total alone.
    """
    rows = estimate(ledger, pack, region)
    models = rows.where("kind <> 'tool'").groupBy("model").agg(*(c for m in METRICS for c in iv.total(m)))
    both = totals(rows).withColumn("model", F.lit(None).cast("string")).unionByName(models)
    through = ledger.agg(F.date_format(F.max("recorded_at"), "yyyy-MM-dd'T'HH:mm:ss").alias("through"))
    basis = f"region {region}" if region else "time series" if pack.series else "scalar"
    grid = pack.region(region) if region else None if pack.series else pack.grid
    return both.select(
        F.when(F.col("model").isNull(), "total").otherwise("model").alias("scope"),
        "model",
        *rounded(both),
        *(F.round(F.col(f"{m}_{b}"), 12).alias(f"{m}_{b}") for m in METRICS for b in ("low", "high")),
        F.lit(pack.version).alias("pack_version"),
        F.lit(pack.document.get("description")).alias("pack_description"),
        F.lit(pack.document.get("disclaimer")).alias("disclaimer"),
        F.lit(pack.sha256).alias("assumptions_sha256"),
        F.lit(pack.energy_model).alias("energy_model"),
        F.lit(pack.pue[1]).alias("pue"),
        F.lit(region).alias("region"),
        F.lit(basis).alias("grid_model"),
        F.lit(None if grid is None else grid[1]).cast("double").alias("grid_gco2e_per_kwh"),
        F.lit(pack.has_bounds()).alias("has_bounds"),
        pack.provenance_column().alias("provenance"),
    ).join(F.broadcast(through))  # one row


def mitigation(carbon_total: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Price scenarios for a footprint: ``carbon_total`` has one row with ``carbon_gco2e`` in three columns.

    Gives the proportional cost, the cost of covering the high bound and, where a scenario states
    its effectiveness, quantity and cost adjusted for it. The footprint itself never changes.
    """
    tonnes = iv.scaled(iv.make(*(F.col(f"carbon_gco2e_{b}") for b in iv.BOUNDS)), 1e-6)
    both = carbon_total.select(tonnes.alias("tonnes")).join(F.broadcast(scenarios))  # one row by a handful
    high = iv.exact(F.col("tonnes.high"))
    adjusted = F.when(F.col("effective").isNotNull(), iv.div(high, F.coalesce("effective", iv.const(1))))
    return both.withColumn("adjusted", adjusted).select(
        "scenario",
        "instrument",
        "tonnes",
        iv.mul(F.col("tonnes"), F.col("price")).alias("proportional_usd"),
        iv.mul(high, F.col("price")).alias("cover_high_usd"),
        F.col("adjusted").alias("adjusted_tonnes"),
        F.when(F.col("adjusted").isNotNull(), iv.mul(F.col("adjusted"), F.col("price"))).alias("adjusted_usd"),
        *(c for c in DESCRIPTIVE if c in scenarios.columns),
    )
