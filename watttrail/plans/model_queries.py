"""Registered queries over assumption packs, estimates and mitigation."""

from __future__ import annotations

from pyspark.sql import functions as F

from watttrail.functions import interval as iv
from watttrail.plans import derive
from watttrail.plans import estimate as est
from watttrail.plans.packs import GENERIC_WIDE, PRICES, SCENARIOS, Pack, energy_mix, load, pack_of_mix, read_document, scenario_table
from watttrail.session import new_path, stage, table

QUERIES, ORACLE_SQL = {}, {}
WIDE = Pack.of(GENERIC_WIDE)


def query(sql=None, prelude=True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (derive.SQL if prelude else "") + sql
        return f

    return add


#: Usage by model and day, and the baseline's rates, for DuckDB. Rates carry ``e0`` to be doubles.
_BASE_SQL = """, dated as (select *, strftime(coalesce(commit_ts, ts_hi, recorded_at), '%Y-%m-%d') as day from measured),
shares as (select r.model, d.day, r.input, r.cache_write, r.cache_read, r.output,
    d.turns * ((r.input + r.cache_write + r.cache_read + r.output)
      / sum(r.input + r.cache_write + r.cache_read + r.output) over (partition by r.repo, r.commit, r.session_id, r.agent)) turns
  from row_model r join dated d on r.repo = d.repo and r.commit = d.commit and r.session_id = d.session_id and r.agent = d.agent),
used as (select model, day, sum(input)::double input, sum(cache_write)::double cache_write, sum(cache_read)::double cache_read,
    sum(output)::double output, sum(turns) turns from shares group by all),
rated as (select *, case model when 'm-view' then 0.0005e0 else 0.0003e0 end wh_output, 0.00003e0 wh_input,
    case model when 'm-view' then 15e0 when 'm-click' then 1.25e0 else 0e0 end p_in,
    case model when 'm-view' then 18.75e0 else 0e0 end p_cw, case model when 'm-view' then 1.5e0 else 0e0 end p_cr,
    case model when 'm-view' then 75e0 when 'm-click' then 10e0 else 0e0 end p_out from used),
costed as (select *, (output * wh_output + (input + cache_write + cache_read) * wh_input) * 1.2e0 / 1000 kwh,
    (input * p_in + cache_write * p_cw + cache_read * p_cr + output * p_out) / 1e6 usd from rated),
tools as (select day, sum(web_search + web_fetch) * 0.0005e0 kwh from dated group by day)
"""


def _usage(spark, sf_dir, pack=derive.PACK):
    # a ledger is a table, and read once for each kind of usage
    return est.metrics(est.usage(stage(derive.ledger(spark, sf_dir), "ledger"), pack), pack)


def _by_model(rows, *metrics, digits=6):
    sums = est.totals(rows, ["model"])
    return sums.select("model", *(F.round(f"{m}_central", digits).alias(m) for m in metrics))


@query(_BASE_SQL + "select model, round(sum(kwh), 6) as energy_kwh from costed group by model")
def mod_per_token(spark, sf_dir):
    return _by_model(_usage(spark, sf_dir), "energy_kwh")


@query(_BASE_SQL + "select model, round(sum(usd), 4) as api_cost_usd from costed group by model")
def mod_api_cost(spark, sf_dir):
    return _by_model(_usage(spark, sf_dir), "api_cost_usd", digits=4)


@query(_BASE_SQL + "select model, round(sum(kwh * 475), 3) as carbon_gco2e, round(sum(kwh * 0.12e0), 3) as electricity_cost_usd from costed group by model")
def mod_carbon(spark, sf_dir):
    return _by_model(_usage(spark, sf_dir), "carbon_gco2e", "electricity_cost_usd", digits=3)


@query(_BASE_SQL + "select day, round(kwh, 6) as energy_kwh, round(kwh * 475, 3) as carbon_gco2e from tools")
def mod_server_tools(spark, sf_dir):
    rows = _usage(spark, sf_dir).where("kind = 'tool'")
    return rows.select("day", F.round("energy_kwh.central", 6).alias("energy_kwh"), F.round("carbon_gco2e.central", 3).alias("carbon_gco2e"))


_WIDE_SQL = """, served as (select model, day, input + cache_write * {cwf} + cache_read * {crf} effective, output, turns from used),
stack as (select model, effective / {prefill} + output / {decode} + turns * {fixed} s from served)
select model, round(sum(s), 3) as inference_seconds, round(sum(s * {power} / 3600 * {pue}), 6) as energy_kwh from stack group by model"""
_CENTRAL = {"cwf": "0.75e0", "crf": "0.1e0", "prefill": "50000e0", "decode": "60e0", "fixed": "0.25e0", "power": "1.5e0", "pue": "1.25e0"}


@query(_BASE_SQL + _WIDE_SQL.format(**_CENTRAL))
def mod_serving_stack(spark, sf_dir):
    rows = _usage(spark, sf_dir, WIDE).where("kind = 'model'")
    sums = est.totals(rows, ["model"])
    return sums.select("model", F.round("inference_seconds_central", 3).alias("inference_seconds"), F.round("energy_kwh_central", 6).alias("energy_kwh"))


@query("""select model, round(sum(peak_context_tokens) / 250000e0 + sum(summary_chars) / 6e0 / 250 + 0, 6) as seconds_low,
    round(sum(peak_context_tokens) / 50000e0 + sum(summary_chars) / 4e0 / 60 + count(*) * 0.25e0, 6) as seconds,
    round(sum(peak_context_tokens) / 5000e0 + sum(summary_chars) / 2.5e0 / 10 + count(*) * 3, 6) as seconds_high from compactions group by model""")
def mod_compaction(spark, sf_dir):
    rows = _usage(spark, sf_dir, WIDE).where("kind = 'compaction'")
    sums = est.totals(rows, ["model"])
    names = {"low": "seconds_low", "central": "seconds", "high": "seconds_high"}
    return sums.select("model", *(F.round(f"inference_seconds_{b}", 6).alias(n) for b, n in names.items()))


@query(_BASE_SQL + """select round((select sum(kwh) from costed) + (select sum(kwh) from tools), 6) as energy_kwh,
    round(((select sum(kwh) from costed) + (select sum(kwh) from tools)) * 475, 2) as carbon_gco2e, round((select sum(usd) from costed), 4) as api_cost_usd""")
def agg_estimate_total(spark, sf_dir):
    sums = est.totals(_usage(spark, sf_dir))
    return sums.select(F.round("energy_kwh_central", 6).alias("energy_kwh"), F.round("carbon_gco2e_central", 2).alias("carbon_gco2e"), F.round("api_cost_usd_central", 4).alias("api_cost_usd"))


@query(_BASE_SQL + """select model, round(sum(kwh), 6) as energy_kwh, round(sum(kwh * 475), 3) as carbon_gco2e, round(sum(usd), 4) as api_cost_usd,
    round(sum(kwh * 0.12e0), 4) as electricity_cost_usd, 0e0 as inference_seconds from costed group by model""")
def agg_estimate_by_model(spark, sf_dir):
    sums = est.totals(_usage(spark, sf_dir), ["model"])
    return sums.select("model", *est.rounded(sums))


#: The pack with a range for its overhead.
RANGED = Pack.of({**derive.PACK.document, "pue": [1.0, 1.2, 2.4]})


@query(_BASE_SQL + f""", meta as (select (select strftime(max(recorded_at), '%Y-%m-%dT%H:%M:%S') from ledger) as through),
    scopes as (select 'total' as scope, null as model, (select sum(kwh) from costed) m, (select sum(kwh) from tools) t, (select sum(usd) from costed) usd
      union all select 'model', model, sum(kwh), 0e0, sum(usd) from costed group by model)
    select scope, model, round(m + t, 6) as energy_kwh, round(m / 1.2e0 + t, 6) as energy_kwh_low, round(m * 2 + t, 6) as energy_kwh_high,
    round((m + t) * 475, 2) as carbon_gco2e, round(usd, 4) as api_cost_usd, '{derive.PACK.version}' as pack_version, '{RANGED.sha256}' as assumptions_sha256,
    'scalar' as grid_model, 475e0 as grid_gco2e_per_kwh, true as has_bounds, 'grid,energy,pricing' as sources, through from scopes, meta""")
def mod_estimate_report(spark, sf_dir):
    found = est.report(stage(derive.ledger(spark, sf_dir), "ledger"), RANGED)
    bounds = [F.round(f"energy_kwh_{b}", 6).alias(f"energy_kwh_{b}") for b in ("low", "high")]
    sources = F.array_join(F.transform("provenance", lambda p: p["applies_to"]), ",").alias("sources")
    return found.select(
        "scope", "model", "energy_kwh", *bounds, F.round("carbon_gco2e", 2).alias("carbon_gco2e"), "api_cost_usd", "pack_version", "assumptions_sha256",
        "grid_model", "grid_gco2e_per_kwh", "has_bounds", sources, "through",
    )


@query(_BASE_SQL + """select model, day, wh_output, wh_input, p_in as price_input, p_cw as price_cache_write, p_cr as price_cache_read, p_out as price_output from rated""")
def jn_model_rates(spark, sf_dir):
    rows = est.with_rates(est.usage(derive.ledger(spark, sf_dir), derive.PACK).where("kind = 'model'"), derive.PACK)
    return rows.select("model", "day", *(F.col(c)["central"].alias(c) for c in ("wh_output", "wh_input", *PRICES)))


@query("""select distinct event_type as model, case event_type when 'view' then 0.0005e0 else 0.0003e0 end as wh_output,
    case event_type when 'view' then 75e0 when 'click' then 10e0 else 0e0 end as price_output,
    case event_type when 'view' then 18.75e0 else 0e0 end as price_cache_write from events""", prelude=False)
def prj_model_assumptions(spark, sf_dir):
    """A model's own figures over the defaults, one price at a time."""
    models = table(spark, sf_dir, "events").select(F.concat(F.lit("m-"), "event_type").alias("model")).distinct()
    rows = est.with_rates(models, derive.PACK)
    return rows.select(F.substring("model", 3, 99).alias("model"), *(F.col(c)["central"].alias(c) for c in ("wh_output", "price_output", "price_cache_write")))


@query("""select event_id, case when strftime(ts, '%Y-%m-%d') < '2024-01-15' then 100e0 else 300e0 end as grid_low,
    case when strftime(ts, '%Y-%m-%d') < '2024-01-15' then 100e0 else 500e0 end as grid from e""")
def jn_grid_asof(spark, sf_dir):
    rows = derive.events(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return est.with_grid(rows, derive.DATED).select("event_id", F.col("grid.low").alias("grid_low"), F.col("grid.central").alias("grid"))


def _mix_file(spark, sf_dir):
    """An energy mix of the nations, every seventh without a number, as one JSON document."""
    entry = F.struct(F.when(F.col("n_nationkey") % 7 != 3, 20.0 + F.col("n_nationkey") * 31.4159).alias("carbon_intensity"), F.col("n_name").alias("country_name"))
    named = table(spark, sf_dir, "nation").select(F.struct(F.concat(F.lit("N"), "n_nationkey").alias("key"), entry.alias("value")).alias("kv"))
    path = new_path(spark, "mix")
    # one entry a country
    named.agg(F.to_json(F.map_from_entries(F.collect_list("kv"))).alias("value")).write.text(path)
    return path


_MIX_SQL = """with mix as (select 'N' || n_nationkey region, round(20.0e0 + n_nationkey * 31.4159e0, 3) as intensity from nation where n_nationkey % 7 <> 3)
"""


@query(_MIX_SQL + "select region, intensity from mix", prelude=False)
def src_energy_mix(spark, sf_dir):
    return energy_mix(spark, _mix_file(spark, sf_dir))


@query(_MIX_SQL + "select s_suppkey, intensity from supplier join mix on region = 'N' || s_nationkey", prelude=False)
def jn_grid_region(spark, sf_dir):
    """Suppliers of the regions in the mix; one of another region would be an error."""
    pack = pack_of_mix(spark, _mix_file(spark, sf_dir))
    placed = table(spark, sf_dir, "supplier").where("s_nationkey % 7 <> 3").withColumn("region", F.concat(F.lit("N"), "s_nationkey"))
    return est.with_region_grid(placed, pack).select("s_suppkey", F.col("grid.central").alias("intensity"))


def _pack_file(spark, sf_dir):
    """A pack as a JSON document: a price for each type of event, a grid figure for each day of events."""
    e = table(spark, sf_dir, "events")
    price = F.struct(F.struct((F.length("event_type") * 1.5).alias("output")).alias("pricing_usd_per_mtok"))
    models = e.select("event_type").distinct().agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("m-"), "event_type").alias("key"), price.alias("value")))).alias("models"))
    day = F.date_format("ts", "yyyy-MM-dd")
    dates = e.select(day.alias("from"), (F.dayofmonth("ts") * 10).alias("gco2e_per_kwh")).distinct()  # a row a day
    series = dates.agg(F.collect_list(F.struct("from", "gco2e_per_kwh")).alias("intensity_by_date")).select(F.struct("intensity_by_date").alias("grid"))
    sources = F.array(F.struct(F.lit("grid").alias("applies_to"), F.lit("days").alias("source")), F.struct(F.lit("pricing").alias("applies_to"), F.lit("types").alias("source")))
    document = models.join(F.broadcast(series)).withColumns({"pack_version": F.lit("derived"), "provenance": sources})  # one row each
    path = new_path(spark, "pack")
    document.select(F.to_json(F.struct(*document.columns)).alias("value")).write.text(path)
    return path


@query("""with d as (select distinct ts::date d from events)
    select 'model' as kind, 'm-' || event_type as name, length(event_type) * 1.5e0 as value from events group by event_type
    union all select 'grid', case when d = (select min(d) from d) then '' else strftime(d, '%Y-%m-%d') end, day(d) * 10e0 from d
    union all select 'provenance', unnest(['grid', 'pricing']), null""", prelude=False)
def src_pack_tables(spark, sf_dir):
    """The tables of a pack that is read from a document."""
    pack = load(spark, _pack_file(spark, sf_dir))
    models = pack.model_table(spark).select(F.lit("model").alias("kind"), F.col("model").alias("name"), F.col("price_output.central").alias("value"))
    grid = pack.grid_table(spark).select(F.lit("grid"), "valid_from", "intensity.central")
    return models.union(grid).union(pack.provenance_table(spark).select(F.lit("provenance"), "applies_to", F.lit(None).cast("double")))


def _scenario_file(spark, sf_dir):
    """Price scenarios as a JSON document: one a region, the last without a price."""
    said = F.struct(
        F.concat(F.lit("credit of "), "r_name").alias("instrument"), F.when(F.col("r_regionkey") < 4, F.array(F.col("r_regionkey") + 1.0, F.col("r_regionkey") * 2 + 2.0, F.lit(90.0))).alias("usd_per_tco2e"),
        F.lower("r_name").alias("credit_category"), F.lit("long").alias("durability"), F.lower("r_name").alias("notes"),
    )
    listed = table(spark, sf_dir, "region").agg(F.map_from_entries(F.collect_list(F.struct("r_name", said))).alias("price_scenarios"))  # five regions
    path = new_path(spark, "scenarios")
    listed.select(F.to_json(F.struct("price_scenarios")).alias("value")).write.text(path)
    return path


@query("""select r_name as scenario, 'credit of ' || r_name as instrument, r_regionkey + 1e0 as low, r_regionkey * 2 + 2e0 as central,
    lower(r_name) as credit_category, 'long' as durability, lower(r_name) as notes from region where r_regionkey < 4""", prelude=False)
def src_mitigation_scenarios(spark, sf_dir):
    rows = scenario_table(spark, read_document(spark, _scenario_file(spark, sf_dir))["price_scenarios"])
    return rows.select("scenario", "instrument", F.col("price.low").alias("low"), F.col("price.central").alias("central"), "credit_category", "durability", "notes")


@query("""select l_orderkey, l_linenumber, l_quantity::double <= l_extendedprice::double and l_quantity > 0 and l_tax::double * 100 <= l_quantity::double as valid from lineitem""", prelude=False)
def prj_interval_validate(spark, sf_dir):
    x = iv.make(F.col("l_tax") * 100, F.col("l_quantity"), F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", iv.valid(x).alias("valid"))




@query("""select l_orderkey, l_linenumber, round((q * 0.5e0 + p) * 0.5e0 / (q * 2) / 3, 9) as low, round((q + p) / q / 3, 9) as central,
    round((q * 2 + p) * 2 / (q * 0.5e0) / 3, 9) as high from (select l_orderkey, l_linenumber, l_quantity::double q, l_extendedprice::double p from lineitem)""", prelude=False)
def prj_interval_arith(spark, sf_dir):
    """((q * [0.5, 1, 2] + p) * [0.5, 1, 2]) / (q * [0.5, 1, 2]) / 3."""
    q, p, wide = iv.exact(F.col("l_quantity")), iv.exact(F.col("l_extendedprice")), iv.const([0.5, 1, 2])
    x = iv.scaled(iv.div(iv.mul(iv.add(iv.mul(q, wide), p), wide), iv.mul(q, wide)), 1 / 3)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(x[b], 9).alias(b) for b in iv.BOUNDS))


_SCENARIO_SQL = ", ".join(f"('{n}', {s['usd_per_tco2e'][0]}e0, {s['usd_per_tco2e'][1]}e0, {s['usd_per_tco2e'][2]}e0)" for n, s in SCENARIOS.items())
_TONNES_SQL = _BASE_SQL + f""", footprint as (select ((select sum(kwh) from costed) + (select sum(kwh) from tools)) * 475 * 1e-6 t),
scenarios as (select * from (values {_SCENARIO_SQL}) v(scenario, low, central, high))
"""


def _carbon(spark, sf_dir):
    return est.totals(_usage(spark, sf_dir))


@query(_TONNES_SQL + "select scenario, round(t, 9) as tonnes, round(t * low, 6) as usd_low, round(t * central, 6) as usd, round(t * high, 6) as usd_high from footprint cross join scenarios")
def jn_mitigation_cross(spark, sf_dir):
    found = est.mitigation(_carbon(spark, sf_dir), scenario_table(spark))
    cost = F.col("proportional_usd")
    return found.select("scenario", F.round("tonnes.central", 9).alias("tonnes"), F.round(cost["low"], 6).alias("usd_low"), F.round(cost["central"], 6).alias("usd"), F.round(cost["high"], 6).alias("usd_high"))


@query(_TONNES_SQL + "select scenario, round(t * low, 6) as cover_low, round(t * high, 6) as cover_high, true as unadjusted from footprint cross join scenarios")
def mod_mitigation(spark, sf_dir):
    found = est.mitigation(_carbon(spark, sf_dir), scenario_table(spark))
    return found.select("scenario", F.round("cover_high_usd.low", 6).alias("cover_low"), F.round("cover_high_usd.high", 6).alias("cover_high"), F.col("adjusted_usd").isNull().alias("unadjusted"))


@query(_TONNES_SQL + "select scenario, round(t / 1, 9) as tonnes_low, round(t / 0.5e0, 9) as tonnes_high, round(t / 0.5e0 * high, 6) as usd_high from footprint cross join scenarios")
def mod_mitigation_effective(spark, sf_dir):
    rated = {k: {**v, "effective_tco2e_per_credited_tco2e": [0.5, 0.8, 1.0]} for k, v in SCENARIOS.items()}
    found = est.mitigation(_carbon(spark, sf_dir), scenario_table(spark, rated))
    t = F.col("adjusted_tonnes")
    return found.select("scenario", F.round(t["low"], 9).alias("tonnes_low"), F.round(t["high"], 9).alias("tonnes_high"), F.round("adjusted_usd.high", 6).alias("usd_high"))


