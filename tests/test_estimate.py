"""Packs and estimates against figures worked out by hand."""

import json

import pytest

from watttrail.functions import interval
from watttrail.plans import estimate as est
from watttrail.plans.packs import BASELINE, GENERIC_WIDE, Pack, energy_mix, load, scenario_table

LEDGER = """repo string, commit string, session_id string, agent string, kind string, models array<string>, turns long, input long, cache_write long,
cache_read long, output long, web_search long, web_fetch long, by_model map<string, struct<input: bigint, cache_write: bigint, cache_read: bigint, output: bigint>>,
commit_ts timestamp, ts_hi timestamp, recorded_at timestamp, commit_ts_raw string, peak_context_tokens long, summary_chars long"""


def row(spark, models=("unknown",), tokens=(1000, 500, 5000, 1000), turns=3, web=1, by_model=None, raw=None, kind="measured", cp=(None, None)):
    values = ("r", "c", "s", "a", kind, list(models), turns, *tokens, web, 0, by_model, None, None, None, raw, *cp)
    return spark.createDataFrame([values], LEDGER)


def total(ledger, pack, region=None):
    return est.totals(est.estimate(ledger, pack, region)).first()


def bounds(r, metric):
    return [r[f"{metric}_{b}"] for b in interval.BOUNDS]


def test_baseline(spark):
    r = total(row(spark, ["claude-opus-4-8"], (115, 50, 900, 95)), Pack.of(BASELINE))
    assert r.energy_kwh_central == pytest.approx(7.254e-05)
    assert r.carbon_gco2e_central == pytest.approx(0.0344565)
    assert r.api_cost_usd_central == pytest.approx(0.0111375)


def test_generic_wide(spark):
    r = total(row(spark), Pack.of(GENERIC_WIDE))
    assert bounds(r, "inference_seconds") == pytest.approx([4.0047, 17.4541666667, 109.8])
    assert bounds(r, "energy_kwh") == pytest.approx([0.000292009375, 0.009590711806, 0.742])
    assert bounds(r, "carbon_gco2e") == pytest.approx([0.0058401875, 3.356749132, 742.0])
    assert bounds(r, "electricity_cost_usd") == pytest.approx([1.1680375e-05, 0.00143860677, 0.371])


def test_compactions_cost_in_serving_packs_only(spark):
    one = row(spark, ["m"], (None,) * 4, None, None, kind="compaction-estimate", cp=(50_000, 400))
    assert total(one, Pack.of(BASELINE)).energy_kwh_central == 0
    assert total(one, Pack.of(GENERIC_WIDE)).inference_seconds_central == pytest.approx(1 + 100 / 60 + 0.25)


def test_grid_by_date(spark):
    series = [{"from": "2026-01-01", "gco2e_per_kwh": 100}, {"from": "2026-06-01", "gco2e_per_kwh": 500}]
    pack = Pack.of({"pue": 1, "grid": {"intensity_by_date": series}, "defaults": {"wh_per_output_token": 1}})
    ledger = row(spark, tokens=(0, 0, 0, 1000), web=0, raw="2026-03-01T00:00:00+02:00").union(row(spark, tokens=(0, 0, 0, 1000), web=0, raw="2026-06-01T00:00:00+02:00"))
    r = total(ledger, pack)
    assert (r.energy_kwh_central, r.carbon_gco2e_central) == (2.0, 600.0)
    days = spark.createDataFrame([("2025-01-01",), ("2026-05-31",), ("2026-06-01",)], "day string")
    assert [r.grid.central for r in est.with_grid(days, pack).orderBy("day").collect()] == [100.0, 100.0, 500.0]


def test_regions_and_mix(spark, tmp_path):
    (tmp_path / "mix.json").write_text(json.dumps({"USA": {"carbon_intensity": 369.4999}, "FRA": {"carbon_intensity": 56.0}, "BAD": {"country_name": "x"}}))
    pack = load(spark, f"energy-mix:{tmp_path}/mix.json")
    assert {r.region: r.intensity for r in energy_mix(spark, f"{tmp_path}/mix.json").collect()} == {"USA": 369.5, "FRA": 56.0}
    ledger = row(spark)
    assert total(ledger, pack, "FRA").carbon_gco2e_central < total(ledger, pack, "USA").carbon_gco2e_central
    assert total(ledger, pack, "FRA").energy_kwh_central == total(ledger, pack).energy_kwh_central
    with pytest.raises(ValueError, match="unknown region"):
        total(ledger, pack, "ZZZ")
    (tmp_path / "none.json").write_text('{"BAD": {}}')
    with pytest.raises(ValueError, match="no region"):
        load(spark, f"energy-mix:{tmp_path}/none.json")
    with pytest.raises(ValueError, match="no such adapter"):
        load(spark, "other:x")


def test_packs(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(GENERIC_WIDE))
    pack = load(spark, f"{tmp_path}/p.json")
    assert pack.sha256 == Pack.of(GENERIC_WIDE).sha256 != load(spark, "baseline").sha256
    assert pack.has_bounds() and not load(spark, "baseline").has_bounds()
    own = Pack.of({**BASELINE, "models": {"m": {"pricing_usd_per_mtok": {"output": 3}}}})
    assert own.models["m"]["price_output"] == (3, 3, 3) and own.models["m"]["price_input"] is None
    assert load(spark, "baseline").provenance_table(spark).count() == 3


@pytest.mark.parametrize("bad", [[2, 1, 3], [-1, 0, 1], -1])
def test_bounds_are_checked(bad):
    with pytest.raises(ValueError, match="in order"):
        interval.bounds(bad)


def test_mitigation(spark):
    carbon = spark.createDataFrame([(1e6, 2e6, 4e6)], "carbon_gco2e_low double, carbon_gco2e_central double, carbon_gco2e_high double")
    rows = scenario_table(spark, {"b": {"usd_per_tco2e": [1, 2, 3], "effective_tco2e_per_credited_tco2e": [0.5, 0.8, 1]}, "a": {"usd_per_tco2e": 10}, "c": {}})
    a, b = sorted(est.mitigation(carbon, rows).collect(), key=lambda r: r.scenario)
    assert tuple(a.proportional_usd) == (10, 20, 40) and tuple(a.cover_high_usd) == (40, 40, 40) and a.adjusted_usd is None
    assert tuple(b.adjusted_tonnes) == (4, 5, 8) and tuple(b.adjusted_usd) == (4, 10, 24)
    with pytest.raises(ValueError, match="must be positive"):
        scenario_table(spark, {"x": {"usd_per_tco2e": 1, "effective_tco2e_per_credited_tco2e": [0, 1, 1]}})


def test_rows_without_tokens_share_equally(spark):
    none = dict.fromkeys(("input", "cache_write", "cache_read", "output"), 0)
    rows = est.model_shares(row(spark, ["a", "b"], (0, 0, 0, 0), 4, by_model={"a": none, "b": none})).collect()
    assert sorted((r.model, r.share, r.turns) for r in rows) == [("a", 0.5, 2.0), ("b", 0.5, 2.0)]
