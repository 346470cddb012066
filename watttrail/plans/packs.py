"""Assumption packs and price scenarios: small versioned documents that turn usage into footprint.

A pack is read on the driver; it is a configuration of a few kilobytes. Its tables are for joins.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watttrail.functions import interval
from watttrail.operators.ledger import TOKENS

Bounds = tuple[float, float, float]

#: Rates of a model by the name of their column: key in the document, value where it is absent.
RATES = {
    "wh_output": ("wh_per_output_token", 0),
    "wh_input": ("wh_per_input_token", 0),
    "prefill": ("prefill_tokens_per_second", None),
    "decode": ("decode_tokens_per_second", None),
    "power": ("server_power_kw", None),
    "fixed": ("fixed_seconds_per_turn", 0),
    "cache_write_work": ("cache_write_work_factor", 1),
    "cache_read_work": ("cache_read_work_factor", 1),
}
PRICES = {f"price_{t}": t for t in TOKENS}
PROVENANCE = ["applies_to", "source", "adapter", "ref", "citation", "license", "retrieved", "note"]

#: Built-in packs; the numbers are fixed values.
BASELINE = {
    "pack_version": "0.2.0-baseline",
    "description": "World-average grid and one energy figure per token: order of magnitude only.",
    "pue": 1.2,
    "grid": {"gco2e_per_kwh": 475},
    "defaults": {
        "wh_per_output_token": 0.0003,
        "wh_per_input_token": 0.00003,
        "pricing_usd_per_mtok": {"input": 0.0, "cache_write": 0.0, "cache_read": 0.0, "output": 0.0},
    },
    "models": {
        "claude-opus-4-8": {"pricing_usd_per_mtok": {"input": 15.0, "cache_write": 18.75, "cache_read": 1.5, "output": 75.0}},
        "gpt-5.5": {"pricing_usd_per_mtok": {"input": 1.25, "cache_write": 1.25, "cache_read": 0.125, "output": 10.0}},
    },
    "provenance": [
        {"applies_to": "grid", "source": "world-average carbon intensity, 475 gCO2e/kWh", "license": "MIT", "retrieved": "2026-07-01"},
        {"applies_to": "energy", "source": "published per-token inference energy", "retrieved": "2026-07-01"},
        {"applies_to": "pricing", "source": "public list prices"},
    ],
}
GENERIC_WIDE = {
    "pack_version": "generic-wide-v1",
    "description": "Broad scenarios of a serving stack where nothing better is known.",
    "energy_model": {"type": "serving-stack"},
    "pue": [1.05, 1.25, 2.0],
    "grid": {"gco2e_per_kwh": [20.0, 350.0, 1000.0]},
    "electricity_usd_per_kwh": [0.04, 0.15, 0.5],
    "server_tool_kwh_per_call": [0.0, 0.0005, 0.01],
    "summary_chars_per_token": [2.5, 4.0, 6.0],
    "defaults": {
        "prefill_tokens_per_second": [5000.0, 50000.0, 250000.0],
        "decode_tokens_per_second": [10.0, 60.0, 250.0],
        "server_power_kw": [0.25, 1.5, 12.0],
        "fixed_seconds_per_turn": [0.0, 0.25, 3.0],
        "cache_write_work_factor": [0.25, 0.75, 1.0],
        "cache_read_work_factor": [0.01, 0.1, 0.5],
        "pricing_usd_per_mtok": {"input": 0.0, "cache_write": 0.0, "cache_read": 0.0, "output": 0.0},
    },
    "models": {},
}
#: Price scenarios in USD for a tonne; the numbers are fixed values.
SCENARIOS = {
    "avoided_or_reduced_emissions": {"instrument": "verified emission-reduction or avoidance credit", "usd_per_tco2e": [8.0, 25.0, 55.0]},
    "nature_based_removal": {"instrument": "biological carbon-removal credit", "usd_per_tco2e": [30.0, 60.0, 150.0]},
    "biochar_carbon_removal": {"instrument": "biochar carbon-removal credit", "usd_per_tco2e": [100.0, 150.0, 250.0]},
    "geological_or_mineral_removal": {"instrument": "geological or mineral carbon-removal credit", "usd_per_tco2e": [300.0, 700.0, 1200.0]},
}
BUILT_IN = {"baseline": BASELINE, "generic-wide": GENERIC_WIDE}


@dataclass
class Pack:
    document: dict
    version: str
    energy_model: str
    pue: Bounds
    electricity: Bounds
    tool_kwh: Bounds | None
    chars_per_token: Bounds
    grid: Bounds
    series: list[tuple[str, Bounds]]
    regions: dict[str, Bounds]
    models: dict[str | None, dict[str, Bounds | None]] = field(default_factory=dict)

    @staticmethod
    def of(document: dict) -> Pack:
        b, grid = interval.bounds, document.get("grid", {})
        defaults = document.get("defaults", {})
        pack = Pack(
            document,
            document.get("pack_version", ""),
            (document.get("energy_model") or {}).get("type", "per-token"),
            b(document.get("pue", 1)),
            b(document.get("electricity_usd_per_kwh", 0)),
            b(document["server_tool_kwh_per_call"]) if document.get("server_tool_kwh_per_call") is not None else None,
            b(document.get("summary_chars_per_token", 4)),
            b(grid.get("gco2e_per_kwh", 0)),
            sorted((x["from"], b(x["gco2e_per_kwh"])) for x in grid.get("intensity_by_date") or []),
            {k: b(v) for k, v in (grid.get("by_region") or {}).items()},
        )
        for model, own in {None: {}, **document.get("models", {})}.items():
            prices = defaults.get("pricing_usd_per_mtok", {}) if model is None else {}
            prices = {**prices, **own.get("pricing_usd_per_mtok", {})}
            given = {**(defaults if model is None else {}), **own}
            rates = {c: b(given[k]) if k in given else (b(d) if model is None and d is not None else None) for c, (k, d) in RATES.items()}
            rates |= {c: b(prices[t]) if t in prices else (b(0) if model is None else None) for c, t in PRICES.items()}
            pack.models[model] = rates
        return pack

    @property
    def sha256(self) -> str:
        raw = json.dumps(self.document, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return hashlib.sha256(raw.encode()).hexdigest()

    def has_bounds(self) -> bool:
        """Whether any figure is a range."""
        flat = [self.pue, self.electricity, self.tool_kwh, self.chars_per_token, self.grid, *(v for _, v in self.series), *self.regions.values()]
        flat += [v for rates in self.models.values() for v in rates.values()]
        return any(v is not None and v[0] != v[2] for v in flat)

    def region(self, name: str) -> Bounds:
        if name not in self.regions:
            raise ValueError(f"unknown region {name!r}")
        return self.regions[name]

    def model_table(self, spark: SparkSession) -> DataFrame:
        """``(model, rates...)``: what each named model overrides, null elsewhere."""
        names = [*RATES, *PRICES]
        rows = [(m, *(r[n] for n in names)) for m, r in self.models.items() if m is not None]
        return spark.createDataFrame(rows, "model string, " + ", ".join(f"{n} {interval.TYPE}" for n in names))

    def grid_table(self, spark: SparkSession) -> DataFrame:
        """``(valid_from, valid_to, intensity)`` by date; before the first date its value holds."""
        dates = [d for d, _ in self.series]
        spans = zip(["", *dates[1:]], [*dates[1:], "~"], (v for _, v in self.series), strict=True)
        return spark.createDataFrame(list(spans), f"valid_from string, valid_to string, intensity {interval.TYPE}")

    def region_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.regions.items()), f"region string, intensity {interval.TYPE}")

    def _provenance(self) -> list[tuple]:
        given = self.document.get("provenance") or []
        return [tuple(p.get(c) for c in PROVENANCE) for p in ([given] if isinstance(given, dict) else given)]

    def provenance_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self._provenance(), ", ".join(f"{c} string" for c in PROVENANCE))

    def provenance_column(self) -> Column:
        """The sources as a constant list of structs."""
        rows = [F.struct(*(F.lit(v).cast("string").alias(c) for c, v in zip(PROVENANCE, row, strict=True))) for row in self._provenance()]
        return F.array(*rows)


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def energy_mix(spark: SparkSession, path: str) -> DataFrame:
    """``(region, intensity)`` from a map of regions; entries without a number are left out."""
    text = spark.read.text(path, wholetext=True)
    mix = F.from_json("value", "map<string, struct<carbon_intensity: double>>")
    rows = text.select(F.explode(mix).alias("region", "entry")).where("entry.carbon_intensity is not null")
    return rows.select("region", F.round("entry.carbon_intensity", 3).alias("intensity"))


def pack_of_mix(spark: SparkSession, path: str) -> Pack:
    """The baseline pack with the regions of an energy mix; an empty mix raises."""
    regions = {r.region: r.intensity for r in energy_mix(spark, path).collect()}  # one entry a country
    if not regions:
        raise ValueError(f"no region with a carbon intensity in {path}")
    grid = {**BASELINE["grid"], "by_region": regions}
    note = {"applies_to": "grid", "source": "energy mix", "adapter": "energy-mix", "ref": path}
    return Pack.of({**BASELINE, "grid": grid, "provenance": [note, *BASELINE["provenance"]]})


ADAPTERS: dict[str, Callable[[SparkSession, str], Pack]] = {
    "json": lambda spark, ref: Pack.of(read_document(spark, ref)),
    "energy-mix": pack_of_mix,
}


def load(spark: SparkSession, spec: str) -> Pack:
    """A built-in pack by name, or ``adapter:path``, or the path of a JSON document."""
    if spec in BUILT_IN:
        return Pack.of(BUILT_IN[spec])
    adapter, colon, ref = spec.partition(":")
    if not colon or "/" in adapter or ref.startswith("//"):
        adapter, ref = "json", spec
    if adapter not in ADAPTERS:
        raise ValueError(f"no such adapter: {adapter}")
    return ADAPTERS[adapter](spark, ref)


#: What a price scenario may say beside its figures; fixed keys of the document.
DESCRIPTIVE = [
    "description", "credit_category", "removal_pathway", "storage_medium", "durability", "delivery", "uncertainty_profile",
    "claim_guidance", "effectiveness_basis", "provider", "source", "price_checked_at", "notes",
]


def scenario_table(spark: SparkSession, scenarios: dict = SCENARIOS) -> DataFrame:
    """``(scenario, instrument, price, effective, ...)`` by name, with what a scenario says of itself.

    Entries without a price are left out.
    """
    rows = []
    for name, spec in sorted(scenarios.items()):
        if isinstance(spec, dict) and spec.get("usd_per_tco2e") is not None:
            effective = spec.get("effective_tco2e_per_credited_tco2e")
            effective = None if effective is None else interval.bounds(effective)
            if effective is not None and effective[0] <= 0:
                raise ValueError(f"effectiveness of {name!r} must be positive")
            said = [None if spec.get(c) is None else str(spec[c]) for c in DESCRIPTIVE]
            rows.append((name, spec.get("instrument"), interval.bounds(spec["usd_per_tco2e"]), effective, *said))
    kinds = f"scenario string, instrument string, price {interval.TYPE}, effective {interval.TYPE}"
    return spark.createDataFrame(rows, ", ".join([kinds, *(f"{c} string" for c in DESCRIPTIVE)]))


def constant(bounds: Bounds | None) -> Column:
    return F.lit(None).cast(interval.TYPE) if bounds is None else interval.const(bounds)
