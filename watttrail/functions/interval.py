"""Interval columns: ``struct<low, central, high>`` of non-negative doubles in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDS = ("low", "central", "high")
TYPE = "struct<low: double, central: double, high: double>"


def bounds(value: float | Sequence[float] | dict) -> tuple[float, float, float]:
    """A number, three numbers, or a mapping as bounds; negative or unordered ones raise."""
    if isinstance(value, dict):
        value = [value[b] for b in BOUNDS]
    elif isinstance(value, (int, float)):
        value = [value] * 3
    low, central, high = (float(v) for v in value)
    if not 0 <= low <= central <= high:
        raise ValueError(f"bounds must be non-negative and in order: {low}, {central}, {high}")
    return low, central, high


def make(low: Column, central: Column, high: Column) -> Column:
    """An interval; it keeps its three columns, so that arithmetic on it nests no structs."""
    parts = dict(zip(BOUNDS, (low, central, high), strict=True))
    made = F.struct(*(c.cast("double").alias(b) for b, c in parts.items()))
    made.__dict__["interval_parts"] = parts
    return made


def bound(x: Column, name: str) -> Column:
    parts = x.__dict__.get("interval_parts")
    return parts[name] if parts else x[name]


def const(value: float | Sequence[float] | dict) -> Column:
    return make(*(F.lit(b) for b in bounds(value)))


def exact(column: Column) -> Column:
    return make(column, column, column)


def valid(x: Column) -> Column:
    """Whether the bounds are present, non-negative and in order."""
    return F.coalesce((x["low"] >= 0) & (x["low"] <= x["central"]) & (x["central"] <= x["high"]), F.lit(False))


def checked(x: Column) -> Column:
    return F.when(valid(x), x).otherwise(F.raise_error(F.lit("bounds must be non-negative and in order")))


def add(a: Column, b: Column) -> Column:
    return make(*(bound(a, x) + bound(b, x) for x in BOUNDS))


def mul(a: Column, b: Column) -> Column:
    return make(*(bound(a, x) * bound(b, x) for x in BOUNDS))


def div(a: Column, b: Column) -> Column:
    """Low over high and high over low; a divisor that may be zero raises."""
    least = bound(b, "low")
    least = F.when(least > 0, least).otherwise(F.raise_error(F.lit("a divisor's low bound must be positive")))
    return make(bound(a, "low") / bound(b, "high"), bound(a, "central") / bound(b, "central"), bound(a, "high") / least)


def scaled(a: Column, factor: float) -> Column:
    return make(*(bound(a, x) * F.lit(factor) for x in BOUNDS))


def total(name: str) -> list[Column]:
    """Aggregates that sum an interval column bound by bound."""
    return [F.coalesce(F.sum(F.col(name)[x]), F.lit(0.0)).alias(f"{name}_{x}") for x in BOUNDS]
