"""Columns picked by name from tables that may have any other columns beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(df: DataFrame, name: str) -> int:
    """Position of the column ``name``: of exactly that name, else the first that differs only in case."""
    if name in df.columns:
        return df.columns.index(name)
    return [c.lower() for c in df.columns].index(name.lower())


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named ``c0``, ``c1`` and so on."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """The columns ``wanted`` (new name to name in ``df``), whatever other columns are called."""
    plain = numbered(df)
    return plain.select(*(plain[f"c{place(df, name)}"].alias(new) for new, name in wanted.items()))


def restored(plain: DataFrame, names: list[str], *added: Column) -> DataFrame:
    """Columns ``c0`` ... of ``plain`` under ``names`` again, then ``added``."""
    return plain.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)), *added)
