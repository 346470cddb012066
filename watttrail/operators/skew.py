"""Lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds at least this share of the rows, so at most 1/HOT_SHARE keys are.
HOT_SHARE = 1 / 1000
SPREAD = 4096


def lookup(rows: DataFrame, entries: DataFrame, key: str, weight: str, total: int, spread_by: str) -> DataFrame:
    """Left join of ``rows`` with ``entries``, which has one row per key.

    ``weight`` is the column of ``entries`` with the number of rows of each key and ``total``
    their sum. The hot keys, at most 1000 whatever the size of the data, are broadcast. Rows
    they serve and rows with a null key still pass through the shuffled join of the other keys,
    spread by ``spread_by`` under a salt that nothing matches. Columns of ``rows`` may have any
    names; the values of ``entries`` come after them.
    """
    least = max(2, int(total * HOT_SHARE))
    values = [c for c in entries.columns if c not in (key, weight)]
    hot = entries.where(F.col(weight) >= least).select(F.col(key).alias("k"), F.struct(*values).alias("hot"))
    cold = entries.where(F.col(weight) < least).select(F.col(key).alias("k"), F.struct(*values).alias("cold"), F.lit(0).alias("salt"))
    at = {c: "k" if c == key else f"c{i}" for i, c in enumerate(rows.columns)}
    plain = rows.toDF(*at.values())
    served = F.col("hot").isNotNull() | F.col("k").isNull()
    salt = F.when(served, 1 + F.pmod(F.xxhash64(at[spread_by]), F.lit(SPREAD))).otherwise(0).cast("int")
    joined = plain.join(F.broadcast(hot), "k", "left").withColumn("salt", salt).join(cold, ["k", "salt"], "left")
    found = F.coalesce("hot", "cold")
    return joined.select(*[F.col(place).alias(c) for c, place in at.items()], *[found[c].alias(c) for c in values])


def meet(rows: DataFrame, entries: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``entries``, which has one row per key, balanced as ``lookup`` is.

    Only rows that have an entry come out of the join. The hot keys, at most 1000, are known to the
    plan, so their rows meet the broadcast entries and never pass the shuffle of the others.
    """
    least = max(2, int(total * HOT_SHARE))
    found = entries.drop(weight)
    hot = [r[0] for r in entries.where(F.col(weight) >= least).select(key).collect()]
    if not hot:
        return rows.join(found, key)
    own = F.col(key).isin(hot)
    return rows.where(~own).join(found.where(~own), key).unionByName(rows.where(own).join(F.broadcast(found.where(own)), key))
