"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Row ``i`` of ``n`` (in the order of the key) goes to position ``p = permute(i)`` of a
pseudo-random permutation of ``[0, n)``; its shard is ``p mod shards`` and its slot
``p div shards``. Anyone who knows a row's number, ``n`` and the seed computes shard and slot
without reading the data. Counts of shards differ by one at most and slots have no gaps.

The network works on pairs from ``Z_a x Z_b`` with ``a = ceil(sqrt(n))`` and ``b = ceil(n / a)``,
so the domain exceeds ``n`` by less than ``a``; a position outside ``[0, n)`` is permuted again
until it falls inside (cycle walking).

Everything is a DataFrame expression. Rows are numbered after one range exchange on the key, so
the key columns should be narrow; the numbering adds a table of one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watttrail.llm.columns import numbered, place, restored
from watttrail.session import stage

ROUNDS = 6
#: Steps of cycle walking. The share of positions outside falls below 1/sqrt(n), so a walk of
#: this length fails with a chance below n**-16, and cannot fail where n is below 1000.
WALK = 32


def permute(number: Column, n: Column, seed: int = 0) -> Column:
    """Position of row ``number`` under the permutation of ``[0, n)`` that ``seed`` selects."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1))
    b = F.greatest(((n + a - 1) / a).cast("long"), F.lit(1).cast("long"))

    def mix(i: Column, half: Column, modulus: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed).cast("long"), i, half), modulus)

    def one_round(state: Column, i: Column) -> Column:
        left, right = state["l"], state["r"]
        return F.when(
            i % 2 == 0, F.struct(F.pmod(left + mix(i, right, a), a).alias("l"), right.alias("r"))
        ).otherwise(F.struct(left.alias("l"), F.pmod(right + mix(i, left, b), b).alias("r")))

    def network(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))
        return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, one_round, lambda s: s["l"] * b + s["r"])

    steps = F.array(*map(F.lit, range(WALK)))
    position = F.aggregate(steps, network(number), lambda x, _: F.when(x < n, x).otherwise(network(x)))
    return F.when(position < n, position).otherwise(F.raise_error(F.lit("cycle walk did not end")))


def number_rows(df: DataFrame, key: list[str], number: str = "row_number", total: str = "row_count") -> DataFrame:
    """Adds the row's number in the order of ``key`` (nulls first) and the count of all rows.

    Rows with equal keys get consecutive numbers in an order that is not defined, so ``key``
    should tell apart whatever must be told apart. A key that many rows share is split over
    partitions by a tie-break. Other columns of ``df`` may have any names.
    """
    keys = [F.col(f"c{place(df, k)}") for k in key]
    tagged = numbered(df).withColumn("tie", F.monotonically_increasing_id())
    ordered = tagged.repartitionByRange(*keys, "tie").sortWithinPartitions(*keys, "tie").drop("tie")
    staged = stage(ordered.withColumn("at", F.monotonically_increasing_id()), "numbered")
    part, index = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = staged.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "part",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"),
        F.sum("rows").over(W.partitionBy()).alias("total"),
    )
    # one row per partition of the exchange
    joined = staged.withColumn("part", part).join(F.broadcast(offsets), "part")
    return restored(joined, df.columns, (F.col("before") + index).alias(number), F.col("total").alias(total))


def shard_rows(df: DataFrame, key: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Adds ``shard`` (int) and ``slot`` (long, from 0) to every row of ``df``.

    Nulls in the key count as a value of their own. Repeated rows are all kept. An empty table
    gives an empty result. Columns named ``shard``, ``slot``, ``row_number`` or ``row_count``, in
    any case, are replaced; other columns may have any names, two that differ in case included.
    """
    own = ("shard", "slot", "row_number", "row_count")
    kept = [(i, c) for i, c in enumerate(df.columns) if c.lower() not in own]
    plain = numbered(df).select(*(F.col(f"c{i}").alias(f"k{i}") for i, _ in kept))
    at = {c: f"k{i}" for i, c in reversed(kept)}
    keys = [at[k] if k in at else f"k{place(df, k)}" for k in key]
    placed = number_rows(plain, keys, "number", "total").withColumn("p", permute(F.col("number"), F.col("total"), seed))
    return placed.select(
        *(F.col(f"k{i}").alias(c) for i, c in kept),
        F.col("number").alias("row_number"),
        F.pmod("p", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("p") / shards).cast("long").alias("slot"),
    )
