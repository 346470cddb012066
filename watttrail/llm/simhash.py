"""Near-duplicates by SimHash: pigeonhole blocks find the pairs, Hamming distance verifies them.

A fingerprint is cut into blocks; fingerprints that differ in at most ``d`` bits agree on all
but ``d`` of them, so two of a pair share at least one choice of ``blocks - d`` whole blocks.
Fingerprints meet by those choices. The number of blocks follows the number of distinct
fingerprints, so that chance meetings stay few per fingerprint at any size.

No bucket's pairs are ever written out: a bucket yields the links of a spanning forest. A bucket
of more than ``BUCKET`` fingerprints is not compared in one task; its fingerprints meet at
midpoints instead: if two differ in at most ``d`` bits, some value lies within ``d // 2`` bits
of one and ``d - d // 2`` of the other. Every fingerprint sends itself to all values that near,
a constant number, and values are groups of bounded size. Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watttrail.operators.components import connected_components
from watttrail.operators.skew import lookup, meet
from watttrail.session import stage

SHINGLE = 3
DISTANCE = 3
SEED = 42
BUCKET = 2048
_CHUNK = 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    stops = ends[shingle - 1 :].tolist() or [len(joined)]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(stops), _CHUNK):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[k : k + _CHUNK], stops[k : k + _CHUNK], strict=False)]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(stops)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp)`` for every row, the fingerprint as a signed long."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def choose_blocks(n: int, distance: int = DISTANCE) -> int:
    """Fewest blocks for which a choice of ``blocks - distance`` has as many values as there are fingerprints."""
    blocks = distance + 2
    while blocks < distance + 5 and 64 * (blocks - distance) // blocks < n.bit_length() + 3:
        blocks += 1
    return blocks


def _masks(blocks: int, distance: int) -> list[int]:
    edges = [64 * k // blocks for k in range(blocks + 1)]
    single = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(single, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def spanning_links(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links ``(least of the component, member)`` among fingerprints of one bucket."""
    links, rest = [], np.sort(values)
    while len(rest) > 1:
        root, frontier, rest = int(rest[0]), rest[:1], rest[1:]
        while len(frontier) and len(rest):
            near = (np.bitwise_count((frontier[:, None] ^ rest[None, :]).view(np.uint64)) <= distance).any(axis=0)
            frontier, rest = rest[near], rest[~near]
            links += [(root, int(x)) for x in frontier]
    return links


def _bucket_links(buckets: DataFrame, distance: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            links = [x for a, b in zip(offsets, offsets[1:], strict=False) for x in spanning_links(values[a:b], distance)]
            pairs = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def _flips(radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(64), r)], np.uint64)


def midpoint_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links among ``fps(fp)`` that join all pairs within ``distance``, found at midpoints."""
    near, far = distance // 2, distance - distance // 2
    masks = _flips(far)
    inner = len(_flips(near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part in np.array_split(values, max(1, len(values) // 64)):
                at = (part[:, None] ^ masks[None, :]).ravel().view(np.int64)
                who = np.repeat(part.view(np.int64), len(masks))
                close = np.tile(np.arange(len(masks)) < inner, len(part))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(who), pa.array(close)], ["at", "fp", "close"])

    sent = fps.select("fp").mapInArrow(run, "at long, fp long, close boolean")
    hub = F.min(F.when(F.col("close"), F.col("fp"))).alias("a")
    # a value hears from the fingerprints within `far` bits at most
    met = sent.groupBy("at").agg(hub, F.collect_set("fp").alias("members"))
    return met.where("a is not null and size(members) > 1").select("a", F.explode("members").alias("b")).where("a <> b")


def links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, blocks: int | None = None) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fps(fp)``.

    Their connected components are those of the graph of all pairs within ``distance`` bits.
    """
    blocks = blocks or choose_blocks(fps.count(), distance)
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(_masks(blocks, distance))]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    shared = stage(sizes.where("n > 1"), "shared")
    twos = shared.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    more = shared.where("n > 2").select("key", "n", F.col("n").alias("size"))
    total = more.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return twos
    members = stage(meet(keyed, more, "key", "n", total), "members")
    cold = members.where(F.col("size") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    found = twos.union(_bucket_links(cold, distance))
    hot = members.where(F.col("size") > bucket).select("fp").distinct()
    return found if hot.isEmpty() else found.union(midpoint_links(hot, distance))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row of ``df``.

    Fingerprints within ``distance`` bits are linked; a component's id is the least id among its
    rows (null ids are ignored). Null and empty texts have fingerprint 0, which links like any
    other. Repeated rows share a component. An empty table gives an empty result.
    """
    rows = stage(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    return components(rows, distance).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def components(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(id, fp, component)`` for ``rows(id, fp)``, the least id of each component of linked fingerprints."""
    groups = stage(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "groups")
    labels = connected_components(links(groups.select("fp"), distance))
    linked = stage(labels.join(groups, F.col("node") == F.col("fp")).select("fp", "root", "first"), "linked")
    least = stage(linked.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("n")), "least")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    component = lookup(linked, least, "root", "n", total, "fp").select("fp", "least")
    entries = groups.join(component, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("component"))
    count = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return lookup(rows, stage(entries, "entries"), "fp", "n", count, "id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``near_duplicates`` stays: that with the least id.

    Rows with a null id are kept, as no id can name them.
    """
    found = near_duplicates(df, id_col, text_col)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col)
    return df.join(gone, id_col, "left_anti")
