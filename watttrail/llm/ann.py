"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: vectors are centred, rotated and cut to signs. The rotation is learned on a bounded sample
(``SAMPLE`` rows) by alternating between codes and the orthogonal matrix that best maps onto them,
once for each group of dimensions' worth of bits, from different starts.

Index: a code is cut into substrings of ``SUBSTRING`` bits, about the logarithm of a block's rows;
each block keeps, for every substring, its rows by substring value. A query looks up all values
that differ from its own substring in at most ``flips`` bits. By the pigeonhole principle that
retrieves every code within ``substrings * (flips + 1) - 1`` bits, and of those beyond all that
come as near in some substring. The rows retrieved, and no others, are verified by popcount
against the radius that holds the sample's neighbours, and reranked by inner products in double
precision.

``flips`` and the radius are measured on the sample: the least with which ``TARGET`` of the true
neighbours among the sample are found. A denser table has nearer neighbours, so the recall over
all rows is higher. A query that finds fewer than ``k`` rows in a block probes one more flip, and
so on, until it has them or all rows of the block.

Rows are dealt into blocks of about ``BLOCK`` by hash and queries into groups of about ``GROUP``;
each pair of them is one task's work, and its top ``k`` leave it. All rows are indexed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watttrail.session import stage

BITS = 512
SUBSTRING = 16
SAMPLE = 8_192
ROUNDS = 20
TARGET = 0.92
BLOCK, GROUP = 65_536, 65_536
_AT_ONCE = 32


def learn_rotations(sample: np.ndarray, bits: int = BITS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Centre and a (dimensions, bits) matrix of stacked rotations, each fitted to its own codes."""
    centre = sample.mean(axis=0)
    x = sample - centre
    rng, d, parts = np.random.default_rng(seed), sample.shape[1], []
    for _ in range(-(-bits // d)):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
            r = (u @ vt).T
        parts.append(r)
    return centre, np.concatenate(parts, axis=1)[:, :bits]


def encode(vectors: np.ndarray, centre: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Codes as (rows, bits / 8) bytes."""
    return np.packbits((vectors - centre) @ rotations >= 0, axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance of each code of ``a`` to each of ``b``, for the sample."""
    a, b = (x.reshape(len(x), -1).view(np.uint64) for x in (a, b))
    out = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k][:, None] ^ b[:, k][None, :])
    return out


def flip_masks(flips: int) -> np.ndarray:
    """All substring values with at most ``flips`` bits set, those with fewer first."""
    return np.array([sum(1 << b for b in c) for r in range(flips + 1) for c in combinations(range(SUBSTRING), r)], np.uint16)


def measure(sample: np.ndarray, codes: np.ndarray, k: int, target: float = TARGET) -> tuple[int, int]:
    """Least flips with which ``target`` of the sample's own nearest neighbours are retrieved, and
    the Hamming distance within which as large a share of the retrieved ones lies."""
    queries = np.arange(0, len(sample), max(1, len(sample) // 256))
    score = sample[queries] @ sample.T
    score[np.arange(len(queries)), queries] = -np.inf
    near = np.argsort(-score, axis=1)[:, : min(k, max(1, len(sample) - 1))]
    values = codes.view(">u2")
    closest = np.bitwise_count(values[queries][:, None, :] ^ values[near]).min(axis=2)
    flips = int(np.quantile(closest, target, method="higher"))
    found = np.take_along_axis(_distances(codes[queries], codes), near, axis=1)
    return flips, int(np.quantile(found[closest <= flips], 1 - (1 - target) / 4, method="higher"))


class MultiIndex:
    """Substring tables of one block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        values = codes.view(">u2").astype(np.uint16)
        # one table per substring: rows sorted by its value, and where each value starts
        self.rows = [np.argsort(v, kind="stable").astype(np.int32) for v in values.T]
        self.starts = [np.concatenate(([0], np.cumsum(np.bincount(v, minlength=1 << SUBSTRING)))) for v in values.T]

    def probe(self, queries: np.ndarray, flips: int) -> np.ndarray:
        """For each query, the rows that some table holds within ``flips`` bits of its substring."""
        hit = np.zeros((len(queries), len(self.codes)), bool)
        masks, values = flip_masks(flips), queries.view(">u2").astype(np.uint16)
        for s, (rows, starts) in enumerate(zip(self.rows, self.starts, strict=True)):
            probed = values[:, s][:, None] ^ masks[None, :]
            first, size = starts[probed], starts[probed.astype(np.int64) + 1] - starts[probed]
            each = size.sum(axis=1)
            flat = size.ravel()
            at = np.arange(flat.sum()) + np.repeat(first.ravel() - np.cumsum(flat) + flat, flat)
            hit[np.repeat(np.arange(len(queries)), each), rows[at]] = True
        return hit

    def within(self, queries: np.ndarray, radius: int) -> Iterator[np.ndarray]:
        """For each query in turn, all rows whose codes lie within ``radius``, found by pigeonhole."""
        for query, hit in zip(queries, self.probe(queries, min(radius // len(self.rows), SUBSTRING)), strict=True):
            found = np.flatnonzero(hit)
            yield found[self.distances(query, found) <= radius]

    def distances(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.codes[rows].view(np.uint64) ^ query.view(np.uint64)).sum(axis=1)

    def search(self, queries: np.ndarray, flips: int, radius: int, least: int) -> Iterator[np.ndarray]:
        """For each query in turn, the retrieved rows whose codes lie within ``radius``; ``least`` at
        least, or all, of which the radius and the flips grow where it finds fewer."""
        least = min(least, len(self.codes))
        for start in range(0, len(queries), _AT_ONCE):
            some = queries[start : start + _AT_ONCE]
            for query, hit in zip(some, self.probe(some, flips), strict=True):
                found, more = np.flatnonzero(hit), flips
                while True:
                    near = found[self.distances(query, found) <= radius + len(self.rows) * (more - flips)]
                    if len(near) >= least or more == SUBSTRING:
                        break
                    more += 1
                    found = np.flatnonzero(self.probe(query[None, :], more)[0]) if more < SUBSTRING else np.arange(len(self.codes))
                yield near if len(near) >= least else found


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(df: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row where ``query`` holds.

    Nearness is the inner product of the original vectors in double precision, ties go to the
    smaller id, and a query's own row is no candidate (all rows with its id, if repeated). Vectors
    that are null, zero, or hold a null or non-finite component take no part, nor do null ids.
    Vectors of another length than most of the sample's (of equal counts the shorter) take no part
    either. An empty table gives an empty result.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), vector.alias("vector"), F.coalesce(query, F.lit(False)).alias("asks"))
    rows = stage(rows.where(usable(F.col("vector")) & F.col("id").isNotNull()), "vectors")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()  # a bounded sample
    lengths = Counter(len(r.vector) for r in sample)
    length = min(lengths, key=lambda m: (-lengths[m], m), default=0)
    rows, sample = rows.where(F.size("vector") == length), [r for r in sample if len(r.vector) == length]
    n, asked = rows.count(), rows.where("asks").count()
    if not sample or not asked:
        return _ranked(rows.where("false").select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")), k, id_col)
    data = np.array([r.vector for r in sample])
    centre, rotations = learn_rotations(data, bits)
    flips, radius = measure(data, encode(data, centre, rotations), k)

    blocks, groups = -(-n // BLOCK), -(-asked // GROUP)
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    group = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(groups)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    index = rows.select("id", "vector", block.alias("block"), each(groups).alias("group"))
    queries = rows.where("asks").select("id", "vector", group.alias("group"), each(blocks).alias("block"))
    id_type = pa.int64()

    def matrix(t: pa.Table) -> np.ndarray:
        column = t.column("vector").combine_chunks()
        return column.flatten().to_numpy().reshape(len(column), -1)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if len(left) and len(right):
            # in the order of ids, so that ties of the score keep the smaller ones
            right = right.sort_by("id")
            ids, vectors, own, asks = right.column("id").to_numpy(), matrix(right), left.column("id").to_numpy(), matrix(left)
            tables = MultiIndex(encode(vectors, centre, rotations))
            # a query's own row is found too, however often it is repeated
            repeats = int(np.unique(ids, return_counts=True)[1].max())
            for key, q, found in zip(own, asks, tables.search(encode(asks, centre, rotations), flips, radius, k + repeats), strict=True):
                found = found[ids[found] != key]
                score = (vectors[found] * q).sum(axis=1)
                if len(found) > k:
                    least = np.partition(score, len(score) - k)[len(score) - k]
                    found, score = found[score >= least], score[score >= least]
                best = np.argsort(-score, kind="stable")[:k]
                for values, value in zip(out, (np.full(len(best), key), ids[found[best]], score[best]), strict=True):
                    values.append(value)
        kinds = (id_type, id_type, pa.float64())
        return pa.Table.from_arrays([pa.array(np.concatenate(v) if v else [], t) for v, t in zip(out, kinds, strict=True)], ["query_id", "vec_id", "score"])

    keys = ["block", "group"]
    found = queries.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    return _ranked(found, k, id_col)


def _ranked(found: DataFrame, k: int, id_col: str) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def recall(found: Iterator[tuple[int, int]], truth: Iterator[tuple[int, int]]) -> float:
    """Share of the true ``(query, neighbour)`` pairs that were found."""
    truth = set(truth)
    return len(truth & set(found)) / max(1, len(truth))
