"""Near-duplicates by Jaccard similarity of word shingles: SimHash and MinHash propose, exact sets decide.

SimHash (``simhash.components``) proposes each text with the least of its component, all at a
distance of a few bits. MinHash bands propose those that lie further apart. Two texts of similarity
``s`` share one of ``BANDS`` bands of ``ROWS`` minima with probability ``1 - (1 - s ** ROWS) ** BANDS``,
0.9999 at 0.8; that is all that is left to chance.

Texts that proposals connect are a group. Groups of any size are compared whole, by the sparse
products of ``overlap.linked_sets``: every pair of a group is multiplied block by block, unless it
is already in one component. No pair is linked unless its exact similarity reaches the threshold.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watttrail.llm import overlap, simhash
from watttrail.llm.overlap import linked_sets, prints, row_components, small_batches
from watttrail.session import stage

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
SEED = 42
_CHUNK = 2000
_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
_OFFSETS = _rng.integers(0, 2**64, BANDS * ROWS, np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle."""
    return overlap.shingles(text, shingle)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; 0 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of minima; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), _CHUNK):
        # the high half of a product mixes well; its low bits do not
        mixed = (hashes[k : k + _CHUNK, None] ^ _OFFSETS) * _FACTORS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def _found(docs: DataFrame, least: float) -> DataFrame:
    """``(id, component_id)`` for every row of ``docs(id, text)``, the least id of its component. Ids are distinct and not null."""
    bound = Fraction(least).limit_denominator(10_000)
    with small_batches(docs.sparkSession):
        shown = stage(prints(docs, SHINGLE, lambda s: np.array(bands(s), np.uint64), simhash.fingerprint), "prints")
    # the wordless have no node, and equal sets can differ in their fingerprint
    alike = simhash.components(stage(shown.select(F.col("node").alias("id"), "fp").distinct(), "simhashes"))
    proposed = alike.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
    linked = linked_sets(docs, shown, SHINGLE, bound.numerator, bound.denominator, proposed)
    return row_components(shown, linked).select("id", "component_id")


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``(node, root)`` for ids with a similar text, the root being the component's least id.

    Ids are distinct; rows with a null id are left out. Texts without words are similar to none.
    """
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = stage(_found(docs, least).select(F.col("id").alias("node"), F.col("component_id").alias("root")), "found")
    return found.join(found.where("node <> root").select("root").distinct(), "root", "left_semi").select("node", "root")


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of each component of similar texts stays: that with the least id (null ids last), then the first read.

    Rows are told apart by a number of their own, so ids may repeat or be null; of rows with one id
    and text one stays. Texts without words are similar to none and all stay. An empty table gives
    an empty result.
    """
    content = F.xxhash64(text_col)
    # the least of these stays
    id_ = F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("own"), F.monotonically_increasing_id().alias("row"), content.alias("content"))
    found = _found(df.select(id_.alias("id"), F.col(text_col).alias("text")), least).where("id <> component_id")
    key, stays = (F.struct(F.col(c)["own"].alias("own"), F.col(c)["content"].alias("content")) for c in ("id", "component_id"))
    # rows with one id and text are copies, of which the last step leaves one
    gone = stage(found.select(key.alias("key"), (key == stays).alias("copy")).distinct(), "gone")
    keyed = df.select(F.struct("*").alias("row"), F.struct(F.col(id_col).alias("own"), content.alias("content")).alias("key"))
    single = keyed.join(gone.select("key"), "key", "left_anti").select("row.*")
    copies = keyed.join(gone.where("copy").select("key"), "key", "left_semi")
    return single.unionByName(copies.groupBy("key").agg(F.first("row").alias("row")).select("row.*"))
