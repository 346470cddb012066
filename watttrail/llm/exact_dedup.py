"""Exact deduplication: a two-pass Bloom filter lets rows that surely do not repeat pass straight.

Pass 1 builds a blocked Bloom filter over the digests of all texts: a row sets ``HASHES`` bits of
one 64-bit word. Words are built by task and merged by ``bit_or`` with the number of bits that
were set; where fewer bits show than were set, some bit was set twice, and two rows of that word
may be equal. No other word can hold a repeat. Pass 2 tests every row: one whose word shows no
repeat is unique and leaves without any exchange; only the others shuffle, to an exact comparison
by SHA-256. False positives cost work, never results.

Only words with a repeat are kept, so the filter's size follows the number of repeated texts. Up
to ``FILTER_WORDS`` words it is broadcast; a larger one meets the rows in a join on the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watttrail.operators.skew import lookup
from watttrail.session import stage

HASHES = 2
WORDS_PER_ROW = 16
#: About 32 bytes each as a broadcast relation: 128 MB.
FILTER_WORDS = 4_000_000


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _word(words: int) -> Column:
    return F.pmod(F.xxhash64("sha"), F.lit(words))


def _bits() -> Column:
    """The bits of a row within its word; two of them may fall together."""
    source = "xxhash64(sha, 1)"
    return F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned({source}, {6 * k}) & 63 as int))" for k in range(HASHES)))


def repeat_filter(digests: DataFrame, words: int) -> DataFrame:
    """Words ``(word, bits)`` of the filter over ``digests(sha)`` in which some bit was set more than once."""
    hits = digests.select(_word(words).alias("word"), _bits().alias("bits"))
    merged = hits.groupBy("word").agg(F.bit_or("bits").alias("bits"), F.sum(F.bit_count("bits")).alias("hits"))
    return merged.where(F.col("hits") > F.bit_count("bits")).select("word", "bits")


def mark_repeats(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """``rows`` (with a column ``sha``) plus ``may_repeat`` under the filter over ``digests``."""
    words = 1 << max(16, (digests.count() * WORDS_PER_ROW - 1).bit_length())
    found = stage(repeat_filter(digests, words), "bloom")
    side = found.select(F.col("word").alias("_word"), F.lit(True).alias("_repeats"))
    side = F.broadcast(side) if found.count() <= FILTER_WORDS else side
    joined = rows.join(side, _word(words) == F.col("_word"), "left")
    return joined.withColumn("may_repeat", F.col("_repeats").isNotNull()).drop("_word", "_repeats")


def _order(chars: Column, doc_id: Column) -> list[Column]:
    """Smallest first: most code points, then smallest id, null ids last."""
    return [(-chars).alias("fewer"), doc_id.isNull().alias("no_id"), doc_id.alias("id")]


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after deleting ASCII white space. Of equal texts the row with
    the most code points, then the smallest id, stays; of fully tied rows exactly one. A null
    text counts as empty, a null id sorts last. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = df.select(
        F.col(id_col).alias("id"), F.char_length(text).alias("chars"), digest(F.col(text_col)).alias("sha")
    ).withColumn("row", F.monotonically_increasing_id())
    digests = stage(narrow, "digests")
    marked = mark_repeats(digests, digests)
    straight = marked.where(~F.col("may_repeat")).select(
        F.col("id").alias(id_col),
        F.col("id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    candidates = marked.where("may_repeat").drop("may_repeat")
    best = F.min(F.struct(*_order(F.col("chars"), F.col("id")), "row")).alias("best")
    groups = stage(candidates.groupBy("sha").agg(F.count("*").alias("n"), best), "groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    entries = groups.select(
        "sha",
        "n",
        F.col("n").alias("group_size"),
        F.col("best.id").alias("keep_id"),
        F.col("best.row").alias("keep_row"),
    )
    compared = lookup(candidates, entries, "sha", "n", total, "row").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return straight.unionByName(compared)


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; unique rows are not exchanged.

    Equal rows meet in an aggregate that is combined before the exchange, so a large group of
    copies sends one row from each task.
    """
    hashed = df.withColumn("sha", digest(F.col(text_col)))
    digests = stage(hashed.select("sha"), "digests")
    marked = mark_repeats(df.select(F.struct("*").alias("_row"), digest(F.col(text_col)).alias("sha")), digests)
    straight = marked.where(~F.col("may_repeat")).select("_row.*")
    row = F.col("_row")
    chars = F.char_length(F.coalesce(row[text_col], F.lit("")))
    first = F.min_by("_row", F.struct(*_order(chars, row[id_col]), row[text_col].alias("text")))
    compared = marked.where("may_repeat").groupBy("sha").agg(first.alias("_row")).select("_row.*")
    return straight.unionByName(compared)
