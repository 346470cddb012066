"""Files as lines in order: in transcripts the order of lines has meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Splits of a file are at least this long, so each has a number of its own.
_LEAST_SPLIT = 1 << 20
_IN_SPLIT = (1 << 33) - 1


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, mtime, line_no, value)`` for every line that is not blank.

    ``line_no`` rises through a file: it holds the split's number and the line's place among those
    of the reading task, as ``monotonically_increasing_id`` gives it. Files of any size are read
    in splits; only a line must fit a row. ``spark.sql.files.openCostInBytes``, which bounds the
    length of splits from below, must not be set under a megabyte.
    """
    files = spark.read.option("recursiveFileLookup", True).text(path)
    number = F.shiftleft(F.floor(F.col("_metadata.file_block_start") / _LEAST_SPLIT), 33)
    lines = files.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("mtime"),
        (number + F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_SPLIT))).alias("line_no"),
        "value",
    )
    return lines.where(F.trim("value") != "")


def parsed(lines: DataFrame) -> DataFrame:
    """Adds ``v``, the line as a variant; null where it is no JSON object."""
    value = F.try_parse_json("value")
    return lines.withColumn("v", F.when(F.schema_of_variant(value).startswith("OBJECT"), value))


def corrupt_lines(lines: DataFrame, by: str = "path") -> DataFrame:
    """Count of readable and corrupt lines of each file, or of each value of another column."""
    bad = F.col("v").isNull()
    return parsed(lines).groupBy(by).agg(F.count(F.when(~bad, 1)).alias("readable"), F.count(F.when(bad, 1)).alias("corrupt"))


def get(path: str, kind: str = "string", of: str = "v") -> Column:
    """A field of a variant; null where it is missing or of another kind."""
    return F.try_variant_get(F.col(of), path, kind)


def amount(*paths: str, of: str = "v") -> Column:
    """The first of the fields as a count, 0 where none is a number."""
    return F.coalesce(*(get(p, "bigint", of) for p in paths), F.lit(0).cast("long"))


def text_or(*columns: Column, default: str | None = None) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(default).cast(T.StringType()))


#: Session of a transcript: the file's stem, or for a sub-agent's file the directory above.
def session_of(path: Column) -> Column:
    return F.coalesce(
        F.nullif(F.regexp_extract(path, r"([^/]+)/subagents/[^/]+$", 1), F.lit("")),
        F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1),
    )


def with_file_order(lines: DataFrame) -> DataFrame:
    """Adds ``session_id`` and ``file_order`` (the main file, then the sub-agents' by name), unless given."""
    if {"session_id", "file_order"} <= set(lines.columns):
        return lines
    order = F.when(F.col("path").contains("/subagents/"), F.col("path")).otherwise("")
    return lines.withColumn("session_id", session_of(F.col("path"))).withColumn("file_order", order)
