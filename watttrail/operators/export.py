"""Writers of reports, totals and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watttrail.operators.report import totals_document


def write_report(report: DataFrame, path: str, form: str = "json") -> None:
    """A report as JSON lines or tab-separated text with a header, sorted by its columns.

    The sorted rows go to files in order, a small report to one; the same rows give the same text.
    """
    rows = report.orderBy(*report.columns)
    if form == "json":
        rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif form == "tsv":
        rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    else:
        raise ValueError(f"no such form: {form}")


def write_totals(totals: DataFrame, path: str) -> None:
    """Totals as one JSON object with sorted keys."""
    write_report(totals.select(*sorted(totals.columns)), path)


def write_totals_document(ledger: DataFrame, path: str) -> None:
    """The nested totals of a ledger as one text file with one line."""
    totals_document(ledger).write.mode("overwrite").text(path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions below ``path``, ascending."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path + "/version=*/_SUCCESS")
    found = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done) or []
    return sorted(int(s.getPath().getParent().getName().partition("=")[2]) for s in found)


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """The claims of the last complete version."""
    return spark.read.schema("session_id string, repo string, ts_hi timestamp").parquet(f"{path}/version={_versions(spark, path)[-1]}")


def compact_claims(claims: DataFrame, path: str) -> None:
    """Merges claims into those at ``path``, the latest of each session and repository.

    The result is a new version beside the former, which readers use until the new one is
    complete; ``claims`` may come from the same folder. Versions before the former are deleted.
    """
    spark = claims.sparkSession
    known = _versions(spark, path)
    rows = claims.select("session_id", "repo", "ts_hi")
    if known:
        rows = rows.unionByName(read_claims(spark, path))
    number = known[-1] + 1 if known else 1
    rows.groupBy("session_id", "repo").agg(F.max("ts_hi").alias("ts_hi")).write.mode("overwrite").parquet(f"{path}/version={number}")
    for old in known[:-1]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def write_shards(lines: DataFrame, path: str, rows: int = 5_000, max_bytes: int = 1_000_000) -> None:
    """Ledger lines as text files of at most ``rows`` lines and ``max_bytes``, in a folder for each repository.

    The number of lines is such that as many of the longest line fit; only a line that is longer
    than ``max_bytes`` itself makes a longer file.
    """
    longest = lines.agg(F.max(F.octet_length("value") + 1)).first()[0] or 1
    most = max(1, min(rows, max_bytes // longest))
    lines.write.mode("append").partitionBy("repo").option("maxRecordsPerFile", most).text(path)
