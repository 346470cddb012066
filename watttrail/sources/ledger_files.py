"""Ledgers kept as JSON lines in files, of one repository or of many."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watttrail.functions.wire import decode
from watttrail.sources.lines import read_lines

#: Directories in which no ledger of a repository lies.
SKIPPED = (".venv", "venv", "node_modules")


def ledger_lines(spark: SparkSession, path: str | list[str] | None, notes: str | list[str] | None = None) -> DataFrame:
    """Decoded rows of ledger files and of exported notes, with the order in which they are read.

    A flat ``ledger.jsonl`` comes before shards by name; notes come after all files.
    """
    parts = []
    if path:
        flat = F.col("path").rlike(r"/ledger\.jsonl$")
        files = read_lines(spark, path).withColumn("src_order", F.lit(0))
        parts.append(files.withColumn("file_order", F.when(flat, "").otherwise(F.col("path"))))
    if notes:
        parts.append(read_lines(spark, notes).withColumn("src_order", F.lit(1)).withColumn("file_order", F.col("path")))
    return decode(reduce(DataFrame.unionByName, parts).drop("mtime"))


def repo_of(path: Column) -> Column:
    """Directory of the repository whose ledger or notes a file belongs to: that above its hidden folder."""
    return F.regexp_extract(F.regexp_replace(path, "^file:(//)?", ""), r"^(.*)/\.[^/]+/(?:ledger|notes)/[^/]+$", 1)


def discover(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Folders ``ledger`` and ``notes`` (exported notes) of all repositories below ``root``, at any depth.

    They lie in hidden folders, which Spark's own listing passes over. Directories are walked
    level by level through the file system; those of ``SKIPPED`` are not entered.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, list[str]] = {"ledger": [], "notes": []}
    level = [top]
    while level:
        entries = [(s.getPath(), d) for d in level for s in system.listStatus(d) if s.isDirectory()]
        level = []
        for path, above in entries:
            name = path.getName()
            if above.getName().startswith(".") and name in found:
                found[name].append(path.toString())
            elif name not in SKIPPED and name != ".git":
                level.append(path)
    return {kind: sorted(folders) for kind, folders in found.items()}


def fleet_lines(spark: SparkSession, root: str) -> DataFrame:
    """Decoded rows of all ledgers and notes below ``root``, with each row's repository directory."""
    folders = discover(spark, root)
    if not any(folders.values()):
        raise ValueError(f"no ledger below {root}")
    return ledger_lines(spark, folders["ledger"], folders["notes"]).withColumn("repo", repo_of(F.col("path")))
