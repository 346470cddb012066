"""Structured Streaming forms: incremental recording, sweeps, claims, late turns and repeats.

The caller owns the checkpoint folder, so a stream that is started again goes on where it stopped
and its batch numbers keep rising. What a batch writes replaces what the same batch wrote before
a failure, and of two versions of a ledger row that of the later batch counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from watttrail.operators import ledger as ledgers
from watttrail.operators.attribution import commit_label, next_boundary, pending_sweep
from watttrail.operators.turns import dedup_turns, last_wins
from watttrail.session import stage

#: Sessions are spread over this many folders of the turns table.
BUCKETS = 256
_ROW = ["repo", "session_id", "agent", "commit"]
_COMMIT = ["repo", "sha", "commit_ts"]


def run_available(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over all that is there since ``checkpoint`` was last used, batch by batch."""
    query = stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def write_batch(rows: DataFrame, number: int, path: str, by: list[str] | None = None) -> None:
    """Adds a batch to a table; a batch that runs again replaces its own files."""
    numbered = rows.withColumn("batch", F.lit(number))
    if by:
        numbered = numbered.hint("rebalance", *by)  # few files a folder, and a full one is split
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*(by or []), "batch").parquet(path)


def record(stream: DataFrame, boundaries: DataFrame, turns_path: str, ledger_path: str, checkpoint: str, folders: int = BUCKETS) -> None:
    """Records a stream of turn records (with ``repo``) into tables of turns and of ledger rows.

    ``boundaries`` has the commits, ``repo``, ``sha`` and ``commit_ts``: a table, or a second
    stream, which is then read together with the first, so that a commit books the turns that
    wait for it although none come with it. Commits may become known in any order and after
    their turns. Beside the turns table stand ``_spans``, the time that a batch's turns of a
    session cover, and ``_commits``, the commits by the batch that first had them.

    A batch adds its records to the turns table. It then works out the rows of the sessions that
    have new records, or turns for which a new commit is the next one, from all of their turns,
    and writes those that the ledger lacks or has with other figures; it reads only the folders
    of these sessions. Turns after the last commit wait for one, or for a ``sweep``; turns that a
    sweep has booked stay there. ``recorded_at`` is the commit's time. A commit that loses all of
    its turns, to an earlier commit or by later records, gets a row of no turns.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if boundaries.isStreaming:
            fresh, arrived = rows.where("turn is not null").select("turn.*"), rows.where("commit is not null").select("commit.*")
        else:
            fresh, arrived = rows, boundaries.select(*_COMMIT)
        bucket = F.pmod(F.xxhash64("session_id"), F.lit(folders)).cast("int")
        kind = StructType([*stream.schema.fields]).add("bucket", "integer").add("batch", "long")
        write_batch(fresh.withColumn("bucket", bucket), number, turns_path, ["bucket"])
        stored = _stored(spark, turns_path, kind)
        spans = stored.where(F.col("batch") == number).groupBy("repo", "session_id").agg(F.min("ts").alias("ts"), F.max("ts").alias("ts_hi"))
        write_batch(spans, number, f"{turns_path}_spans")
        known = _stored(spark, f"{turns_path}_commits", "repo string, sha string, commit_ts timestamp, batch long")
        new = arrived.groupBy("repo", "sha").agg(F.min("commit_ts").alias("commit_ts")).where("commit_ts is not null")
        write_batch(new.join(known.where(F.col("batch") < number), ["repo", "sha"], "left_anti"), number, f"{turns_path}_commits")

        commits = _stored(spark, f"{turns_path}_commits", "repo string, sha string, commit_ts timestamp, batch long").where(F.col("batch") <= number)
        spans = _stored(spark, f"{turns_path}_spans", "repo string, session_id string, ts timestamp, ts_hi timestamp, batch long").where(F.col("batch") <= number)
        sessions = stage(_touched(spans, commits, number), "sessions")
        buckets = [r[0] for r in sessions.select(bucket).distinct().collect()]  # as many as folders at most
        before = _stored(spark, ledger_path, f"{ledgers.SCHEMA}, batch long").where(F.col("batch") < number).join(sessions, ["repo", "session_id"], "left_semi")
        pending = F.col("commit").startswith("pending@")
        swept = stage(_latest(before.where(pending)).select("repo", "session_id", "commit", "ts_lo", "ts_hi"), "swept")
        own = stored.where(F.col("bucket").isin(buckets) & (F.col("batch") <= number)).drop("batch", "bucket")
        own = without_swept(own.join(sessions, ["repo", "session_id"], "left_semi"), swept)
        turns = dedup_turns(own).drop("msg_id", "file_order", "line_no")
        placed = next_boundary(turns, commits, ["repo"], times=own).where("sha is not null").withColumn("commit", F.col("sha"))
        whole = ledgers.measured_rows(placed, F.col("commit_ts"))
        write_batch(_changes(whole, before.where(~pending)), number, ledger_path, ["repo"])

    if boundaries.isStreaming:
        turns, marks = stream.select(F.struct(*stream.columns).alias("turn")), boundaries.select(F.struct(*_COMMIT).alias("commit"))
        run_available(turns.unionByName(marks, allowMissingColumns=True), batch, checkpoint)
    else:
        run_available(stream, batch, checkpoint)


def _touched(spans: DataFrame, commits: DataFrame, number: int) -> DataFrame:
    """Sessions with records in this batch, and those with turns between a new commit and the commit before it."""
    day = F.date_trunc("day", "commit_ts")
    times = commits.select("repo", "commit_ts").distinct().withColumn("day", day)
    days = times.groupBy("repo", "day").agg(F.max("commit_ts").alias("top"))
    days = days.withColumn("earlier", F.lag("top").over(W.partitionBy("repo").orderBy("day"))).drop("top")
    same_day = F.lag("commit_ts").over(W.partitionBy("repo", "day").orderBy("commit_ts"))
    gaps = times.withColumn("same_day", same_day).join(days, ["repo", "day"]).select("repo", "commit_ts", F.coalesce("same_day", "earlier").alias("since"))
    new = stage(commits.where(F.col("batch") == number).join(gaps, ["repo", "commit_ts"]), "new_commits")
    # if the gap before the first new commit from a span's start on begins after its end, so do those of later ones
    met = next_boundary(spans.where("ts is not null"), new, ["repo"]).where("sha is not null")
    since = new.select("repo", "commit_ts", "since").distinct()
    met = met.join(since, ["repo", "commit_ts"]).where("since is null or since < ts_hi")
    fresh = spans.where(F.col("batch") == number)
    return fresh.select("repo", "session_id").union(met.select("repo", "session_id")).distinct()


def _stored(spark: SparkSession, path: str, kind: str | StructType) -> DataFrame:
    """The table at ``path``; without rows where nothing has been written yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(kind).parquet(path) if system.exists(folder) else spark.createDataFrame([], kind)


def read_ledger(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The latest version of each row that ``record`` and ``sweep`` wrote; rows left without turns are out.

    With ``before``, what batches from that number on wrote does not count.
    """
    rows = _stored(spark, path, f"{ledgers.SCHEMA}, batch long")
    return _latest(rows if before is None else rows.where(F.col("batch") < before))


def _latest(rows: DataFrame) -> DataFrame:
    return ledgers.latest_rows(rows.withColumnRenamed("batch", "src_order")).where("turns > 0").drop("src_order")


def _figures() -> Column:
    """A hash of all that a ledger row has."""
    return F.xxhash64(F.to_json(F.struct(*sorted(StructType.fromDDL(ledgers.SCHEMA).names))))


def _changes(whole: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of ``whole`` that the versions ``before`` lack or have last with other figures, and rows of no turns for those they alone have.

    Versions and new rows meet in one exchange by the row's key; versions come as hashes.
    """
    old = before.groupBy(*_ROW).agg(F.max_by(F.struct("turns", "commit_ts", _figures().alias("figures")), F.struct("recorded_at", "batch")).alias("_old"))
    rest = [c for c in whole.columns if c not in _ROW]
    new = whole.select(*_ROW, F.struct(*rest).alias("_new"), _figures().alias("_figures"))
    met = new.join(old.where("_old.turns > 0"), _ROW, "full")
    zeros = dict.fromkeys([*ledgers.TOKENS, *ledgers.TOOLS, "turns", "billable_input"], F.lit(0).cast("long"))
    lone = {"kind": F.lit(ledgers.MEASURED), "commit_ts": F.col("_old.commit_ts"), "recorded_at": F.col("_old.commit_ts"), **zeros}
    gone = F.col("_new").isNull()
    either = [F.when(gone, lone[c]).otherwise(F.col(f"_new.{c}")).alias(c) if c in lone else F.col(f"_new.{c}") for c in rest]
    return met.where("_new is null or _old is null or _figures <> _old.figures").select(*_ROW, *either)


def without_swept(turns: DataFrame, ledger: DataFrame) -> DataFrame:
    """Turns outside the spans that earlier sweeps booked as pending for their session."""
    spans = ledger.where(F.col("commit").startswith("pending@")).select("repo", "session_id", "ts_lo", "ts_hi")
    inside = (turns["repo"] == spans["repo"]) & (turns["session_id"] == spans["session_id"]) & turns["ts"].between(spans["ts_lo"], spans["ts_hi"])
    return turns.join(spans, inside, "left_anti")


def sweep(spark: SparkSession, turns_path: str, ledger_path: str, sweep_date: str, number: int = 0) -> None:
    """Books what no commit has taken, and no other repository has claimed, as pending at ``sweep_date``.

    ``number`` tells sweeps of one day apart.
    """
    # a session's latest turn in each repository is all of the ledger that a sweep looks at
    ledger = stage(read_ledger(spark, ledger_path).groupBy("repo", "session_id").agg(F.max("ts_hi").alias("ts_hi")), "marks")
    records = spark.read.parquet(turns_path).drop("batch", "bucket")
    # a message's last record decides, so all records of those messages count of which any is left
    keys = ["agent", "session_id", "msg_id"]
    open_keys = stage(pending_sweep(records, ledger).select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct(), "open")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    left = pending_sweep(dedup_turns(records.join(open_keys, same, "left_semi")), ledger)
    day = F.lit(sweep_date).cast("date")
    empty = {"sha": F.lit(None).cast("string"), "commit_ts": F.lit(None).cast("timestamp")}
    rows = ledgers.measured_rows(left.withColumns(empty).withColumn("commit", commit_label(day)), day.cast("timestamp"))
    label = int(sweep_date.replace("-", "")) * -100 - number  # no batch has a negative number
    write_batch(rows, label, ledger_path, ["repo"])


def keep_claims(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Adds to the table at ``path`` each session's and repository's latest turn whenever it rises."""
    claims = stream.groupBy("session_id", "repo").agg(F.max("ts_hi").alias("ts_hi"))
    run_available(claims, lambda rows, number: write_batch(rows, number, path), checkpoint, "update")


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("session_id", "repo").agg(F.max("ts_hi").alias("ts_hi"))


class MarkKeeper(StatefulProcessor):
    """Passes a session's turns on that are later than all of its turns in earlier batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        known = self.mark.get()[0] if self.mark.exists() else None
        top = known
        for part in rows:
            kept = part if known is None else part[part["us"] > known]
            if len(part):
                top = int(part["us"].max()) if top is None else max(top, int(part["us"].max()))
            yield kept
        if top is not None:
            self.mark.update((top,))

    def close(self) -> None:
        pass


def drop_late(stream: DataFrame) -> DataFrame:
    """Drops turns of ``stream(session_id, msg_id, us)`` at or before their session's mark."""
    return stream.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=MarkKeeper(), outputStructType="session_id string, msg_id string, us long", outputMode="append", timeMode="none"
    )


def keep_latest(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> None:
    """Keeps the last record of each message, by ``file_order`` and ``line_no``, in the table at ``path``.

    A batch adds the last of its own records of each message and ``read_latest`` takes the last of
    all batches, so records may come in any order and however late, with other figures or without
    a time. No state grows with the stream.
    """
    order = [F.desc("file_order"), F.desc("line_no")]
    run_available(stream, lambda rows, number: write_batch(last_wins(rows, keys, order), number, path), checkpoint)


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    rows = spark.read.parquet(path)
    return last_wins(rows, keys, [F.desc("file_order"), F.desc("line_no"), F.desc("batch")]).where("ts is not null").drop("batch")
