"""Registered queries that run as streams over files which Spark writes from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from watttrail.operators import attribution as at
from watttrail.plans import derive
from watttrail.session import new_path, stage
from watttrail.streaming import incremental as inc

QUERIES, ORACLE_SQL = {}, {}
_STATE = "spark.sql.streaming.stateStore.providerClass"


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = derive.SQL + sql
        return f

    return add


def _waves(spark, rows, label, parts=3, part=None):
    """Yields a stream over ``rows`` after each part is written; by message, so that sessions span parts.

    A stream run on each is started anew with what is there, as after a restart.
    """
    path = new_path(spark, label)
    staged = rows.withColumn("_part", F.pmod(F.xxhash64("msg_id", *(["line_no"] if "line_no" in rows.columns else [])), F.lit(parts)) if part is None else part)
    for k in range(parts):
        staged.where(F.col("_part") == k).drop("_part").write.mode("append").parquet(path)
        yield spark.readStream.schema(rows.schema).parquet(path)


@query("select repo, commit, session_id, agent, turns, input, output from measured")
def str_incremental_record(spark, sf_dir):
    """Turns and commits are two streams in three parts, the two records of a message apart.

    A commit comes with its turns, after them or before them; the third part of the commits has a
    run of its own, without new turns. The sweep takes what no commit did.
    """
    turns, ledger, progress = new_path(spark, "turns"), new_path(spark, "ledger"), new_path(spark, "progress")
    records, commits = derive.records(spark, sf_dir), derive.commits(spark, sf_dir)
    waves = _waves(spark, records, "records"), _waves(spark, commits, "commits", 3, F.pmod(F.xxhash64("sha"), F.lit(3)))
    seen = next(waves[0]), next(waves[1])
    inc.record(*seen, turns, ledger, progress, folders=16)
    for more in ((0,), (0, 1), (1,)):
        for k in more:
            next(waves[k])
        inc.record(*seen, turns, ledger, progress, folders=16)
    inc.sweep(spark, turns, ledger, derive.SWEEP)
    return inc.read_ledger(spark, ledger).select("repo", "commit", "session_id", "agent", "turns", "input", "output")


@query("""select t.session_id, t.msg_id from turns t left join (select session_id, repo, max(ts_hi) mark from measured where commit < '8' group by all) m
    using (session_id, repo) left join (select session_id, repo, max(ts) top from turns where event_id % 3 = 0 group by all) o
    on o.session_id = t.session_id where (mark is null or ts > mark) and (top is null or ts > top)""")
def str_pending_sweep(spark, sf_dir):
    """A sweep after half of the commits are recorded, when another repository claims a third of the turns."""
    rows = derive.measured(spark, sf_dir).where("commit < '8'").select("repo", "session_id", "commit", "ts_hi")
    others = derive.turns(spark, sf_dir).where("cast(msg_id as bigint) % 3 = 0").selectExpr("'elsewhere' repo", "session_id", "'x' commit", "ts ts_hi")
    return at.pending_sweep(derive.turns(spark, sf_dir), rows.unionByName(others)).select("session_id", "msg_id")


@query("select session_id, repo, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%g') as ts_hi from turns group by all")
def str_claims_state(spark, sf_dir):
    path, progress = new_path(spark, "kept"), new_path(spark, "progress")
    rows = derive.turns(spark, sf_dir).selectExpr("session_id", "repo", "msg_id", "ts ts_hi")
    for stream in _waves(spark, stage(rows, "turns"), "claims"):
        inc.keep_claims(stream, path, progress)
    return inc.read_claims(spark, path).select("session_id", "repo", F.date_format("ts_hi", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts_hi"))


@query("""select session_id, msg_id from turns t where event_id % 3 <> 0 or epoch_us(ts) > (
    select coalesce(max(epoch_us(u.ts)), 0) from turns u where u.session_id = t.session_id and u.event_id % 3 <> 0)""")
def str_late_turns(spark, sf_dir):
    """Two thirds of the turns come first; of the rest only those later than their session's mark count."""
    rows = derive.turns(spark, sf_dir).selectExpr("session_id", "msg_id", "unix_micros(ts) us")
    out, progress = new_path(spark, "kept"), new_path(spark, "progress")
    late = (F.col("msg_id").cast("bigint") % 3 == 0).cast("int")
    before = spark.conf.get(_STATE)
    spark.conf.set(_STATE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for stream in _waves(spark, stage(rows, "turns"), "late", 2, late):
            inc.run_available(inc.drop_late(stream), lambda df, number: inc.write_batch(df, number, out), progress)
    finally:
        spark.conf.set(_STATE, before)
    return spark.read.parquet(out).select("session_id", "msg_id")


@query("select session_id, msg_id, output from turns")
def str_dedup(spark, sf_dir):
    """Repeats of a message arrive in different parts, with other figures: the last record counts."""
    path, progress = new_path(spark, "latest"), new_path(spark, "progress")
    rows = derive.records(spark, sf_dir).select("session_id", "msg_id", "ts", "file_order", "line_no", "output")
    for stream in _waves(spark, rows, "repeats"):
        inc.keep_latest(stream, ["session_id", "msg_id"], path, progress)
    return inc.read_latest(spark, path, ["session_id", "msg_id"]).select("session_id", "msg_id", "output")
