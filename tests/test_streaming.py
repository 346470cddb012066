"""Streams that stop, start again and see a session's turns in any order."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from watttrail.streaming import incremental as inc

START = datetime(2026, 1, 1)
SCHEMA = (
    "agent string, session_id string, msg_id string, ts timestamp, model string, input long, cache_write long, cache_read long, output long, "
    "web_search long, web_fetch long, repo string, file_order string, line_no long"
)


def turn(key, hour, output=1, line=0, session="s", repo="r"):
    return ("a", session, key, START + timedelta(hours=hour), "m", 1, 0, 0, output, 0, 0, repo, "", line)


@pytest.fixture
def place(tmp_path):
    return {k: str(tmp_path / k) for k in ("in", "turns", "ledger", "progress")}


def arrive(spark, place, boundaries, rows):
    """One more file for the stream, then a run of it from where the last one stopped."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(place["in"])
    stream = spark.readStream.schema(SCHEMA).parquet(place["in"])
    inc.record(stream, boundaries, place["turns"], place["ledger"], place["progress"], folders=4)


def booked(spark, place):
    rows = inc.read_ledger(spark, place["ledger"]).collect()
    return {(r["session_id"], r["commit"]): (r["turns"], r["output"]) for r in rows}


def commits(spark, *hours):
    rows = [("r", f"c{h}", START + timedelta(hours=h)) for h in hours]
    return spark.createDataFrame(rows, "repo string, sha string, commit_ts timestamp")


def test_a_commit_spans_batches_and_a_restart(spark, place):
    marks = commits(spark, 10, 20)
    arrive(spark, place, marks, [turn(f"a{i}", i % 10) for i in range(44)])
    assert booked(spark, place) == {("s", "c10"): (44, 44)}
    arrive(spark, place, marks, [turn(f"b{i}", i % 10) for i in range(18)] + [turn("late", 15)])
    assert booked(spark, place) == {("s", "c10"): (62, 62), ("s", "c20"): (1, 1)}
    arrive(spark, place, marks, [turn("b1", 1, 7, 1), turn("other", 3, 5, session="t")])
    assert booked(spark, place) == {("s", "c10"): (62, 68), ("s", "c20"): (1, 1), ("t", "c10"): (1, 5)}


def test_turns_without_a_commit_wait_and_a_sweep_books_them_once(spark, place):
    none = commits(spark).where("false")
    for k in range(3):
        arrive(spark, place, none, [turn(f"{k}-{i}", k + i / 60) for i in range(20)] + ([turn("x", 1), turn("y", 2)] if k == 1 else []))
    inc.sweep(spark, place["turns"], place["ledger"], "2026-01-05")
    assert booked(spark, place) == {("s", "pending@2026-01-05"): (62, 62)}
    inc.sweep(spark, place["turns"], place["ledger"], "2026-01-05", 1)
    assert booked(spark, place) == {("s", "pending@2026-01-05"): (62, 62)}
    arrive(spark, place, commits(spark, 50), [turn("z", 40)])
    assert booked(spark, place) == {("s", "pending@2026-01-05"): (62, 62), ("s", "c50"): (1, 1)}


def test_a_message_that_moves_to_a_later_commit_leaves_the_former(spark, place):
    marks = commits(spark, 10, 20)
    arrive(spark, place, marks, [turn("one", 9, 3), turn("only", 9, 4, session="t")])
    arrive(spark, place, marks, [turn("one", 12, 5, 1), turn("only", 12, 6, 1, session="t"), turn("two", 8)])
    assert booked(spark, place) == {("s", "c10"): (1, 1), ("s", "c20"): (1, 5), ("t", "c20"): (1, 6)}


def both_arrive(spark, place, rows=(), *hours):
    """More files for the streams of turns and of commits, then a run of both."""
    marks = commits(spark, *hours)
    for data, kind, path in ((spark.createDataFrame(list(rows), SCHEMA), SCHEMA, place["in"]), (marks, None, place["in"] + "-commits")):
        if kind is None and hours or rows and kind:
            data.coalesce(1).write.mode("append").parquet(path)
    for path in (place["in"], place["in"] + "-commits"):
        Path(path).mkdir(exist_ok=True)
    streams = spark.readStream.schema(SCHEMA).parquet(place["in"]), spark.readStream.schema(marks.schema).parquet(place["in"] + "-commits")
    inc.record(*streams, place["turns"], place["ledger"], place["progress"], folders=4)


def test_commits_that_become_known_after_their_turns(spark, place):
    both_arrive(spark, place, [turn("t1", 10)])
    assert booked(spark, place) == {}
    both_arrive(spark, place, [turn("t2", 10.5)], 10.1, 11)
    assert booked(spark, place) == {("s", "c10.1"): (1, 1), ("s", "c11"): (1, 1)}


def test_a_commit_alone_books_a_quiet_session(spark, place):
    both_arrive(spark, place, [turn("t1", 1), turn("t2", 5), turn("u1", 30, session="u"), turn("x", 4, session="x", repo="q")])
    both_arrive(spark, place, (), 6)
    assert booked(spark, place) == {("s", "c6"): (2, 2)}
    both_arrive(spark, place, (), 2)
    assert booked(spark, place) == {("s", "c2"): (1, 1), ("s", "c6"): (1, 1)}
    both_arrive(spark, place, (), 5.5)
    assert booked(spark, place) == {("s", "c2"): (1, 1), ("s", "c5.5"): (1, 1)}
    inc.sweep(spark, place["turns"], place["ledger"], "2026-01-05")
    assert sum(n for n, _ in booked(spark, place).values()) == 4
    both_arrive(spark, place, (), 40)  # what a sweep has booked stays
    assert booked(spark, place)[("u", "pending@2026-01-05")] == (1, 1) and ("u", "c40") not in booked(spark, place)


def test_commits_before_any_turn(spark, place):
    both_arrive(spark, place, (), 3)
    both_arrive(spark, place, [turn("a", 1), turn("b", 4)])
    assert booked(spark, place) == {("s", "c3"): (1, 1)}


def test_latest_record_of_a_message_whatever_the_order(spark, tmp_path):
    columns = "session_id string, msg_id string, ts timestamp, file_order string, line_no long, output long"
    rows = {0: [("s", "m", START, "", 5, 50), ("s", "n", START, "", 1, 1)], 1: [("s", "m", START, "", 2, 20), ("s", "n", None, "", 2, 2)], 2: [("s", "m", START + timedelta(hours=1), "", 9, 90)]}
    for part in rows.values():
        spark.createDataFrame(part, columns).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(columns).parquet(f"{tmp_path}/in")
        inc.keep_latest(stream, ["session_id", "msg_id"], f"{tmp_path}/out", f"{tmp_path}/progress")
    got = inc.read_latest(spark, f"{tmp_path}/out", ["session_id", "msg_id"]).select("msg_id", "output").collect()
    assert [tuple(r) for r in got] == [("m", 90)]


def test_claims_only_rise(spark, tmp_path):
    columns = "session_id string, repo string, ts_hi timestamp"
    for hour in (5, 3, 8):
        spark.createDataFrame([("s", "r", START + timedelta(hours=hour)), ("s", "q", START)], columns).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        inc.keep_claims(spark.readStream.schema(columns).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/progress")
    got = inc.read_claims(spark, f"{tmp_path}/out").orderBy("repo").collect()
    assert [(r.repo, r.ts_hi) for r in got] == [("q", START), ("r", START + timedelta(hours=8))]


def test_turns_are_deduplicated_once_on_the_way_to_their_commits(spark):
    rows = spark.createDataFrame([turn("a", 1), turn("a", 12, 5, 1), turn("b", 8), turn("c", 30), turn("d", 3, repo="q")], SCHEMA)
    turns, marks = inc.dedup_turns(rows), commits(spark, 10, 20)
    placed = inc.next_boundary(turns, marks, ["repo"], times=rows)
    assert placed.columns == [*turns.columns, "sha", "commit_ts"]
    assert placed._jdf.queryExecution().optimizedPlan().toString().count("row_number() windowspecdefinition(") == 1
    found = {r.msg_id: (r.ts, r.output, r.sha) for r in placed.collect()}
    assert found == {"a": (START + timedelta(hours=12), 5, "c20"), "b": (START + timedelta(hours=8), 1, "c10"), "c": (START + timedelta(hours=30), 1, None), "d": (START + timedelta(hours=3), 1, None)}
