"""Ledger rows, their wire form, versions, attribution and reports on small hand-made cases."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from watttrail.functions import text, wire
from watttrail.operators import attribution as at
from watttrail.operators import ledger as ledgers
from watttrail.operators import report
from watttrail.plans.ledger_queries import COMMANDS
from watttrail.session import new_path
from watttrail.sources.ledger_files import discover, fleet_lines, ledger_lines


def when(minute):
    return datetime(2026, 1, 1, 12, minute)


TURN = "repo string, session_id string, agent string, msg_id string, ts timestamp, model string, input long, cache_write long, cache_read long, output long, web_search long, web_fetch long"


def turn(repo, session, minute, output, model="m"):
    return (repo, session, "codex", f"{session}{minute}", when(minute), model, 10, 1, 2, output, 1, 0)


def book(spark, rows, commits):
    turns = spark.createDataFrame(rows, TURN)
    marks = spark.createDataFrame(commits, "repo string, sha string, commit_ts timestamp")
    placed = at.next_boundary(turns, marks, ["repo"]).withColumn("commit", at.commit_label(F.lit("2026-01-02").cast("date")))
    return ledgers.measured_rows(placed, F.lit("2026-01-03").cast("timestamp"))


def test_turns_go_to_the_next_commit(spark):
    rows = [turn("a", "s", 1, 1), turn("a", "s", 5, 2, "n"), turn("a", "s", 6, 4), turn("a", "s", 50, 8), turn("b", "s", 1, 16)]
    late = (rows[0][0], "s", "codex", "early", datetime(2025, 12, 1), "m", 0, 0, 0, 32, 0, 0)
    got = book(spark, [*rows, late], [("a", "c1", when(5)), ("a", "c0", when(5)), ("a", "c2", when(9))]).collect()
    found = {(r.repo, r.commit): (r.output, r.turns, r.models, r.wall_clock_s) for r in got}
    # the turn of another day reaches the first commit through the table of buckets
    assert found[("a", "c0")][:3] == (35, 3, ["m", "n"])
    assert found[("a", "c2")] == (4, 1, ["m"], 0.0)
    assert found[("a", "pending@2026-01-02")][0] == 8 and found[("b", "pending@2026-01-02")][0] == 16
    first = next(r for r in got if r.commit == "c0")
    assert first.billable_input == first.input + first.cache_write + first.cache_read == 26
    assert first.by_model["n"].output == 2


def test_versions(spark):
    rows = book(spark, [turn("a", "s", 1, 1), turn("a", "s", 50, 5), turn("a", "s", 55, 7)], [("a", "c", when(5))])
    pending = rows.where("commit <> 'c'")
    other = pending.withColumns({"ts_hi": F.lit(when(58)), "output": F.lit(2).cast("long")})
    newer = rows.where("commit = 'c'").withColumns({"recorded_at": F.lit(datetime(2026, 2, 1)), "output": F.lit(9).cast("long")})
    nameless = rows.where("commit = 'c'").withColumn("agent", F.lit(None).cast("string"))
    got = ledgers.latest_rows(rows.unionByName(other).unionByName(newer).unionByName(nameless)).collect()
    assert sorted((r.commit, r.output) for r in got) == [("c", 1), ("c", 9), ("pending@2026-01-02", 2), ("pending@2026-01-02", 12)]


def test_wire_form(spark):
    rows = book(spark, [("a", "s", "codex", "1", when(1), "m", 100, 50, 200, 30, 0, 0)], [("a", "c", when(5))])
    line = json.loads(wire.encode(rows).first().value)
    assert line["t"] == [100, 50, 200, 30] and line["bm"] == {"m": [100, 50, 200, 30]} and line["v"] == 3
    assert not {"act", "st", "k", "bt", "cp"} & set(line)
    assert line["tr"] == ["2026-01-01T12:01:00.000000Z"] * 2
    lines = [
        json.dumps(line),
        '{"v":3,"c":"x","sid":"s","a":"g","t":[1,2],"m":["m"],"n":1}',
        '{"v":3,"c":"y","k":"cx","bt":"2026-01-01T00:00:00Z","cp":[7,8],"m":["m"]}',
        '{"schema":"old/v2","commit":"z","tokens":{"output":9}}',
        "[1]", "{torn", "", "3",
    ]
    got = {r.commit: r for r in wire.decode(spark.createDataFrame([(x,) for x in lines], "value string")).collect() if not r.corrupt}
    assert got["c"].billable_input == 350 and got["c"].by_model["m"].cache_read == 200
    assert (got["x"].input, got["x"].cache_write, got["x"].cache_read, got["x"].output) == (1, 2, 0, 0)
    assert (got["y"].kind, got["y"].peak_context_tokens, got["y"].summary_chars, got["y"].turns) == ("compaction-estimate", 7, 8, None)
    assert (got["z"].output, got["z"].kind) == (9, "measured")
    assert wire.decode(spark.createDataFrame([(x,) for x in lines], "value string")).where("corrupt").count() == 3


def test_claims_keep_a_session_from_two_sweeps(spark):
    turns = spark.createDataFrame([turn("b", "s", m, m) for m in (10, 20, 30)] + [turn("a", "s", m, m) for m in (10, 30)], TURN)
    empty = book(spark, [turn("b", "s", 20, 95)], [])
    left = at.pending_sweep(turns, empty)
    assert sorted((r.repo, r.output) for r in left.collect()) == [("a", 30), ("b", 30)]
    claimed = spark.createDataFrame([("s", "a", 1), ("s", "b", 3), ("s", "c", 2), ("t", "a", 5)], "session_id string, repo string, ts_hi int")
    ceilings = {(r.session_id, r.repo): r.ceiling for r in at.claim_ceilings(claimed).collect()}
    assert ceilings == {("s", "a"): 3, ("s", "b"): 2, ("s", "c"): 3, ("t", "a"): None}


def test_commands(spark):
    rows = spark.createDataFrame([(c, "/w/s") for c, _, _ in COMMANDS], "command string, cwd string")
    got = rows.select(text.is_commit_command(F.col("command")), text.commit_directory(F.col("command"), F.col("cwd"))).collect()
    assert [tuple(r) for r in got] == [(yes, where) for _, yes, where in COMMANDS]
    assert not spark.range(1).select(text.is_commit_command(F.lit(None).cast("string"))).first()[0]


def test_paths(spark):
    sessions = spark.createDataFrame([("1", "/w/repo"), ("2", "/w/repo/a/b/"), ("3", "/w/repo10"), ("4", None)], "session_id string, cwd string")
    repos = spark.createDataFrame([("/w/repo", "r")], "root string, repo string")
    assert sorted(r.session_id for r in at.sessions_in_repos(sessions, repos).collect()) == ["1", "2"]
    assert spark.range(1).select(text.project_directory(F.lit("/a/b_c.d-é"))).first()[0] == "-a-b-c-d--"


def test_reports(spark):
    rows = book(spark, [turn("a", "s", 1, 95), turn("b", "t", 1, 95), turn("b", "t", 40, 1)], [("a", "0123456789abc", when(5)), ("b", "c", when(5))])
    fleet = {r.repo: (r.output, r.commits) for r in report.fleet(rows).collect()}
    assert fleet == {"a": (95, 1), "b": (96, 1), "TOTAL": (191, 2)}
    keys = {r.key: (r.turns, r.models) for r in report.report(rows, "commit").collect()}
    assert keys == {"0123456789": (1, "m"), "c": (1, "m"), "pending@20": (1, "m")}
    assert [(r.key, r.turns) for r in report.report(rows, "model").collect()] == [("m", 0)]
    assert report.totals(rows.where("false")).first().output == 0
    counts = spark.createDataFrame([(950,), (1234,), (66_600_000,), (1_000_000_000,), (-1500,)], "n long")
    assert [r[0] for r in counts.select(report.human(F.col("n"))).collect()] == ["950", "1.2k", "66.6M", "1.0B", "-1.5k"]


def test_append_and_fleet(spark, tmp_path):
    rows = book(spark, [turn("a", "s", 1, 3)], [("a", "c", when(5))])
    path = new_path(spark, "t")
    ledgers.append(rows, path)
    ledgers.append(rows, path)
    assert ledgers.read(spark, path).count() == 1
    line = wire.encode(rows).first().value
    for where in ("x/.usage/ledger/1.jsonl", "y/z/.usage/ledger/ledger.jsonl", "x/node_modules/m/.usage/ledger/1.jsonl"):
        (tmp_path / where).parent.mkdir(parents=True)
        (tmp_path / where).write_text(line + "\n\n{bad\n")
    assert len(discover(spark, str(tmp_path))) == 2
    found = fleet_lines(spark, str(tmp_path))
    assert sorted((r.repo.rsplit("/", 1)[1], r.corrupt) for r in found.collect()) == [("x", False), ("x", True), ("z", False), ("z", True)]
    both = ledger_lines(spark, str(tmp_path / "x/.usage/ledger"), notes=str(tmp_path / "y/z/.usage/ledger"))
    assert ledgers.latest_rows(both.where("not corrupt")).first().src_order == 1
