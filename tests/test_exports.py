from pathlib import Path

import pytest

from watttrail.operators import export
from watttrail.sources import exports


def read(path):
    return "".join(p.read_text() for p in sorted(Path(path).glob("part-*")))


def test_reports_are_the_same_bytes(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2, None), ("a", 1, "x,y")], "key string, turns long, models string")
    want = {"json": '{"key":"a","turns":1,"models":"x,y"}\n{"key":"b","turns":2,"models":null}\n', "tsv": "key\tturns\tmodels\na\t1\tx,y\n"}
    for form, start in want.items():
        export.write_report(rows, f"{tmp_path}/{form}", form)
        first = read(tmp_path / form)
        export.write_report(rows.repartition(3), f"{tmp_path}/{form}", form)
        assert read(tmp_path / form) == first and first.startswith(start)
    export.write_totals(rows.limit(1), f"{tmp_path}/t")
    assert read(tmp_path / "t").startswith('{"key"')
    with pytest.raises(ValueError, match="no such form"):
        export.write_report(rows, f"{tmp_path}/x", "xml")


def test_exports(spark, tmp_path):
    (tmp_path / "commits.csv").write_text("/w/r,abc,2026-07-01T12:00:00+02:00\n/w/r,def,\n")
    got = exports.commits(spark, f"{tmp_path}/commits.csv").selectExpr("sha", "unix_seconds(commit_ts) s", "commit_ts_raw").collect()
    assert [tuple(r) for r in got] == [("abc", 1782900000, "2026-07-01T12:00:00+02:00"), ("def", None, None)]
    log = [
        '{"session_id":"s","repo":"r","ts_hi":"2026-01-01T00:00:00Z"}',
        '{"session_id":"s","repo":"r","ts_hi":"2026-01-02T00:00:00Z"}',
        '{"session_id":"s","repo":"q"}',
        "broken",
    ]
    (tmp_path / "claims.jsonl").write_text("\n".join(log))
    claimed = exports.claims(spark, f"{tmp_path}/claims.jsonl")
    assert [(r.repo, r.ts_hi.day) for r in claimed.collect()] == [("r", 2)]
    export.compact_claims(claimed.union(claimed), f"{tmp_path}/compact")
    assert spark.read.parquet(f"{tmp_path}/compact").count() == 1
    (tmp_path / "calls.jsonl").write_text('{"session_id":"s","cwd":"/w","tool_input":{"command":"git commit"}}\n')
    assert [r.command for r in exports.tool_calls(spark, f"{tmp_path}/calls.jsonl").collect()] == ["git commit"]
    assert exports.scenarios(spark).count() == 4
    lines = spark.createDataFrame([("r", str(i)) for i in range(12)], "repo string, value string").coalesce(1)
    export.write_shards(lines, f"{tmp_path}/shards", rows=5)
    assert len(list((tmp_path / "shards" / "repo=r").glob("part-*"))) == 3


def test_claims_merge_with_what_is_there(spark, tmp_path):
    path = f"{tmp_path}/claims"
    for hour in (3, 5, 4):
        rows = spark.createDataFrame([("s", "r", f"2026-01-01 0{hour}:00:00"), (f"s{hour}", "r", "2026-01-01 00:00:00")], "session_id string, repo string, t string")
        export.compact_claims(rows.selectExpr("session_id", "repo", "cast(t as timestamp) ts_hi"), path)
    export.compact_claims(export.read_claims(spark, path), path)
    got = {r.session_id: r.ts_hi.hour for r in export.read_claims(spark, path).collect()}
    assert got == {"s": 5, "s3": 0, "s4": 0, "s5": 0}
    assert len(list(Path(path).glob("version=*"))) == 2


def test_shards_are_bounded_in_bytes(spark, tmp_path):
    lines = spark.range(2000).selectExpr("if(id < 1900, 'hot', 'cold') repo", "repeat(cast(id as string), 30) value")
    export.write_shards(lines, f"{tmp_path}/shards", max_bytes=2000)
    sizes = [p.stat().st_size for p in Path(tmp_path, "shards").rglob("part-*")]
    assert max(sizes) <= 2000 and len(sizes) > 60
    assert spark.read.text(f"{tmp_path}/shards").count() == 2000


def test_totals_document(spark, tmp_path):
    import json

    kind = "map<string, struct<input: long, cache_write: long, cache_read: long, output: long>>"
    rows = spark.sql(f"""select * from values
      ('measured', 'c1', 'codex', null, 3L, 10L, 1L, 2L, 4L, 13L, 1L, 0L, 1.25D, null, null, timestamp'2026-01-01 00:00:00'),
      ('measured', 'c1', '', 'impl', 1L, 1L, 0L, 0L, 1L, 1L, 0L, 2L, null, null, null, timestamp'2026-01-03 00:00:00'),
      ('measured', 'pending@2026-01-01', 'codex', '', 1L, 5L, 0L, 0L, 5L, 5L, 0L, 0L, 2.0D, null, null, timestamp'2026-01-02 00:00:00'),
      ('compaction-estimate', 'c9', 'codex', null, null, null, null, null, null, null, null, null, null, 70L, 8L, null)
      as t(kind, commit, agent, activity, turns, input, cache_write, cache_read, output, billable_input, web_search, web_fetch, wall_clock_s,
           peak_context_tokens, summary_chars, recorded_at)""").selectExpr(
        "*", f"cast(if(kind = 'measured', map('z', named_struct('input', input, 'cache_write', cache_write, 'cache_read', cache_read, 'output', output), 'a', named_struct('input', 1L, 'cache_write', 0L, 'cache_read', 0L, 'output', 0L)), null) as {kind}) by_model"
    )
    export.write_totals_document(rows, f"{tmp_path}/a")
    export.write_totals_document(rows.repartition(3), f"{tmp_path}/b")
    line = read(tmp_path / "a")
    assert line == read(tmp_path / "b")
    got = json.loads(line)
    assert list(got) == sorted(got)
    assert got["tokens"] == {"billable_input": 19, "cache_read": 2, "cache_write": 1, "input": 16, "output": 10}
    assert list(got["by_model"]) == ["a", "z"] and got["by_model"]["a"]["billable_input"] == 3 and got["by_model"]["z"]["billable_input"] == 19
    assert {k: v["output"] for k, v in got["by_activity"].items()} == {"impl": 1, "unlabeled": 9}
    assert {k: v["output"] for k, v in got["by_agent"].items()} == {"codex": 9, "unknown": 1}
    assert got["compaction_signals"] == {"events": 1, "peak_context_tokens": 70, "summary_chars": 8}
    assert (got["commits_accounted"], got["ledger_rows"], got["turns"], got["time"]["wall_clock_s"]) == (1, 4, 5, 3.3)
    assert got["server_tool_calls"] == {"web_fetch": 2, "web_search": 1} and got["through"] == "2026-01-03T00:00:00.000Z"
    export.write_totals_document(rows.limit(0), f"{tmp_path}/none")
    none = json.loads(read(tmp_path / "none"))
    assert none["by_model"] == {} and none["through"] is None and none["turns"] == 0
