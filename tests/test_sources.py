"""Session logs of three agents as written by hand, with figures worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from watttrail.operators.turns import dedup_turns
from watttrail.sources import agents
from watttrail.sources.lines import corrupt_lines, read_lines


def at(seconds):
    return f"2026-07-01T12:00:{seconds:06.3f}Z"


def claude_turn(seconds, key, output, fresh, written, read, web=0, **more):
    usage = {"input_tokens": fresh, "cache_creation_input_tokens": written, "cache_read_input_tokens": read, "output_tokens": output}
    if web:
        usage["server_tool_use"] = {"web_search_requests": web}
    return {"type": "assistant", "timestamp": at(seconds), "message": {"id": key, "model": "big", "usage": usage}} | more


CLAUDE = [
    claude_turn(0, "m1", 30, 100, 50, 200, 1, cwd="/w/repo/sub"),
    claude_turn(1, "m1", 30, 100, 50, 200, 1),
    claude_turn(2, "m2", 40, 10, 0, 300),
    {"type": "system", "subtype": "compact_boundary", "timestamp": at(3)},
    {"type": "user", "isCompactSummary": True, "timestamp": at(3.5), "message": {"content": [{"type": "text", "text": "s" * 100}, {"type": "x"}, {"type": "text", "text": "t" * 23}]}},
    claude_turn(4, "m3", 25, 5, 0, 400),
]


def write(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")


def test_claude_session(spark, tmp_path):
    write(tmp_path / "abc.jsonl", CLAUDE)
    turns = dedup_turns(agents.claude_turns(spark, str(tmp_path)))
    total = turns.agg(*(F.sum(c).alias(c) for c in ("output", "input", "cache_write", "cache_read", "web_search")), F.count("*").alias("n"), F.min("session_id").alias("sid"), F.min("ts").alias("lo")).first()
    assert total.asDict() | {"lo": str(total.lo)} == {
        "output": 95, "input": 115, "cache_write": 50, "cache_read": 900, "web_search": 1, "n": 3, "sid": "abc", "lo": "2026-07-01 12:00:01",
    }
    lines = read_lines(spark, str(tmp_path))
    found = agents.claude_compactions(lines).collect()
    assert [(r.model, r.peak_context_tokens, r.summary_chars) for r in found] == [("big", 350, 123)]
    assert [(r.session_id, r.cwd) for r in agents.claude_sessions(lines).collect()] == [("abc", "/w/repo/sub")]


def test_summary_may_be_plain_text_and_window_ends(spark, tmp_path):
    late = [{"type": "user", "n": i} for i in range(7)] + [{"isCompactSummary": True, "message": {"content": "late"}}]
    near = [{"type": "user", "n": i} for i in range(6)] + [{"isCompactSummary": True, "message": {"content": "near"}}]
    write(tmp_path / "late.jsonl", [CLAUDE[3], *late])
    write(tmp_path / "near.jsonl", [CLAUDE[3], "broken", *near])
    found = {r.session_id: r.summary_chars for r in agents.claude_compactions(read_lines(spark, str(tmp_path))).collect()}
    assert found == {"late": 0, "near": 4}


def test_sub_agents_belong_to_their_session(spark, tmp_path):
    write(tmp_path / "abc.jsonl", CLAUDE)
    write(tmp_path / "abc" / "subagents" / "x.jsonl", [claude_turn(5, "sub_1", 50, 10, 20, 0) | {"isSidechain": True}])
    turns = dedup_turns(agents.claude_turns(spark, str(tmp_path)))
    assert turns.groupBy("session_id").agg(F.sum("output")).collect() == [("abc", 145)]


def test_a_last_record_without_time_removes_its_turn(spark, tmp_path):
    write(tmp_path / "abc.jsonl", [CLAUDE[0], CLAUDE[1] | {"timestamp": None}, CLAUDE[2]])
    assert [r.msg_id for r in dedup_turns(agents.claude_turns(spark, str(tmp_path))).collect()] == ["m2"]


def test_bad_lines_and_bad_figures(spark, tmp_path):
    odd = claude_turn(9, "m9", "many", None, 1, 2)
    write(tmp_path / "abc.jsonl", [CLAUDE[0], "{torn", "[1, 2]", "", odd, {"message": "text"}, {"message": {"usage": {}}}])
    rows = {r.msg_id: (r.output, r.input, r.cache_write) for r in agents.claude_turns(spark, str(tmp_path)).collect()}
    assert rows == {"m1": (30, 100, 50), "m9": (0, 0, 1)}
    assert [(r.readable, r.corrupt) for r in corrupt_lines(read_lines(spark, str(tmp_path))).collect()] == [(4, 2)]


def test_codex_session(spark, tmp_path):
    def used(seconds, total, cached, out):
        usage = {"input_tokens": total, "cached_input_tokens": cached, "output_tokens": out}
        return {"timestamp": at(seconds), "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": usage}}}

    context = {"timestamp": at(1), "type": "turn_context", "payload": {"model": "gpt-5.5", "cwd": "/w", "workspace_roots": ["/w", "/v"]}}
    write(tmp_path / "rollout-1.jsonl", [used(0, 50, 80, 1), context, used(2, 1000, 300, 40), used(3, 900, 900, 20)])
    turns = dedup_turns(agents.codex_turns(spark, str(tmp_path)))
    sums = {r.model: tuple(r)[1:] for r in turns.groupBy("model").agg(F.sum("input"), F.sum("cache_read"), F.sum("cache_write"), F.sum("output")).collect()}
    assert sums == {"?": (0, 80, 0, 1), "gpt-5.5": (700, 1200, 0, 60)}
    session = agents.codex_sessions(read_lines(spark, str(tmp_path))).first()
    assert (session.session_id, session.cwd, sorted(session.workspace_roots)) == ("rollout-1", "/w", ["/v", "/w"])


def test_opencode_messages(spark):
    def data(**more):
        return json.dumps({"role": "assistant", "modelID": "m", "time": {"created": 1000, "completed": 2000}} | more)

    rows = [
        ("1", "s", 5, data(tokens={"input": 1000, "output": 40, "reasoning": 5, "cache": {"read": 0, "write": 0}})),
        ("2", "s", 5, data(tokens={"input": 500, "output": 10, "cache": {"read": 200, "write": 0}}, time={})),
        ("3", "s", 5, data(tokens={"input": 0, "output": 0})),
        ("4", "s", 5, data(role="user", tokens={"input": 9})),
        ("5", "s", 5, "broken"),
    ]
    turns = agents.opencode_records(spark.createDataFrame(rows, "id string, session_id string, time_created long, data string"))
    got = turns.selectExpr("msg_id", "input", "output", "cache_read", "unix_millis(ts) ms").orderBy("msg_id").collect()
    assert [tuple(r) for r in got] == [("1", 1000, 45, 0, 2000), ("2", 500, 10, 200, 5)]


def test_unknown_source():
    with pytest.raises(ValueError, match="no such source"):
        agents.source("none")


def test_latest_transcript(spark):
    rows = spark.createDataFrame([("r", 1, "a", "s1"), ("r", 2, "b", "s2"), ("q", 1, "c", "s3")], "repo string, mtime int, path string, session_id string")
    assert sorted(tuple(r) for r in agents.latest_transcript(rows, ["repo"]).collect()) == [("q", "s3", "c"), ("r", "s2", "b")]


def test_line_order_across_splits(spark, tmp_path):
    (tmp_path / "long.txt").write_text("".join(f"{i:099}\n" for i in range(100_000)))
    (tmp_path / "short.txt").write_text("a\n\nb\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500000")
    try:
        lines = read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 4
        rows = lines.where("path like '%long%'").orderBy("line_no").select("value", "line_no").collect()
        assert [int(r.value) for r in rows] == list(range(100_000))
        assert len({r.line_no for r in rows}) == 100_000
        assert [r.value for r in lines.where("path like '%short%'").orderBy("line_no").collect()] == ["a", "b"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_discovery_at_any_depth(spark, tmp_path):
    from watttrail.sources.ledger_files import discover, fleet_lines

    deep = tmp_path / "a/b/c/d/e/f/r1"
    write(deep / ".usage/ledger/x.jsonl", ['{"v":3,"c":"c1","sid":"s","n":1,"t":[1,2,3,4]}'])
    write(tmp_path / "r2/.usage/notes/n.jsonl", ['{"v":3,"c":"c2","sid":"s","n":1,"t":[1,2,3,4]}'])
    write(tmp_path / "r3/node_modules/p/.usage/ledger/x.jsonl", ["{}"])
    found = discover(spark, str(tmp_path))
    assert [len(v) for v in found.values()] == [1, 1]
    rows = fleet_lines(spark, str(tmp_path)).select("repo", "commit", "src_order").orderBy("commit").collect()
    assert [(r.repo.rsplit("/", 1)[1], r.commit, r.src_order) for r in rows] == [("r1", "c1", 0), ("r2", "c2", 1)]
    with pytest.raises(ValueError, match="no ledger"):
        fleet_lines(spark, str(tmp_path / "r3"))


def test_bundled_logs_have_few_files_and_keep_order(spark):
    from watttrail.plans import source_queries as logs
    from watttrail.session import new_path

    rows = spark.range(3000).selectExpr("concat('s', id % 500) sid", "id ts", "concat('{\"n\": ', id, ', \"t\": \"a\\\\tb\"}') value")
    path = new_path(spark, "bundled")
    logs._write(rows, path, ["ts"])
    lines = logs._read(spark, path)
    assert lines.select("path").distinct().count() <= 8  # and not a file or more for each of 500 sessions
    assert lines.where("value not like '{%}'").isEmpty()
    found = {}
    for r in lines.orderBy("session_id", "file_order", "path", "line_no").collect():
        found.setdefault(r.session_id, []).append(int(r.value.split(": ")[1].split(",")[0]))
    assert found == {f"s{k}": list(range(k, 3000, 500)) for k in range(500)}
