"""Lookups, components, windows over records and streams on cases built to be awkward."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from watttrail.operators.attribution import next_boundary
from watttrail.operators.components import connected_components
from watttrail.operators.quality import source_coverage
from watttrail.operators.skew import lookup
from watttrail.operators.turns import carry_forward, compaction_events
from watttrail.session import new_path, shared_dir, stage


def test_lookup_serves_hot_cold_and_missing_keys(spark):
    keys = ["hot"] * 2000 + [f"k{i}" for i in range(500)] + ["absent"] * 3 + [None] * 2
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, row long")
    entries = spark.createDataFrame([("hot", 2000, "H")] + [(f"k{i}", 1, f"v{i}") for i in range(500)], "key string, n long, value string")
    got = {r.row: r.value for r in lookup(rows, entries, "key", "n", 2500, "row").collect()}
    want = {"hot": "H"} | {f"k{i}": f"v{i}" for i in range(500)}
    assert got == {i: want.get(k) for i, k in enumerate(keys)}
    odd = rows.withColumns({"hot": F.lit(1), "cold": F.lit(2), "salt": F.lit(3), "k": F.lit(4), "_hot": F.lit(5)})
    found = lookup(odd, entries, "key", "n", 2500, "row")
    assert found.columns == [*odd.columns, "value"]
    assert {r.row: r.value for r in found.collect()} == got


def test_components_of_paths_stars_and_cycles(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(100, 100 + i) for i in range(1, 40)]
    cycle = [(200 + i, 200 + (i + 1) % 15) for i in range(15)]
    zigzag = [(300 + (i * 7) % 31, 300 + ((i + 1) * 7) % 31) for i in range(30)]
    edges = spark.createDataFrame([*path, *star, *cycle, *zigzag, (500, 500), (1, 0), (-5, 7)], "a long, b long")
    found = {r.node: r.root for r in connected_components(edges).collect()}
    roots = {-5: [-5, *range(61)], 100: range(100, 140), 200: range(200, 215), 300: range(300, 331)}
    assert found == {n: root for root, nodes in roots.items() for n in nodes}
    assert connected_components(edges.where("a = 500")).collect() == []


def test_next_boundary_in_buckets_equals_plain_search(spark):
    start = datetime(2026, 1, 1)
    turns = [("r" if i % 3 else "hot", i, start + timedelta(hours=7 * i)) for i in range(60)]
    marks = [("r", f"c{i:02}", start + timedelta(hours=31 * i)) for i in range(10)] + [("hot", "only", start + timedelta(days=9))]
    got = next_boundary(
        spark.createDataFrame(turns, "repo string, id int, ts timestamp"), spark.createDataFrame(marks, "repo string, sha string, commit_ts timestamp"), ["repo"]
    )
    want = {i: min(((t, s) for r, s, t in marks if r == repo and t >= ts), default=(None, None))[1] for repo, i, ts in turns}
    assert {r.id: r.sha for r in got.collect()} == want
    hourly = next_boundary(
        spark.createDataFrame(turns, "repo string, id int, ts timestamp"), spark.createDataFrame(marks, "repo string, sha string, commit_ts timestamp"), ["repo"], "hour"
    )
    assert {r.id: r.sha for r in hourly.collect()} == want


def test_carry_forward_and_compactions_without_usage(spark):
    rows = spark.createDataFrame([("f", 1, None), ("f", 2, "a"), ("f", 3, None), ("g", 1, None)], "path string, line_no int, model string")
    got = rows.select("path", "line_no", carry_forward(F.col("model"), ["path"], ["line_no"]).alias("m")).orderBy("path", "line_no").collect()
    assert [r.m for r in got] == [None, "a", "a", None]
    records = spark.createDataFrame([("f", 1, True, None, None, None)], "path string, n int, is_boundary boolean, context long, model string, summary string")
    assert [tuple(r) for r in compaction_events(records, ["path"], "n").collect()] == [("f", 1, "?", 0, 0)]


def test_coverage_lists_every_agent(spark):
    agents = spark.createDataFrame([("a",), ("b",)], "agent string")
    repos = spark.createDataFrame([("r",), ("q",)], "repo string")
    found = spark.createDataFrame([("r", "a", "s1"), ("r", "a", "s2")], "repo string, agent string, session_id string")
    got = sorted(tuple(r) for r in source_coverage(agents, repos, found).collect())
    assert got == [("q", "a", 0), ("q", "b", 0), ("r", "a", 2), ("r", "b", 0)]


def test_staged_tables_are_fixed_and_shared(spark):
    made = stage(spark.range(10).select(F.rand().alias("x")), "fixed")
    assert made.collect() == made.collect()
    assert new_path(spark, "a") != new_path(spark, "a") and new_path(spark, "a").startswith(shared_dir(spark))


def test_next_boundary_of_one_busy_repository_is_fast(spark):
    turns = spark.range(400_000).selectExpr("'r' repo", "id", "timestamp_micros(1767225600000000 + id * 200000) ts")
    marks = spark.range(0, 400_000, 100_000).selectExpr("'r' repo", "concat('c', id) sha", "timestamp_micros(1767225600000000 + id * 200000) commit_ts")
    found = next_boundary(turns, marks, ["repo"], "day").groupBy("sha").count().collect()
    assert {r.sha: r["count"] for r in found} == {"c0": 1, "c100000": 100_000, "c200000": 100_000, "c300000": 100_000, None: 99_999}


def test_directories_of_commit_commands(spark):
    from watttrail.functions.text import commit_directory, is_commit_command

    cases = {
        "git commit": (True, "/home/u/w"),
        "cd ~/x && git commit": (True, "/home/u/x"),
        "git -C ~ commit": (True, "/home/u"),
        "cd a && cd b && git -C c -c k='v w' commit -m 'x; y'": (True, "/home/u/w/a/b/c"),
        "git status; cd /z; git commit": (True, "/z"),
        "git commit; cd /z": (True, "/home/u/w"),
        "sudo git commit": (True, "/home/u/w"),
        "git commit-tree x": (False, "/home/u/w"),
        'git log --grep "git commit"': (False, "/home/u/w"),
        "echo don't && echo can't && git commit -m 'x'": (True, "/home/u/w"),
        "bash -lc 'cd a && git commit'; git status": (True, "/home/u/w/a"),
        "bash -c 'cd a' && git commit": (True, "/home/u/w"),
        'sudo sh -c "eval \'git -C b commit\'"': (True, "/home/u/w/b"),
        "bash commit.sh -c 'git commit'": (False, "/home/u/w"),
        "echo " + 'a"b"' * 20_000 + " && git commit": (True, "/home/u/w"),
        "git -C /r commit --dry-run": (False, "/r"),
        "": (False, "/home/u/w"),
    }
    rows = spark.createDataFrame([(c,) for c in cases], "c string")
    got = rows.select("c", is_commit_command(F.col("c")).alias("made"), commit_directory(F.col("c"), F.lit("/home/u/w")).alias("at")).collect()
    assert {r.c: (r.made, r.at) for r in got} == cases
    away = rows.limit(1).select(commit_directory(F.lit("git -C ~/x commit"), F.lit("/srv")).alias("at"), is_commit_command(F.lit(None).cast("string")).alias("made"))
    assert tuple(away.first()) == ("/srv/~/x", False)


def test_meet_is_an_inner_join_with_hot_keys(spark):
    from watttrail.operators.skew import lookup, meet

    rows = spark.range(4000).selectExpr("if(id % 2 = 0, 7, id) key", "id row").union(spark.sql("select cast(null as bigint), -1L"))
    entries = spark.sql("select * from values (7L, 2000L, 'hot'), (9L, 1L, 'cold'), (-5L, 1L, 'none') e(key, n, value)")
    want = sorted((r.key, r.row, r.value) for r in lookup(rows, entries, "key", "n", 2002, "row").where("value is not null").collect())
    assert sorted(map(tuple, meet(rows, entries, "key", "n", 2002).select("key", "row", "value").collect())) == want
    assert len(want) == 2002
