"""Ranges of histories against a plain walk, and superprojects."""

import random

import pytest

from watttrail.operators import history
from watttrail.operators.history import commits_in_ranges, session_roots


def above(parents, tip):
    seen, todo = set(), [tip]
    while todo:
        at = todo.pop()
        if at not in seen:
            seen.add(at)
            todo += parents[at]
    return seen


def test_ranges_of_a_history_with_merges(spark):
    dice = random.Random(3)
    parents = {0: [], 60: []}  # two roots
    for n in range(1, 120):
        if n != 60:
            parents[n] = list(dict.fromkeys([max(n - dice.choice([1, 1, 1, 5]), 0), *(dice.randrange(n) for _ in range(dice.choice([0, 0, 0, 1, 2])))]))
    rows = [("r", str(n), i, str(p)) for n, ps in parents.items() for i, p in enumerate(ps)]
    edges = spark.createDataFrame(rows, "repo string, sha string, position int, parent string")
    commits = spark.createDataFrame([("r", str(n)) for n in parents] + [("other", "7")], "repo string, sha string")
    refs = spark.createDataFrame([("r", "HEAD", "119"), ("r", "v1", "50")], "repo string, ref string, sha string")
    up = {n: above(parents, n) for n in parents}
    want = {
        "80": up[80], "v1..": up[119] - up[50], "..v1": up[50] - up[119], "70...90": up[70] ^ up[90], "0..0": set(),
        "100 90 ^40 ^30": (up[100] | up[90]) - up[40] - up[30], "70..90 80": (up[90] | up[80]) - up[70], "80..nowhere": set(),
    }
    ranges = spark.createDataFrame([(e, "r", e) for e in want] + [("null", "r", None), ("far", "other", "7"), ("gone", "x", "7")], "name string, repo string, expr string")
    got = {}
    for r in commits_in_ranges(edges, ranges, commits, refs).collect():
        got.setdefault(r.name, []).append(int(r.commit))
    assert got.pop("far") == [7]
    assert {n: sorted(c) for n, c in got.items()} == {e: sorted(c) for e, c in want.items() if c}


def test_long_histories_and_cycles(spark):
    edges = spark.range(1, 5000).selectExpr("'r' repo", "cast(id as string) sha", "0 position", "cast(id - 1 as string) parent")
    commits = spark.range(5000).selectExpr("'r' repo", "cast(id as string) sha")
    ranges = spark.createDataFrame([("a", "r", "10..4999")], "name string, repo string, expr string")
    assert commits_in_ranges(edges, ranges, commits).count() == 4989
    ring = edges.union(spark.createDataFrame([("r", "0", 0, "4999")], edges.schema))
    with pytest.raises(ValueError, match="ancestor of itself"):
        commits_in_ranges(ring, ranges, commits)


def test_superprojects(spark):
    rows = [("/a", None), ("/a/b", "/a"), ("/a/b/c", "/a/b"), ("/x/y", "/x"), ("/p", "/q"), ("/q", "/r"), ("/r", "/s"), ("/s", None)]
    repos = spark.createDataFrame(rows, "root string, superproject string")
    direct = {r.root: r.session_root for r in session_roots(repos).collect()}
    assert direct["/a/b/c"] == "/a/b" and direct["/x/y"] == "/x" and direct["/a"] == "/a"
    last = {r.root: r.session_root for r in session_roots(repos, outermost=True).collect()}
    assert last == {"/a": "/a", "/a/b": "/a", "/a/b/c": "/a", "/x/y": "/x", "/p": "/s", "/q": "/s", "/r": "/s", "/s": "/s"}
    ring = spark.createDataFrame([("/a", "/b"), ("/b", "/c"), ("/c", "/a")], "root string, superproject string")
    with pytest.raises(ValueError, match="own superproject"):
        session_roots(ring, outermost=True)


def test_long_tables_of_links_are_contracted(spark, monkeypatch):
    dice = random.Random(5)
    parents = {0: []}
    for n in range(1, 400):
        parents[n] = list(dict.fromkeys([max(n - dice.choice([1, 1, 1, 4]), 0), *(dice.randrange(n) for _ in range(dice.choice([0, 0, 0, 1])))]))
    rows = [("r", str(n), i, str(p)) for n, ps in parents.items() for i, p in enumerate(ps)]
    edges = spark.createDataFrame(rows, "repo string, sha string, position int, parent string")
    monkeypatch.setattr(history, "LINKS", 40)
    levels, left = history._contracted(edges.where("position = 0").selectExpr("cast(sha as long) id", "cast(parent as long) up"))
    sizes = [level.count() for level in levels]
    assert len(sizes) > 3 and left.count() <= 40 and sum(sizes) < 6 * 399
    tips = spark.createDataFrame([("a", "r", "399"), ("a", "r", "200"), ("b", "r", "250"), ("c", "r", "0")], "label string, repo string, sha string")
    got = sorted((r.label, int(r.sha)) for r in history.reachable(edges, tips).collect())
    want = {"a": above(parents, 399) | above(parents, 200), "b": above(parents, 250), "c": {0}}
    assert got == sorted((k, n) for k, ns in want.items() for n in ns)
    ring = edges.union(spark.createDataFrame([("r", "0", 0, "399")], edges.schema))
    with pytest.raises(ValueError, match="ancestor of itself"):
        history.reachable(ring, tips)
