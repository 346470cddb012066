"""Commits that a range of a repository's history names, from the table of commit parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watttrail.session import stage

#: Links to first parents that are followed in doubling steps; more are contracted first.
LINKS = 1 << 18
_AT = ["repo", "sha"]


def _numbered(parents: DataFrame, tips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``names(id, repo, sha)`` of all commits, and ``links(id, up, first)`` between their numbers.

    One link of a commit at most, to its first parent, is ``first``.
    """
    every = parents.select(*_AT).union(parents.select("repo", "parent")).union(tips.select(*_AT)).distinct()
    names = stage(every.select(F.monotonically_increasing_id().alias("id"), *_AT), "names")
    ups = names.select(F.col("id").alias("up"), "repo", F.col("sha").alias("parent"))
    links = parents.join(names, _AT).join(ups, ["repo", "parent"]).select("id", "up", "position")
    nth = F.row_number().over(W.partitionBy("id").orderBy("position", "up"))
    return names, stage(links.select("id", "up", ((nth == 1) & (F.col("position") == 0)).alias("first")), "links")


def _contracted(jump: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Levels of the links ``jump(id, up)``, each without about a quarter of the commits before it, and the links left.

    A level has ``gone`` for commits that leave at it, whose parents all stay, and ``skip`` for
    those whose parent leaves; the next level links these to the parent's parent.
    """
    levels: list[DataFrame] = []
    count = jump.count()
    while count > LINKS:
        coin = lambda c, k=len(levels): F.xxhash64(F.col(c), F.lit(k)) % 2 == 0
        marked = jump.withColumn("gone", coin("id") & ~coin("up"))
        above = marked.where("gone").select(F.col("id").alias("up"), F.col("up").alias("upper"))
        level = stage(marked.join(above, "up", "left").select("id", "up", "gone", F.col("upper").isNotNull().alias("skip"), "upper"), "level")
        jump, before = level.where("not gone").select("id", F.coalesce("upper", "up").alias("up")), count
        count = jump.count()
        levels.append(level)
        if count == before:
            break  # links of commits to themselves
    return levels, stage(jump, "jumps")


def _jumps(jump: DataFrame) -> list[DataFrame]:
    """Tables ``(id, up)`` of the ancestor 1, 2, 4, ... links above each commit."""
    jumps, commits = [], jump.count()
    while not jump.isEmpty():
        if 1 << len(jumps) > commits:
            raise ValueError("a commit is an ancestor of itself")
        jumps.append(jump)
        above = jump.select(F.col("id").alias("up"), F.col("up").alias("upper"))
        jump = stage(jump.join(above, "up").select("id", F.col("upper").alias("up")), "jumps")
    return jumps


def _climbed(front: DataFrame, levels: list[DataFrame], jumps: list[DataFrame]) -> DataFrame:
    """``front(label, id)`` with all ancestors by first parents; distinct."""
    left = []
    for level in levels:
        met = stage(front.join(level.where("gone").select("id", "up"), "id", "left"), "met")
        left.append(met.where("up is not null").select("label", "id"))
        front = met.select("label", F.coalesce("up", "id").alias("id")).distinct()
    for jump in jumps:
        front = front.join(jump, "id", "left").select("label", F.explode(F.array_compact(F.array("id", "up"))).alias("id")).distinct()
    found = stage(front, "climbed")
    for level, own in zip(reversed(levels), reversed(left), strict=True):
        passed = found.join(level.where("skip").select("id", "up"), "id").select("label", F.col("up").alias("id"))
        found = found.union(stage(own.union(passed).distinct(), "passed"))
    return found


def reachable(parents: DataFrame, tips: DataFrame) -> DataFrame:
    """Each row of ``tips(label, repo, sha)`` with all commits it reaches, itself included; distinct.

    ``parents`` has ``(repo, sha, position, parent)``, position 0 for the first parent. Commits and
    labels are numbered. Links to first parents are contracted, level by level, until ``LINKS`` are
    left, and those followed in doubling steps, so that all levels together have a few times the
    links, whatever the length of the chains. Then the other parents of what was reached are the
    tips of the next round. There are as many rounds as merges of merged branches lie within each
    other.
    """
    names, links = _numbered(parents, tips)
    levels, jump = _contracted(links.where("first").select("id", "up"))
    jumps = _jumps(jump)
    others = links.where("not first").select("id", "up")
    labels = stage(tips.select("label").distinct().select(F.monotonically_increasing_id().alias("_label"), "label"), "labels")
    own = tips.join(names, _AT).join(labels, "label").select(F.col("_label").alias("label"), "id")
    front = stage(own.distinct(), "tips")
    seen = front.limit(0)
    while not front.isEmpty():
        fresh = stage(_climbed(front, levels, jumps).join(seen, ["label", "id"], "left_anti"), "reached")
        seen = seen.union(fresh)
        merged = fresh.join(others, "id").select("label", F.col("up").alias("id")).distinct()
        front = stage(merged.join(seen, ["label", "id"], "left_anti"), "tips")
    named = seen.join(names, "id").select(F.col("label").alias("_label"), *_AT)
    return named.join(labels, "_label").select("label", *_AT)


def commits_in_ranges(parents: DataFrame, ranges: DataFrame, commits: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """``(name, repo, commit)``, distinct, for ``ranges(name, repo, expr)``.

    An expression is a list of terms with blanks between: ``B`` takes B and its ancestors, ``^A``
    leaves out A and its ancestors, ``A..B`` is ``^A B``, and ``A...B`` takes what one of the two
    reaches and the other does not. An end is a name of ``refs(repo, ref, sha)`` or a full sha of
    ``commits(repo, sha)``; one left empty is ``HEAD``. A range with an end that is neither is
    empty, and so is one whose expression is null.
    """
    terms = ranges.select("name", "repo", F.explode(F.split(F.trim("expr"), r"\s+")).alias("term"))
    cut = lambda k: F.regexp_extract("term", r"^(.*?)(\.{2,3})(.*)$", k)
    dots = cut(2)
    end = lambda side, of: F.struct(F.lit(side).alias("side"), F.coalesce(F.nullif(of, F.lit("")), F.lit("HEAD")).alias("ref"))
    ends = (
        F.when(dots == "...", F.array(end("left", cut(1)), end("right", cut(3))))
        .when(dots == "..", F.array(end("out", cut(1)), end("in", cut(3))))
        .when(F.col("term").startswith("^"), F.array(end("out", F.substring("term", 2, 1 << 20))))
        .otherwise(F.array(end("in", F.col("term"))))
    )
    named = commits.select("repo", F.col("sha").alias("ref"), "sha", F.lit(1).alias("order"))
    if refs is not None:
        named = named.unionByName(refs.select("repo", "ref", "sha", F.lit(0).alias("order")))
    asked = stage(terms.select("name", "repo", F.inline(ends)), "asked")
    named = named.join(asked, ["repo", "ref"], "left_semi").groupBy("repo", "ref").agg(F.min_by("sha", "order").alias("sha"))
    sides = stage(asked.join(named, ["repo", "ref"], "left"), "ends")
    unknown = sides.where("sha is null").select("name", "repo").distinct()
    tips = sides.join(unknown, ["name", "repo"], "left_anti").select(F.struct("name", "side").alias("label"), *_AT)
    has = lambda side: F.coalesce(F.bool_or(F.col("label.side") == side), F.lit(False)).alias(side)
    found = reachable(parents, tips).groupBy(F.col("label.name").alias("name"), "repo", F.col("sha").alias("commit"))
    flags = found.agg(has("in"), has("out"), has("left"), has("right"))
    return flags.where("(`in` or `left` <> `right`) and not `out`").select("name", "repo", "commit")


def session_roots(repos: DataFrame, outermost: bool = False) -> DataFrame:
    """``repos(root, superproject)`` with ``session_root``, where the sessions of a repository work.

    That is the root of the superproject for a submodule and the own root for others (``superproject``
    null). With ``outermost``, superprojects that are submodules themselves are followed to the
    last one, in doubling steps; one that is no row of ``repos`` is the last.
    """
    own = repos.withColumn("session_root", F.coalesce("superproject", "root"))
    if not outermost:
        return own
    steps, rows = 0, own.count()
    while True:
        above = own.select(F.col("root").alias("session_root"), F.col("session_root").alias("_above")).distinct()
        own = stage(own.join(above, "session_root", "left").withColumn("_to", F.coalesce("_above", "session_root")), "roots")
        moved = not own.where("_to <> session_root").isEmpty()
        own = own.select(*repos.columns, F.col("_to").alias("session_root"))
        steps += 1
        if not moved:
            return own
        if 1 << (steps - 1) > rows:
            raise ValueError("a repository is its own superproject")
