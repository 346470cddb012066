"""Which repository a session belongs to, and which commit each turn belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watttrail.functions.text import project_directory

PENDING = "pending@"


def next_boundary(turns: DataFrame, boundaries: DataFrame, by: list[str], bucket: str = "hour", times: DataFrame | None = None) -> DataFrame:
    """Left as-of join: each turn with the first boundary of its ``by`` group at or after ``ts``.

    ``boundaries`` has ``by``, ``sha`` and ``commit_ts``; of equal times the smallest sha counts.
    The search runs inside time buckets, so that one busy repository does not end up in one task.
    A turn whose bucket has no later boundary takes the first of the next bucket that has one,
    from a table of one row per group and bucket. Its buckets come from ``times``, a table with
    ``by`` and ``ts`` that has at least those of ``turns`` and is cheaper to read a second time.
    """
    marks = boundaries.groupBy(*by, "commit_ts").agg(F.min("sha").alias("sha"))
    at = F.struct("commit_ts", "sha")
    mark_rows = marks.select(*by, F.col("commit_ts").alias("_at"), F.lit(1).alias("_mark"), at.alias("_next"))
    own = [c for c in turns.columns if c not in (*by, "ts")] or ["ts"]  # the others pass the exchange once
    turn_rows = turns.select(*by, F.col("ts").alias("_at"), F.lit(0).alias("_mark"), F.struct(*own).alias("_turn"))
    rows = turn_rows.unionByName(mark_rows, allowMissingColumns=True).withColumn("_bucket", F.date_trunc(bucket, "_at"))
    # latest first, so that a frame that only grows holds what comes later; at one time a
    # boundary comes before a turn, which belongs to it
    later = W.partitionBy(*by, "_bucket").orderBy(F.desc("_at"), F.desc("_mark")).rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("_found", F.last("_next", ignorenulls=True).over(later)).where("_mark = 0")
    seen = (turns if times is None else times).select(*by, F.col("ts").alias("_at"))
    seen = seen.unionByName(mark_rows.drop("_mark"), allowMissingColumns=True).withColumn("_bucket", F.date_trunc(bucket, "_at"))
    buckets = seen.groupBy(*by, "_bucket").agg(F.min("_next").alias("_first"))
    after = W.partitionBy(*by).orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    following = buckets.select(*by, "_bucket", F.last("_first", ignorenulls=True).over(after).alias("_following"))
    joined = found.join(following, [*by, "_bucket"], "left").withColumn("_hit", F.coalesce("_found", "_following"))
    place = {"ts": "_at", **dict.fromkeys(by)}
    shown = [F.col(place[c] or c).alias(c) if c in place else F.col(f"_turn.`{c}`") for c in turns.columns]
    return joined.select(*shown, "_hit.sha", "_hit.commit_ts")


def commit_label(sweep_date: Column) -> Column:
    """The commit a turn is booked under: its sha, or the pending label of the sweep's date."""
    return F.coalesce("sha", F.concat(F.lit(PENDING), F.date_format(sweep_date, "yyyy-MM-dd")))


def watermarks(ledger: DataFrame) -> DataFrame:
    """Latest recorded turn of each session in each repository, over all its rows."""
    return ledger.groupBy("repo", "session_id").agg(F.max("ts_hi").alias("mark"))


def after_watermark(turns: DataFrame, ledger: DataFrame) -> DataFrame:
    """Turns later than their session's watermark in their repository."""
    marked = turns.join(watermarks(ledger), ["repo", "session_id"], "left")
    return marked.where("mark is null or ts > mark").drop("mark")


def new_compactions(compactions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Compactions whose boundary is not in the ledger yet."""
    keys = ["repo", "session_id", "boundary_ts"]
    return compactions.join(ledger.where("boundary_ts is not null").select(*keys).distinct(), keys, "left_anti")


def compactions_of_commits(compactions: DataFrame, boundaries: DataFrame, ledger: DataFrame) -> DataFrame:
    """Compactions not yet in the ledger, each with the commit that books it.

    A commit takes those of its repository after the session's watermark and up to its own time,
    ``(lo, hi]``; what lies after the last commit has no ``sha`` and is left to a sweep.
    """
    fresh = new_compactions(compactions, ledger).join(watermarks(ledger), ["repo", "session_id"], "left")
    fresh = fresh.where("mark is null or boundary_ts > mark").drop("mark").withColumn("ts", F.col("boundary_ts"))
    kept = [c for c in fresh.columns if c not in ("commit", "commit_ts", "ts")]
    return next_boundary(fresh.select(*kept, "ts"), boundaries, ["repo"]).drop("ts")


def not_recorded(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows whose session and commit have no measured row in the ledger."""
    keys = ["repo", "session_id", "commit"]
    return rows.join(ledger.where("kind = 'measured'").select(*keys).distinct(), keys, "left_anti")


def path_and_ancestors(path: Column) -> Column:
    """A path and all directories above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def sessions_in_repos(sessions: DataFrame, repos: DataFrame, cwd: str = "cwd", root: str = "root") -> DataFrame:
    """Sessions with each repository whose root is their directory or above it.

    Directories are exploded into their ancestors, which turns the prefix test into an equi-join
    and never takes ``/src/repo10`` for a part of ``/src/repo1``.
    """
    ups = sessions.withColumn(root, F.explode(path_and_ancestors(F.rtrim(F.col(cwd), F.lit("/")))))
    return ups.join(repos, root)


def filed_sessions_in_repos(sessions: DataFrame, repos: DataFrame, cwd: str = "cwd", root: str = "root") -> DataFrame:
    """Sessions with their repositories, by working directory or by the folder they are filed under.

    ``sessions`` has ``project``, the encoded name of that folder. A session filed under the
    encoded root itself belongs to the repository even if it names no directory; any other needs
    a directory below the root, as several paths share one encoded name.
    """
    named = repos.withColumn("project", project_directory(F.col(root)))
    return sessions_in_repos(sessions, repos, cwd, root).unionByName(sessions.join(named, "project")).distinct()


def workspaces_in_repos(sessions: DataFrame, repos: DataFrame, roots: str = "workspace_roots", root: str = "root") -> DataFrame:
    """Sessions with each repository that equals one of their workspace roots or lies below one."""
    opened = sessions.withColumn("_workspace", F.explode(roots))
    ups = repos.withColumn("_workspace", F.explode(path_and_ancestors(F.col(root))))
    return opened.join(ups, "_workspace").drop("_workspace").distinct()


def claims(ledger: DataFrame) -> DataFrame:
    """Latest turn that each repository has claimed of each session."""
    return ledger.where("ts_hi is not null").groupBy("session_id", "repo").agg(F.max("ts_hi").alias("ts_hi"))


def claim_ceilings(claimed: DataFrame) -> DataFrame:
    """For each session and repository, the latest claim of any other repository.

    The two largest claims of a session suffice: the ceiling is the largest, or the second for
    the repository that holds the largest.
    """
    best = F.max(F.struct("ts_hi", "repo")).alias("top")
    tops = claimed.groupBy("session_id").agg(best)
    rest = claimed.join(tops, "session_id").where("repo <> top.repo").groupBy("session_id").agg(F.max("ts_hi").alias("second"))
    both = claimed.select("session_id", "repo").join(tops, "session_id").join(rest, "session_id", "left")
    ceiling = F.when(F.col("repo") == F.col("top.repo"), F.col("second")).otherwise(F.col("top.ts_hi"))
    return both.select("session_id", "repo", ceiling.alias("ceiling"))


def pending_sweep(turns: DataFrame, ledger: DataFrame) -> DataFrame:
    """Turns that a sweep books as pending: past the own watermark and the claims of others."""
    ceilings = claim_ceilings(claims(ledger))
    fresh = after_watermark(turns, ledger)
    others = claims(ledger).groupBy("session_id").agg(F.max("ts_hi").alias("_any"))
    held = fresh.join(ceilings, ["session_id", "repo"], "left").join(others, "session_id", "left")
    own = ledger.select("session_id", "repo").distinct().withColumn("_known", F.lit(True))
    held = held.join(own, ["session_id", "repo"], "left")
    # a repository without claims of its own is bound by all claims
    bound = F.when(F.col("_known"), F.col("ceiling")).otherwise(F.col("_any"))
    return held.where(bound.isNull() | (F.col("ts") > bound)).drop("ceiling", "_any", "_known")


def in_commit_range(ledger: DataFrame, commits: DataFrame) -> DataFrame:
    """Ledger rows whose commit is in ``commits(commit)``."""
    return ledger.join(commits.select("commit"), "commit", "left_semi")


def backfill(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Turns of explicitly named sessions, each with the first named commit at or after it."""
    named = pairs.select("session_id").distinct()
    return next_boundary(turns.join(named, "session_id", "left_semi"), pairs, ["session_id"])


def commit_events(calls: DataFrame, is_commit: Column, directory: Column, transcripts: DataFrame | None = None) -> DataFrame:
    """Commits that sessions made themselves, from a log of tool calls: session, directory, time.

    With ``transcripts(transcript_path)``, calls whose transcript is not there are left out.
    """
    made = calls.where(is_commit).withColumn("directory", directory)
    return made if transcripts is None else made.join(transcripts.select("transcript_path"), "transcript_path", "left_semi")
