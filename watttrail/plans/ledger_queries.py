"""Registered queries over turns, attribution, the ledger and its reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watttrail.functions import wire
from watttrail.functions.text import commit_directory, is_commit_command, project_directory
from watttrail.operators import attribution as at
from watttrail.operators import ledger as ledgers
from watttrail.operators import export, history, quality, report
from watttrail.operators import turns as ops
from watttrail.plans import derive
from watttrail.session import new_path, stage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SECONDS = "yyyy-MM-dd HH:mm:ss.SSS"


def query(sql: str | None = None, prelude: bool = True) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (derive.SQL if prelude else "") + sql
        return f

    return add


def shown(ts: str) -> Column:
    """A time as text, alike in both engines."""
    return F.date_format(ts, SECONDS).alias(ts)


def sql_shown(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%g') as {ts}"


_TURN = "agent, session_id, msg_id, model, input, cache_write, cache_read, output, web_search, web_fetch"


@query(f"select {_TURN}, {sql_shown('ts')} from turns")
def win_turn_dedup(spark, sf_dir):
    return derive.turns(spark, sf_dir).selectExpr(*_TURN.split(", "), "ts").withColumn("ts", shown("ts"))


@query("select agent, session_id, msg_id, output from turns where line_no = 0 or event_id % 2 = 1")
def flt_null_ts(spark, sf_dir):
    raw = derive.records(spark, sf_dir)
    untimed = (F.col("line_no") == 1) & (F.col("msg_id").cast("bigint") % 2 == 0)
    return ops.dedup_turns(raw.withColumn("ts", F.when(~untimed, F.col("ts")))).select("agent", "session_id", "msg_id", "output")


@query(f"select {_TURN}, repo, sha, {sql_shown('commit_ts')} from attributed")
def jn_next_commit(spark, sf_dir):
    return derive.attributed(spark, sf_dir).select(*_TURN.split(", "), "repo", "sha", shown("commit_ts"))


_ROW = "repo, commit, session_id, agent, activity, turns, input, cache_write, cache_read, output, billable_input, web_search, web_fetch, wall_clock_s"


@query(f"select {_ROW}, models, {sql_shown('ts_lo')}, {sql_shown('ts_hi')} from measured")
def agg_ledger_rows(spark, sf_dir):
    rows = derive.measured(spark, sf_dir)
    return rows.select(*_ROW.split(", "), F.array_join("models", ",").alias("models"), shown("ts_lo"), shown("ts_hi"))


@query("select repo, commit, session_id, agent, model, input, cache_write, cache_read, output from row_model")
def agg_row_by_model(spark, sf_dir):
    rows = derive.measured(spark, sf_dir).select("repo", "commit", "session_id", "agent", F.explode("by_model").alias("model", "t"))
    return rows.select("repo", "commit", "session_id", "agent", "model", "t.*")


def _versions(rows: DataFrame) -> DataFrame:
    """Ledger rows with an earlier version of every fifth repository's and a tied one of the others."""
    older = rows.where("repo in ('repo0', 'repo5')").withColumns({"recorded_at": F.col("recorded_at") - F.expr("interval 1 hour"), "output": F.col("output") + 7, "src_order": F.lit(1)})
    tied = rows.where("repo in ('repo1', 'repo2')").withColumns({"output": F.col("output") + 9, "src_order": F.lit(1)})
    return rows.withColumn("src_order", F.lit(0)).unionByName(older).unionByName(tied)


_LATEST = """select repo, commit, session_id, agent, kind, strftime(boundary_ts, '%Y-%m-%d %H:%M:%S') boundary_ts,
  case when repo in ('repo1', 'repo2') then output + 9 else output end as output, peak_context_tokens from ledger"""


@query(f"{_LATEST}")
def win_ledger_latest(spark, sf_dir):
    rows = ledgers.latest_rows(_versions(stage(derive.ledger(spark, sf_dir), "ledger")))
    shown_boundary = F.date_format("boundary_ts", "yyyy-MM-dd HH:mm:ss").alias("boundary_ts")
    return rows.select("repo", "commit", "session_id", "agent", "kind", shown_boundary, "output", "peak_context_tokens")


@query("select repo, count(*) as n, sum(output)::bigint + 9 * count(*) filter (where kind = 'measured' and repo in ('repo1', 'repo2')) as output from ledger group by repo")
def set_union_sources(spark, sf_dir):
    """Ledger files and notes are read together; the later source wins a tie."""
    rows = _versions(stage(derive.ledger(spark, sf_dir), "ledger"))
    files, notes = rows.where("src_order = 0"), rows.where("src_order = 1")
    both = ops.union_sources([files, notes])
    return ledgers.latest_rows(both).groupBy("repo").agg(F.count("*").alias("n"), F.sum("output").alias("output"))


@query("select repo, session_id, strftime(max(ts_hi), '%Y-%m-%d %H:%M:%S.%g') as mark from measured group by all")
def jn_watermark(spark, sf_dir):
    return at.watermarks(derive.measured(spark, sf_dir)).select("repo", "session_id", shown("mark"))


@query("select repo, session_id, strftime(boundary_ts, '%Y-%m-%d %H:%M:%S') as boundary_ts from compactions where conv_id % 3 <> 0")
def jn_new_compactions(spark, sf_dir):
    found = derive.compactions(spark, sf_dir)
    known = found.where("cast(substring(session_id, 2) as bigint) % 3 = 0")
    return at.new_compactions(found, known).select("repo", "session_id", F.date_format("boundary_ts", "yyyy-MM-dd HH:mm:ss").alias("boundary_ts"))


_SESSIONS_SQL = """select distinct 's' || user_id session_id, user_id,
  '/src/repo' || (user_id % 10) || case when user_id % 7 = 0 then '0' else '' end || '/pkg' || (user_id % 4) cwd from events"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id").distinct().selectExpr(
        "concat('s', user_id) session_id", "user_id",
        "concat('/src/repo', user_id % 10, if(user_id % 7 = 0, '0', ''), '/pkg', user_id % 4) cwd",
    )


def _repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("concat('/src/repo', user_id % 10) root", "concat('repo', user_id % 10) repo").distinct()


_BOOKED_SQL = """, known as (select repo, session_id, max(boundary_ts) mark from compactions where turn % 2 = 0 and conv_id % 3 = 0 group by all)
select c.repo, c.session_id, strftime(boundary_ts, '%Y-%m-%d %H:%M:%S') as boundary_ts, m.sha
from (select c.* from compactions c left join known k using (repo, session_id) where mark is null or boundary_ts > mark) c
asof left join marks m on c.repo = m.repo and c.boundary_ts <= m.commit_ts"""


@query(_BOOKED_SQL)
def flt_compaction_window(spark, sf_dir):
    """Compactions booked to the next commit, after the marks that a third of the sessions have in the ledger."""
    found = derive.compactions(spark, sf_dir)
    known = found.where("cast(substring(session_id, 2) as bigint) % 3 = 0 and (unix_seconds(boundary_ts) - unix_seconds(timestamp'2024-01-01')) % 2 = 0")
    ledger = known.select("repo", "session_id", "boundary_ts", F.col("boundary_ts").alias("ts_hi"))
    return at.compactions_of_commits(found, derive.commits(spark, sf_dir), ledger).select("repo", "session_id", F.date_format("boundary_ts", "yyyy-MM-dd HH:mm:ss").alias("boundary_ts"), "sha")


@query(
    f"""with s as ({_SESSIONS_SQL}), r as (select distinct '/src/repo' || (user_id % 10) root from events)
    select distinct session_id, root from s join r on (user_id % 3 > 0 and (cwd = root or starts_with(cwd, root || '/')))
      or (user_id % 3 < 2 and root = '/src/repo' || (user_id % 10))""",
    prelude=False,
)
def jn_filed_sessions(spark, sf_dir):
    """A third of the sessions name no directory and are filed under their root, a third have both, a third the directory alone."""
    rows = _sessions(spark, sf_dir).selectExpr(
        "session_id", "if(user_id % 3 > 0, cwd, null) cwd", "regexp_replace(if(user_id % 3 < 2, concat('/src/repo', user_id % 10), cwd), '[^A-Za-z0-9-]', '-') project"
    )
    return at.filed_sessions_in_repos(rows, _repos(spark, sf_dir).select("root")).select("session_id", "root")


@query("select repo, commit, session_id, output from measured where not (repo in ('repo0', 'repo7') and agent = 'codex')")
def jn_already_recorded(spark, sf_dir):
    rows = derive.measured(spark, sf_dir)
    return at.not_recorded(rows, rows.where("repo in ('repo0', 'repo7') and agent = 'codex'")).select("repo", "commit", "session_id", "output")


@query(
    f"""with s as ({_SESSIONS_SQL}), r as (select distinct '/src/repo' || (user_id % 10) root from events)
    select session_id, cwd, root from s join r on cwd = root or starts_with(cwd, root || '/')""",
    prelude=False,
)
def jn_path_prefix(spark, sf_dir):
    return at.sessions_in_repos(_sessions(spark, sf_dir), _repos(spark, sf_dir).select("root")).select("session_id", "cwd", "root")


@query(
    f"""with s as ({_SESSIONS_SQL}), r as (select distinct '/src/repo' || (user_id % 10) root from events)
    select session_id, root from s join r on root = '/src/repo' || (user_id % 10) or user_id % 5 = 0""",
    prelude=False,
)
def jn_workspace_roots(spark, sf_dir):
    sessions = _sessions(spark, sf_dir).selectExpr("session_id", "if(user_id % 5 = 0, array('/src', concat('/src/repo', user_id % 10)), array(concat('/src/repo', user_id % 10))) workspace_roots")
    return at.workspaces_in_repos(sessions, _repos(spark, sf_dir).select("root")).select("session_id", "root")


def _claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on a session by several repositories: each turn's repository also by its activity."""
    rows = derive.turns(spark, sf_dir).where("activity is not null").selectExpr("session_id", "concat(repo, '-', activity) repo", "ts ts_hi")
    return at.claims(rows)


_CLAIMED_SQL = ", cl as (select session_id, repo || '-' || activity repo, max(ts) ts_hi from turns where activity is not null group by all)"


@query(_CLAIMED_SQL + f" select session_id, repo, {sql_shown('ts_hi')} from cl")
def agg_claims(spark, sf_dir):
    return _claimed(spark, sf_dir).select("session_id", "repo", shown("ts_hi"))


@query(
    _CLAIMED_SQL
    + """ select a.session_id, a.repo, strftime(max(b.ts_hi), '%Y-%m-%d %H:%M:%S.%g') as ceiling
    from cl a left join cl b on a.session_id = b.session_id and a.repo <> b.repo group by all"""
)
def jn_claim_ceiling(spark, sf_dir):
    return at.claim_ceilings(_claimed(spark, sf_dir)).select("session_id", "repo", shown("ceiling"))


@query("select commit, session_id, output from measured where commit in (select sha from commits where sha < '8')")
def jn_commit_range(spark, sf_dir):
    chosen = derive.commits(spark, sf_dir).where("sha < '8'").select(F.col("sha").alias("commit"))
    return at.in_commit_range(derive.measured(spark, sf_dir), chosen).select("commit", "session_id", "output")


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Commits numbered in each repository, and their parents: each seventh starts a branch, which the fourth after it merges."""
    numbered = derive.commits(spark, sf_dir).withColumn("n", F.row_number().over(W.partitionBy("repo").orderBy("commit_ts", "sha")))
    n = stage(numbered.select("repo", "sha", "n"), "commits")
    links = "array(struct(0 as position, n - if(n % 7 = 3, 3, 1) as m), struct(1 as position, if(n % 7 = 6, n - 4, null) as m))"
    up = n.select("repo", F.col("n").alias("m"), F.col("sha").alias("parent"))
    return n, stage(n.selectExpr("repo", "sha", f"inline({links})").join(up, ["repo", "m"]).select("repo", "sha", "position", "parent"), "parents")


_RANGES_SQL = """, numbered as (select repo, sha, row_number() over (partition by repo order by commit_ts, sha) n from commits),
links as (select repo, sha, n - case when n % 7 = 3 then 3 else 1 end m from numbered
  union all select repo, sha, n - 4 from numbered where n % 7 = 6),
parents as (select l.repo, l.sha, p.sha parent from links l join numbered p on l.repo = p.repo and l.m = p.n),
low as (select repo, sha from numbered where n = 9), head as (select repo, arg_max(sha, n) sha from numbered group by repo),
tips as (select 'since' name, 'out' side, * from low union all select 'since', 'in', * from head where repo in (select repo from low)
  union all select 'apart', 'left', * from low where repo in (select repo from numbered where n = 10) union all select 'apart', 'right', repo, sha from numbered where n = 10
  union all select 'whole', 'in', * from low),
reach as (select name, side, repo, sha from tips
  union select r.name, r.side, r.repo, p.parent from reach r join parents p on r.repo = p.repo and r.sha = p.sha),
flags as (select name, repo, sha, bool_or(side = 'in') i, bool_or(side = 'out') o, bool_or(side = 'left') l, bool_or(side = 'right') r
  from reach group by all),
spent as (select repo, commit, sum(output)::bigint output from measured group by all)
select name, f.repo, f.sha as commit, coalesce(output, 0) as output from flags f left join spent s on f.repo = s.repo and f.sha = s.commit
where (i or l <> r) and not o"""


@query(derive.SQL.replace("with", "with recursive", 1) + _RANGES_SQL, prelude=False)
def jn_history_ranges(spark, sf_dir):
    """Commits of three ranges of each history with the output tokens booked to them: ``A..``, ``A...B`` and ``A``."""
    commits, parents = _history(spark, sf_dir)
    refs = commits.where("n = 9").selectExpr("repo", "'v1' ref", "sha").unionByName(commits.where("n = 10").selectExpr("repo", "'side' ref", "sha"))
    refs = refs.unionByName(commits.groupBy("repo").agg(F.max_by("sha", "n").alias("sha")).withColumn("ref", F.lit("HEAD")))
    exprs = F.expr("inline(map_entries(map('since', 'v1..', 'apart', 'v1...side', 'whole', 'v1', 'none', 'HEAD ^v1 missing'))) as (name, expr)")
    ranges = commits.select("repo").distinct().select("repo", exprs)
    found = history.commits_in_ranges(parents, ranges, commits, refs)
    spent = derive.measured(spark, sf_dir).groupBy("repo", "commit").agg(F.sum("output").alias("output"))
    return found.join(spent, ["repo", "commit"], "left").select("name", "repo", "commit", F.coalesce("output", F.lit(0)).alias("output"))


_ROOTS_SQL = f"""with s as ({_SESSIONS_SQL}), r as (select distinct '/src/repo' || (user_id % 10) root from events),
subs as (select root || '/.sub' root, root outer_root from r union all select root || '/.sub/.in', root from r union all select root, root from r)
select session_id, s.cwd, subs.root from s join subs on cwd = outer_root or starts_with(cwd, outer_root || '/')"""


@query(_ROOTS_SQL, prelude=False)
def jn_superproject(spark, sf_dir):
    """Sessions of repositories whose submodules have submodules: they work below the outermost root."""
    tops = _repos(spark, sf_dir).selectExpr("root", "cast(null as string) superproject")
    subs = tops.selectExpr("concat(root, '/.sub') root", "root superproject")
    inner = subs.selectExpr("concat(root, '/.in') root", "root superproject")
    placed = history.session_roots(tops.unionByName(subs).unionByName(inner), outermost=True)
    found = at.sessions_in_repos(_sessions(spark, sf_dir), placed.select(F.col("root").alias("repo"), "session_root"), root="session_root")
    return found.select("session_id", "cwd", F.col("repo").alias("root"))


_PAIRS_SQL = """, pairs as (select 's' || user_id session_id, ts commit_ts, min(md5(cast(event_id as varchar))) sha
  from e where event_type = 'purchase' and user_id % 4 = 0 group by all)
select t.session_id, t.msg_id, p.sha from turns t asof left join pairs p on t.session_id = p.session_id and t.ts <= p.commit_ts
where t.session_id in (select session_id from pairs)"""


@query(_PAIRS_SQL)
def jn_explicit_backfill(spark, sf_dir):
    pairs = derive.events(spark, sf_dir).where("event_type = 'purchase' and user_id % 4 = 0")
    pairs = pairs.selectExpr("concat('s', user_id) session_id", "md5(cast(event_id as string)) sha", "ts commit_ts")
    return at.backfill(derive.turns(spark, sf_dir), pairs).select("session_id", "msg_id", "sha")


#: Shell commands, whether each commits, and the directory it works in below /w/s.
COMMANDS = [
    ("git commit -m x", True, "/w/s"),
    ("git -C /abs/dir commit -qm y", True, "/abs/dir"),
    ("cd sub && git -c a=b commit --amend", True, "/w/s/sub"),
    ("cd /top && git -C ../other commit", True, "/other"),
    ('git -C "a dir" commit', True, "/w/s/a dir"),
    ("git commit --dry-run", False, "/w/s"),
    ("git commit -h", False, "/w/s"),
    ("git log --grep commit", False, "/w/s"),
    ("ls; cd '/q r'; GIT_X=1 git commit", True, "/q r"),
    ("echo it's done && git commit -m 'x'", True, "/w/s"),
    ("bash -c 'cd sub && git commit -m x'", True, "/w/s/sub"),
    ('cd /top; sh -ec "bash -c \'git -C in commit -m y\'"', True, "/top/in"),
    ("bash -c 'git commit -h'", False, "/w/s"),
    ('git commit -m "drop the -h flag; git push"', True, "/w/s"),
    ("git --no-pager commit", True, "/w/s"),
    ('git -C a\\ dir commit -m "say \\"hi\\" && go"', True, "/w/s/a dir"),
    ("ls # git commit", False, "/w/s"),
    ('echo "git commit" | tee log', False, "/w/s"),
    ("git log \\\n  --oneline && \\\n  git \\\n  commit", True, "/w/s"),
]


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of tool calls: every purchase runs one of the commands."""
    listed = F.array(*(F.lit(c) for c, _, _ in COMMANDS))
    e = derive.events(spark, sf_dir).where("event_type = 'purchase'")
    command = listed[(F.col("event_id") % len(COMMANDS)).cast("int")]
    return e.select("event_id", F.concat(F.lit("s"), "user_id").alias("session_id"), "ts", F.lit("/w/s").alias("cwd"), command.alias("command"))


def _sql_case(k: int) -> str:
    quote = lambda v: str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return f"case event_id % {len(COMMANDS)} " + " ".join(f"when {i} then {quote(c[k])}" for i, c in enumerate(COMMANDS)) + " end"


@query(f"select event_id, {_sql_case(1)} as is_commit from events where event_type = 'purchase'", prelude=False)
def prj_is_commit_cmd(spark, sf_dir):
    return _calls(spark, sf_dir).select("event_id", is_commit_command(F.col("command")).alias("is_commit"))


@query(f"select event_id, {_sql_case(2)} as directory from events where event_type = 'purchase'", prelude=False)
def prj_commit_dir(spark, sf_dir):
    return _calls(spark, sf_dir).select("event_id", commit_directory(F.col("command"), F.col("cwd")).alias("directory"))


@query(
    f""", calls as (select 's' || user_id session_id, ts commit_ts, min(md5(cast(event_id as varchar))) sha
    from e where event_type = 'purchase' and {_sql_case(1)} group by all)
    select t.session_id, t.msg_id, c.sha from turns t asof left join calls c on t.session_id = c.session_id and t.ts <= c.commit_ts
    where t.session_id in (select session_id from calls)"""
)
def jn_cross_repo(spark, sf_dir):
    """Commits found in the tool log take their own session's turns, whatever the repository."""
    made = at.commit_events(_calls(spark, sf_dir), is_commit_command(F.col("command")), commit_directory(F.col("command"), F.col("cwd")))
    pairs = made.select("session_id", F.md5(F.col("event_id").cast("string")).alias("sha"), F.col("ts").alias("commit_ts"))
    return at.backfill(derive.turns(spark, sf_dir), pairs).select("session_id", "msg_id", "sha")


@query("select url, regexp_replace(url, '[^A-Za-z0-9-]', '-', 'g') as directory from pages", prelude=False)
def prj_munge_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", project_directory(F.col("url")).alias("directory"))


@query("select session_id, repo, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1) as seconds from turns group by all")
def prj_span_seconds(spark, sf_dir):
    spans = derive.turns(spark, sf_dir).groupBy("session_id", "repo").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return spans.select("session_id", "repo", ledgers.span_seconds(F.col("lo"), F.col("hi")).alias("seconds"))


def _human_sql(n: str) -> str:
    """Tenths are rounded half up, as ``format_string`` does."""
    tenths = lambda div: f"(({n}) * 20 + {div}) // {2 * div}"
    one = lambda div, unit: f"({tenths(div)} // 10) || '.' || ({tenths(div)} % 10) || '{unit}'"
    steps = " ".join(f"when ({n}) >= {div} then {one(div, unit)}" for div, unit in ((10**9, "B"), (10**6, "M"), (10**3, "k")))
    return f"case {steps} else cast(({n}) as varchar) end"


@query(f"select l_orderkey, l_linenumber, {_human_sql('n')} as shown from (select l_orderkey, l_linenumber, cast(l_orderkey * l_partkey * l_linenumber as bigint) n from lineitem)", prelude=False)
def prj_human(spark, sf_dir):
    n = F.col("l_orderkey") * F.col("l_partkey") * F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", report.human(n.cast("bigint")).alias("shown"))


@query("select repo, commit, agent, session_id, kind, turns, output, billable_input from ledger")
def prj_show(spark, sf_dir):
    return report.show(derive.ledger(spark, sf_dir)).drop("recorded_at")


@query("select repo, kind, case when commit like 'pending@%' then true else false end as pending, count(*) as n from ledger where kind = 'measured' group by all")
def flt_measured(spark, sf_dir):
    rows = derive.ledger(spark, sf_dir).where(~report.is_compaction())
    return rows.groupBy("repo", "kind", F.col("commit").startswith("pending@").alias("pending")).agg(F.count("*").alias("n"))


_TOTALS_SQL = """coalesce(sum(input), 0)::bigint as input, coalesce(sum(cache_write), 0)::bigint as cache_write,
  coalesce(sum(cache_read), 0)::bigint as cache_read, coalesce(sum(output), 0)::bigint as output,
  coalesce(sum(billable_input), 0)::bigint as billable_input"""
_WALL_SQL = "round(coalesce(sum(wall_clock_s), 0), 1) as wall_clock_s"
_COMMITS_SQL = "count(distinct commit) filter (where kind = 'measured' and commit not like 'pending@%') as commits"


@query(
    f"""select {_TOTALS_SQL}, coalesce(sum(turns), 0)::bigint as turns, {_WALL_SQL}, coalesce(sum(web_search), 0)::bigint as web_search,
    coalesce(sum(web_fetch), 0)::bigint as web_fetch, count(*) as ledger_rows, {_COMMITS_SQL},
    strftime(max(recorded_at), '%Y-%m-%d %H:%M:%S.%g') as through, count(*) filter (where kind <> 'measured') as compactions,
    coalesce(sum(peak_context_tokens), 0)::bigint as peak_context_tokens, coalesce(sum(summary_chars), 0)::bigint as summary_chars from ledger"""
)
def agg_totals(spark, sf_dir):
    return report.totals(derive.ledger(spark, sf_dir)).withColumn("through", shown("through"))


@query("select model, sum(input)::bigint as input, sum(cache_write)::bigint as cache_write, sum(cache_read)::bigint as cache_read, sum(output)::bigint as output, sum(input + cache_write + cache_read)::bigint as billable_input from row_model group by model")
def agg_by_model(spark, sf_dir):
    return report.by_model(derive.ledger(spark, sf_dir))


@query(f"select coalesce(nullif(activity, ''), 'unlabeled') as activity, {_TOTALS_SQL} from measured group by 1")
def agg_by_activity(spark, sf_dir):
    return report.by_label(derive.ledger(spark, sf_dir), "activity")


@query(f"select coalesce(nullif(agent, ''), 'unknown') as agent, {_TOTALS_SQL} from measured group by 1")
def agg_by_agent(spark, sf_dir):
    return report.by_label(derive.ledger(spark, sf_dir), "agent")


@query(f"select repo, {_COMMITS_SQL} from ledger group by repo")
def agg_commits(spark, sf_dir):
    return derive.ledger(spark, sf_dir).groupBy("repo").agg(F.count_distinct(report.real_commit()).alias("commits"))


@query("select repo, count(*) filter (where kind <> 'measured') as compactions, coalesce(sum(peak_context_tokens), 0)::bigint as peak_context_tokens, coalesce(sum(summary_chars), 0)::bigint as summary_chars from ledger group by repo")
def agg_compaction(spark, sf_dir):
    return report.totals(derive.ledger(spark, sf_dir), ["repo"]).select("repo", "compactions", "peak_context_tokens", "summary_chars")


def _report_sql(key: str) -> str:
    return f""", keyed as (select *, {key} as key from measured),
    named as (select key, string_agg(distinct r.model, ',' order by r.model) as models
      from keyed m join row_model r on m.repo = r.repo and m.commit = r.commit and m.session_id = r.session_id and m.agent = r.agent group by key),
    summed as (select key, sum(turns)::bigint as turns, {_TOTALS_SQL}, {_WALL_SQL} from keyed group by key)
    select * from summed join named using (key)"""


@query(_report_sql("substring(commit, 1, 10)"))
def agg_report_commit(spark, sf_dir):
    return report.report(derive.ledger(spark, sf_dir), "commit")


@query(_report_sql("strftime(recorded_at, '%Y-%m-%d')"))
def agg_report_day(spark, sf_dir):
    return report.report(derive.ledger(spark, sf_dir), "day")


@query(_report_sql("coalesce(nullif(activity, ''), 'unlabeled')"))
def agg_report_activity(spark, sf_dir):
    return report.report(derive.ledger(spark, sf_dir), "activity")


@query(_report_sql("coalesce(nullif(agent, ''), 'unknown')"))
def agg_report_agent(spark, sf_dir):
    return report.report(derive.ledger(spark, sf_dir), "agent")


@query("select model as key, 0::bigint as turns, sum(input)::bigint as input, sum(cache_write)::bigint as cache_write, sum(cache_read)::bigint as cache_read, sum(output)::bigint as output, sum(input + cache_write + cache_read)::bigint as billable_input, 0.0::double as wall_clock_s, model as models from row_model group by model")
def agg_report_model(spark, sf_dir):
    return report.report(derive.ledger(spark, sf_dir), "model")


@query(
    f""", each as (select repo, {_TOTALS_SQL}, coalesce(sum(turns), 0)::bigint as turns, {_WALL_SQL}, {_COMMITS_SQL} from ledger group by repo)
    select * from each union all
    select 'TOTAL', sum(input)::bigint, sum(cache_write)::bigint, sum(cache_read)::bigint, sum(output)::bigint, sum(billable_input)::bigint,
    sum(turns)::bigint, round(sum(wall_clock_s), 1), sum(commits)::bigint from each"""
)
def agg_fleet(spark, sf_dir):
    return report.fleet(derive.ledger(spark, sf_dir)).select("repo", *report.KINDS, "turns", "wall_clock_s", "commits")


@query(
    f""", t as (select {_TOTALS_SQL}, sum(turns)::bigint turns, {_COMMITS_SQL} from ledger)
    select 'LLM usage' as label, 'blue' as color,
    {_human_sql('output + billable_input')} || ' tok · ' || {_human_sql('turns')} || ' turns · ' || commits || ' commits' as message from t"""
)
def snk_badge(spark, sf_dir):
    return report.badge(report.totals(derive.ledger(spark, sf_dir)))


_KEPT = "repo, commit, session_id, agent, kind, activity, turns, input, cache_write, cache_read, output, billable_input, web_search, web_fetch, wall_clock_s, peak_context_tokens, summary_chars"


@query(f"select {_KEPT}, models from ledger")
def snk_ledger_roundtrip(spark, sf_dir):
    """Appended in two parts, the first of them twice, and read back."""
    path = new_path(spark, "ledger")
    rows = stage(derive.ledger(spark, sf_dir), "rows")
    ledgers.append(rows.where("agent = 'codex'"), path)
    ledgers.append(rows, path)
    return ledgers.read(spark, path).select(*_KEPT.split(", "), F.array_join("models", ",").alias("models"))


@query(f"select {_KEPT}, models from ledger")
def prj_decode_row(spark, sf_dir):
    """Rows written as compact lines and decoded again."""
    lines = wire.encode(derive.ledger(spark, sf_dir))
    return wire.decode(lines).select(*_KEPT.split(", "), F.array_join("models", ",").alias("models"))


@query("""select repo, commit, session_id, input as t0, cache_write as t1, cache_read as t2, output as t3, turns as n,
    case when web_search + web_fetch > 0 then web_search end as st0, kind <> 'measured' as compaction, peak_context_tokens as cp0 from ledger""")
def prj_encode_row(spark, sf_dir):
    lines = wire.encode(derive.ledger(spark, sf_dir))
    get = lambda path: F.get_json_object("value", f"$.{path}")
    numbers = {"t0": "t[0]", "t1": "t[1]", "t2": "t[2]", "t3": "t[3]", "n": "n", "st0": "st[0]", "cp0": "cp[0]"}
    return lines.select(
        "repo", get("c").alias("commit"), get("sid").alias("session_id"),
        *(get(p).cast("bigint").alias(n) for n, p in numbers.items()), F.coalesce(get("k") == "cx", F.lit(False)).alias("compaction"),
    )


_DOC_KINDS = ("billable_input", "cache_read", "cache_write", "input", "output")


def _doc_tokens(p: str) -> str:
    return ", ".join(f"coalesce(sum({p}{k}), 0)::bigint {k}" for k in _DOC_KINDS)


def _doc_split(name: str, key: str, rows: str) -> str:
    fields = ", ".join(f"'{k}', {k}" for k in _DOC_KINDS)
    return f"""(select '{{' || coalesce(string_agg('"' || label || '":' || json_object({fields})::varchar, ',' order by label), '') || '}}' from (select {key} as label, {_doc_tokens('')} from {rows} group by all)) as by_{name}"""


@query(
    f"""select {_doc_tokens('')}, coalesce(sum(turns), 0)::bigint turns, {_COMMITS_SQL}, count(*) as ledger_rows, {_WALL_SQL},
    count(*) filter (where kind <> 'measured') as events, coalesce(sum(summary_chars), 0)::bigint as summary_chars,
    strftime(max(recorded_at), '%Y-%m-%dT%H:%M:%S.%gZ') as through, {_doc_split('activity', "coalesce(activity, 'unlabeled')", 'measured')},
    {_doc_split('agent', 'agent', 'measured')}, {_doc_split('model', 'model', '(select *, input + cache_write + cache_read billable_input from row_model)')} from ledger"""
)
def snk_totals_document(spark, sf_dir):
    """The nested totals document, written to a file and read back as JSON."""
    path = new_path(spark, "totals")
    export.write_totals_document(derive.ledger(spark, sf_dir), path)
    lines = spark.read.text(path)
    get = lambda at: F.get_json_object("value", f"$.{at}")
    numbers = {k: f"tokens.{k}" for k in _DOC_KINDS} | {
        "turns": "turns", "commits": "commits_accounted", "ledger_rows": "ledger_rows", "events": "compaction_signals.events",
        "summary_chars": "compaction_signals.summary_chars",
    }
    return lines.select(
        *(get(at).cast("bigint").alias(n) for n, at in numbers.items()), get("time.wall_clock_s").cast("double").alias("wall_clock_s"), get("through").alias("through"),
        *(get(f"by_{n}").alias(f"by_{n}") for n in ("activity", "agent", "model")),
    )


@query("select conv_id, turn, peak_context_tokens, model from compactions")
def win_compaction_peak(spark, sf_dir):
    found = ops.compaction_events(derive.conversation_records(spark, sf_dir), ["conv_id"], "turn")
    return found.select("conv_id", "turn", "peak_context_tokens", "model")


@query("select conv_id, turn, summary_chars from compactions")
def win_summary_lookahead(spark, sf_dir):
    found = ops.compaction_events(derive.conversation_records(spark, sf_dir), ["conv_id"], "turn")
    return found.select("conv_id", "turn", "summary_chars")


@query("""select session_id, msg_id, last_value(case when web_search = 1 then model end ignore nulls)
    over (partition by session_id order by ts, msg_id rows between unbounded preceding and current row) as model from turns""")
def win_codex_model_ffill(spark, sf_dir):
    named = F.when(F.col("web_search") == 1, F.col("model"))
    rows = derive.turns(spark, sf_dir)
    return rows.select("session_id", "msg_id", ops.carry_forward(named, ["session_id"], ["ts", "msg_id"]).alias("model"))


@query("select count(*) as readable_rows, (select count(*) from measured where repo = 'repo3') as corrupt_rows, 10::bigint as files, count(*) filter (where repo in ('repo8', 'repo9')) as note_rows from ledger")
def qlt_ledger_health(spark, sf_dir):
    rows = derive.ledger(spark, sf_dir)
    lines = wire.encode(rows).withColumn("path", F.concat(F.lit("/l/"), "repo")).withColumn("src_order", F.when(F.col("repo").isin("repo8", "repo9"), 1).otherwise(0))
    broken = lines.where(F.col("value").contains('"n":') & (F.col("repo") == "repo3")).withColumn("value", F.substring("value", 2, 1000))
    return quality.ledger_health(wire.decode(lines.unionByName(broken)))


@query("""select agent, case agent when 'codex' then 120 when 'opencode' then 60 else 30 end as retention_days,
    date_diff('day', min(ts)::date, date '2024-02-01') as age_days, agent <> 'codex' as at_risk from turns group by agent""")
def qlt_retention(spark, sf_dir):
    oldest = derive.turns(spark, sf_dir).groupBy("agent").agg(F.datediff(F.lit(derive.SWEEP).cast("date"), F.min("ts").cast("date")).cast("long").alias("age_days"))
    retention = spark.createDataFrame([("codex", 120), ("opencode", 60)], "agent string, days int")
    return quality.retention_risk(retention, oldest)


@query("""select r.repo, a.agent, count(distinct t.session_id) as sessions from (select distinct repo from turns) r
    cross join (select distinct agent from turns union select 'other') a left join turns t on t.repo = r.repo and t.agent = a.agent group by all""")
def qlt_backend_coverage(spark, sf_dir):
    turns = derive.turns(spark, sf_dir)
    agents = spark.createDataFrame([("claude-code",), ("codex",), ("opencode",), ("other",)], "agent string")
    return quality.source_coverage(agents, turns.select("repo").distinct(), turns)


@query("""select agent, repo, arg_max(session_id, struct_pack(ts := m, p := session_id)) as session_id
    from (select agent, repo, session_id, max(ts) m from turns group by all) group by agent, repo""")
def srt_latest_session(spark, sf_dir):
    from watttrail.sources.agents import latest_transcript

    sessions = derive.turns(spark, sf_dir).groupBy("agent", "repo", "session_id").agg(F.max("ts").alias("mtime"))
    return latest_transcript(sessions.withColumn("path", F.col("session_id")), ["agent", "repo"]).select("agent", "repo", "session_id")


@query("""select * exclude (s), round(s, 9) as share from (select repo, commit, session_id, agent, model,
    (input + cache_write + cache_read + output) / sum(input + cache_write + cache_read + output) over (partition by repo, commit, session_id, agent) s
    from row_model)""")
def win_turn_share(spark, sf_dir):
    from watttrail.plans.estimate import model_shares

    return model_shares(derive.ledger(spark, sf_dir)).select("repo", "commit", "session_id", "agent", "model", F.round("share", 9).alias("share"))
