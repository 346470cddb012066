"""Columns over paths, times and shell commands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pieces of a word: quoted, escaped, bare.
_SINGLE, _DOUBLE, _ESCAPED = r"'[^']*+'", r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', r"\\."
_PIECE = rf"""{_SINGLE}|{_DOUBLE}|{_ESCAPED}|[^\s;&|()"'\\]++"""
#: A comment, a word (of at most 200 pieces, which bounds the matcher's stack) or a mark that ends a simple command.
_TOKEN = rf"(?s)(?<![^\s;&|()])#[^\n]*+|(?:{_PIECE}){{1,200}}+|[;&|()\n]"
#: Levels of commands in commands, as in ``sh -c "bash -c '...'"``.
NESTED = 2
_HOME = "^(/root|/home/[^/]+|/Users/[^/]+)(?:/|$)"


def project_directory(path: Column) -> Column:
    """The directory name under which transcripts of a path are filed; several paths may share one."""
    return F.regexp_replace(path, "[^A-Za-z0-9-]", "-")


def time_of_millis(ms: Column) -> Column:
    """Time of epoch milliseconds; null where they are no number."""
    return F.timestamp_millis(ms.try_cast("bigint"))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def _readable(command: Column) -> Column:
    """The command with its lines joined; one whose quotes do not pair up, which a shell refuses,
    without the apostrophes inside words or, if that does not mend it, without quotes."""
    quoted = F.lit(rf"(?s){_SINGLE}|{_DOUBLE}|{_ESCAPED}")
    paired = lambda text: ~F.regexp_replace(text, quoted, F.lit("")).rlike("[\"']")
    whole = F.regexp_replace(F.coalesce(command, F.lit("")), r"\\\r?\n", " ")
    loose = lambda text: F.regexp_replace(text, r"(?<=\w)'(?=\w)", "")
    mended = lambda text: F.when(paired(text), text).otherwise(F.regexp_replace(text, "[\"']", ""))
    return _let(whole, lambda text: F.when(paired(text), text).otherwise(_let(loose(text), mended)))


def shell_tokens(command: Column) -> Column:
    """Words of a shell command as the shell hands them on (without quotes and escapes), and the
    marks between simple commands. Comments are left out; here-documents count as commands."""
    def plain(piece: Column) -> Column:
        inside = F.substring(piece, F.lit(2), F.length(piece) - 2)
        return (
            F.when(piece.startswith("'"), inside)
            .when(piece.startswith('"'), F.regexp_replace(inside, r'(?s)\\(["\\$`])', "$1"))
            .when(piece.startswith("\\"), F.substring(piece, 2, 1))
            .otherwise(piece)
        )

    found = F.regexp_extract_all(_readable(command), F.lit(_TOKEN), F.lit(0))
    kept = F.filter(found, lambda t: ~t.startswith("#"))
    pieces = lambda t: F.regexp_extract_all(t, F.lit(f"(?s){_PIECE}"), F.lit(0))
    return F.transform(kept, lambda t: F.when(t.rlike("[\"'\\\\]"), F.array_join(F.transform(pieces(t), plain), "")).otherwise(t))


def home_of(cwd: Column) -> Column:
    """The home directory that a working directory lies in; null where none shows."""
    return F.nullif(F.regexp_extract(cwd, _HOME, 1), F.lit(""))


def _inside(base: Column, argument: Column, home: Column) -> Column:
    in_home = F.concat(home, F.substring(argument, 2, 1 << 30))
    tilde = argument.rlike("^~(/|$)") & home.isNotNull()
    return F.when(argument.startswith("/"), argument).when(tilde, in_home).otherwise(F.concat_ws("/", base, argument))


def _state(at: Column, git: Column | None = None, made: Column | None = None, idle: Column | None = None, seek: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    parts = {"git": none if git is None else git, "made": none if made is None else made, "idle": F.lit(False) if idle is None else idle, "seek": F.lit("first") if seek is None else seek}
    return F.struct(at.cast("string").alias("at"), *(v.alias(n) for n, v in parts.items()))


def _walk(command: Column, home: Column, start: Column, finish: Callable[[Column], Column], depth: int = NESTED) -> Column:
    """``finish`` of the state after the last word of a command that begins in the state ``start``.

    A state is ``(at, git, made, idle, seek)``: the directory after the last ``cd``, that of the
    last ``git``, that of the first ``git commit``, and whether a word asks for help by ``-h``. An automaton over the words; ``seek`` is what the next one may be. The command that a shell
    or ``eval`` is given as a word is walked in its place, up to ``depth`` levels of them.
    """
    def step(s: Column, t: Column) -> Column:
        first, word, git = s["seek"] == "first", s["seek"].isin("first", "word"), s["seek"] == "option"

        def to(seek: str, **changed: Column) -> Column:
            return _state(**({n: s[n] for n in ("at", "git", "made", "idle")} | {"seek": F.lit(seek)} | changed))

        out = (
            F.when(t.rlike(r"^[;&|()\n]$"), to("first"))
            .when(s["seek"] == "target", to("word", at=_inside(s["at"], t, home)))
            .when(s["seek"] == "directory", to("option", git=_inside(s["git"], t, home)))
            .when(s["seek"] == "setting", to("option"))
        )
        if depth:
            within = lambda end: to("word", made=end["made"], idle=end["idle"])
            out = out.when(s["seek"] == "script", _walk(t, home, to("first"), within, depth - 1))
        return (
            out.when(t == "-h", to("word", idle=F.lit(True)))
            .when(git & (t == "-C"), to("directory"))
            .when(git & (t == "-c"), to("setting"))
            .when(git & t.startswith("-"), to("option"))
            .when(git & (t == "commit"), to("word", made=F.coalesce(s["made"], s["git"])))
            .when((s["seek"] == "shell") & t.rlike(r"^-\w*c$"), to("script"))
            .when((s["seek"] == "shell") & t.startswith("-"), to("shell"))
            .when(first & (t == "cd"), to("target"))
            .when(first & (t == "eval"), to("script"))
            .when(word & t.rlike("(^|/)git$"), to("option", git=s["at"]))
            .when(word & t.rlike("(^|/)(ba|da|k|z)?sh$"), to("shell"))
            .when(first & t.rlike(r"^\w+="), to("first"))
            .otherwise(to("word"))
        )

    return F.aggregate(shell_tokens(command), start, step, finish)


def is_commit_command(command: Column) -> Column:
    """Whether a shell command makes a commit; null counts as empty.

    A command with ``--dry-run`` or ``--help`` anywhere makes none, nor one with the word ``-h``;
    a message that mentions ``-h`` is no such word. Any options may stand between ``git`` and
    ``commit``. Commands inside the word that ``sh -c`` or ``eval`` takes count.
    """
    text = F.coalesce(command, F.lit(""))
    made = lambda end: end["made"].isNotNull() & ~end["idle"]
    return _walk(command, F.lit("/root"), _state(F.lit("/")), made) & ~(text.contains("--dry-run") | text.contains("--help"))


def _normalised(path: Column) -> Column:
    """An absolute path without ``.``, ``..`` and empty parts."""
    def step(out: Column, part: Column) -> Column:
        up = F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(part.isin("", "."), out).when(part == "..", up).otherwise(F.concat(out, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def commit_directory(command: Column, cwd: Column, home: Column | None = None) -> Column:
    """Directory a commit command works in: ``-C`` within the last ``cd`` before it within ``cwd``.

    ``~`` is ``home``, by default the home directory that ``cwd`` lies in; where none shows, it
    stays as it is. A command that makes no commit works where its last ``cd`` leads.
    """
    at = lambda end: F.coalesce(end["made"], end["at"])
    return _normalised(_walk(command, home_of(cwd) if home is None else home, _state(cwd), at))
