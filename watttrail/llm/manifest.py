"""Merkle manifest of a dataset: a tree of digests for each source, one over the sources, and a proof for each row.

Rows are numbered within their source by one range exchange of digests. A level of a tree is a
table of nodes with their position; every ``FANOUT`` consecutive ones are a run. Within a run,
lag and lead columns of each fixed offset, masked by the node's slot and the run's length, give
a node its siblings, and the first node of a run hashes all of it to the parent. Runs are spread
over all tasks whatever their source, and a level has a sixteenth of the nodes below it. On the
way back a node's path, the siblings at its level and above, is looked up by run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watttrail.llm.columns import pick
from watttrail.llm.sharding import number_rows
from watttrail.operators.skew import lookup
from watttrail.session import stage

FANOUT = 16
#: One of so many rows, by the checksum of its id, is tampered with.
TAMPER = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODE = ["g", "pos", "size", "digest"]


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def framed(value: Column) -> Column:
    """A value with its length in bytes; ``-`` if null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return sha(F.concat(*map(framed, values)))


def _run() -> Column:
    return F.floor(F.col("pos") / FANOUT).cast("long")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` plus ``run``, ``slot`` and the digests ``lefts`` and ``rights`` of the run's other nodes, joined."""
    placed = nodes.withColumns({"run": _run(), "slot": F.pmod("pos", F.lit(FANOUT)).cast("int")})
    length = F.least(F.lit(FANOUT), F.col("size") - F.col("run") * FANOUT)
    run = W.partitionBy("g", "run").orderBy("slot")
    lags = [F.when(F.col("slot") >= k, F.lag("digest", k).over(run)).otherwise("") for k in range(FANOUT - 1, 0, -1)]
    leads = [F.when(F.col("slot") + k < length, F.lead("digest", k).over(run)).otherwise("") for k in range(1, FANOUT)]
    return placed.withColumns({"lefts": F.concat(*lags), "rights": F.concat(*leads)})


def _levels(leaves: DataFrame, most: int) -> list[DataFrame]:
    """Levels of nodes from ``leaves(g, pos, size, digest)`` up; a group ends with its only node, at the latest after ``most``."""
    levels = [leaves]
    while most > 1:
        firsts = with_siblings(levels[-1].select(*_NODE).where("size > 1")).where("slot = 0")
        parent = sha(F.concat("digest", "rights")).alias("digest")
        size = F.ceil(F.col("size") / FANOUT).cast("long").alias("size")
        levels.append(stage(firsts.select("g", F.col("run").alias("pos"), size, parent), "level"))
        most = -(-most // FANOUT)
    return levels


def _roots(levels: list[DataFrame]) -> DataFrame:
    """``(g, digest)``: the only node of each group."""
    found = [level.where("size = 1").select("g", "digest") for level in levels]
    for other in found[1:]:
        found[0] = found[0].unionByName(other)
    return found[0]


def _paths(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The lowest of ``levels`` with each node's ``path``, from its own level up, and ``subroot``.

    ``ends(g, subroot, path)`` has the path of each group's root.
    """
    found = None
    for k, level in reversed([*enumerate(levels)]):
        ended = level.where("size = 1").join(ends, "g")
        if found is not None:
            up = found.select("g", F.col("pos").alias("run"), F.col("path").alias("upper"), "subroot")
            own = F.array(F.struct("lefts", "rights"))
            below = with_siblings(level.where("size > 1")).join(up, ["g", "run"]).withColumn("path", F.concat(own, "upper"))
            ended = ended.unionByName(below.select(*ended.columns))
        found = stage(ended, "paths") if k else ended
    return found


def manifest(df: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    A leaf is the digest of the row's ``fields``, each ``-`` if null. Leaves of a group ascend by
    id (null first), then by leaf; a null group is one of its own and the first. Repeated rows are
    leaves of their own. ``folded_root`` is worked out from the row's leaf, for rows to tamper
    with after lower-casing A-Z in the text, and the siblings of the original tree. A row with a
    null id is not tampered with. An empty table gives an empty result.
    """
    spark = df.sparkSession
    names = {f"f{i}": name for i, name in enumerate(fields)}
    rows = pick(df, id=id_col, source=group_col, text=text_col, **names)
    lower = F.translate("text", _UPPER, _LOWER)
    tampered = leaf_digest(*(lower if name == text_col else F.col(f) for f, name in names.items()))
    chosen = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(TAMPER)) == 0
    # the group as a string that sorts nulls first and by bytes
    group = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("g")
    leaves = rows.select("id", group, leaf_digest(*map(F.col, names)).alias("digest"), F.when(chosen, tampered).alias("tampered"))
    ordered = number_rows(stage(leaves, "leaves"), ["g", "id", "digest"], "number", "total").drop("total")
    ordered = stage(ordered, "ordered")
    groups = stage(ordered.groupBy("g").agg(F.min("number").alias("first"), F.count("*").alias("size"), F.count("*").alias("n")), "groups")
    total, most = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    placed = lookup(ordered, groups, "g", "n", total, "number").withColumn("pos", F.col("number") - F.col("first")).drop("number", "first")
    levels = _levels(stage(placed, "placed"), most)
    subroots = number_rows(_roots(levels), ["g"], "pos", "size").select(F.lit("").alias("g"), "pos", "size", "digest", F.col("g").alias("source"))
    upper = _levels(stage(subroots, "subroots"), groups.count())
    top = _roots(upper).first()
    none = F.array().cast("array<struct<lefts: string, rights: string>>")
    root = F.lit(top["digest"] if top else None).cast("string").alias("root")
    ends = spark.range(1).select(F.lit("").alias("g"), F.lit("").alias("subroot"), none.alias("path"))
    ends = stage(_paths(upper, ends).select(F.col("source").alias("g"), F.col("digest").alias("subroot"), "path"), "ends")
    found = _paths(levels, ends)
    siblings = F.transform("path", lambda s: F.concat(s["lefts"], s["rights"]))
    folded = F.aggregate("path", F.coalesce("tampered", "digest"), lambda own, s: sha(F.concat(s["lefts"], own, s["rights"])))
    return found.select(
        F.col("id").alias(id_col),
        F.col("digest").alias("leaf"),
        "subroot",
        root,
        sha(F.array_join(siblings, "")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
