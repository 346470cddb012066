"""Divergence of sources within a language: chi-square-like sums over their term frequencies.

Identical texts of a language are collapsed, with the number of copies in each source, and
tokenized once; a text's counts and document frequencies then enter each source's table times
that number. Terms are counted in bounded dictionaries of a task, whose contents Spark adds up.

A pair of sources is compared over all kept terms of the language, most of which neither has.
With ``p0`` and ``q0`` the frequency of a term that a source lacks, the sum of ``f(p, q)`` is

    sum over shared terms  of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
    + sum over own terms   of f(p, q0) - f(p0, q0)
    + sum over other terms of f(p0, q) - f(p0, q0)  + (all kept terms) f(p0, q0)

The first line is a join on the term; the next two need only how often each value of ``p``
occurs in a source. So the work follows the terms that sources do have.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watttrail.llm.columns import pick
from watttrail.llm.memory import BATCH_BYTES, released
from watttrail.operators.skew import lookup
from watttrail.session import stage

LEAST_DOCUMENTS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Terms that a task holds before it passes their counts on.
TERMS_AT_ONCE = 200_000
_SLICE = 1 << 20
#: Bytes of terms stay, A-Z in lower case; all others become a blank.
_TABLE = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in bytes(range(256)).lower())
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def count_terms(text: bytes) -> Counter[bytes]:
    """Occurrences of each term of a text in UTF-8; long texts are read slice by slice."""
    clean, found, lo = text.translate(_TABLE), Counter(), 0
    while lo < len(clean):
        hi = clean.find(b" ", lo + _SLICE) if lo + _SLICE < len(clean) else -1
        hi = len(clean) if hi < 0 else hi
        found.update(clean[lo:hi].split())
        lo = hi
    return found


def _distinct_texts(rows: DataFrame) -> DataFrame:
    """``(lang, text, copies)`` for each text of a language, ``copies`` the number of its rows by source.

    Both sides are combined before their exchange on the text's digest, so a frequent text
    sends a row from each task.
    """
    hashed = rows.select("lang", "source", "text", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    counts = hashed.groupBy("lang", "sha", "source").agg(F.count("*").alias("n"))
    copies = counts.groupBy("lang", "sha").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("copies"))
    texts = hashed.groupBy("lang", "sha").agg(F.first("text").alias("text"))
    return texts.join(copies, ["lang", "sha"]).select("lang", "text", "copies")


def term_counts(texts: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of each term in each source."""
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def flush(held: dict[tuple, list[Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for lo in range(0, len(terms), 20_000):
                part = terms[lo : lo + 20_000]
                arrays = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([n[t] for t in part]), pa.array([docs[t] for t in part])], schema=kinds)
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[Counter]] = {}
        with released():
            for batch in batches:
                columns = [batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()]
                for lang, text, copies in zip(*columns, strict=True):
                    found = count_terms(text.as_py())
                    for source, times in copies:
                        n, docs = held.setdefault((lang, source), [Counter(), Counter()])
                        if times == 1:
                            n.update(found)
                            docs.update(found.keys())
                        else:
                            for term, k in found.items():
                                n[term] += k * times
                                docs[term] += times
                if sum(len(n) for n, _ in held.values()) > TERMS_AT_ONCE:
                    yield from flush(held)
            yield from flush(held)

    # a term that many tasks and sources have is added up before the exchange
    found = texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column) -> Column:
    """``1 + floor(SCALE * (n + 1) / (total + kept))``, exact; null where the language keeps no term."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    top, bottom = top.cast("decimal(31,0)"), (F.col("total") + F.col("kept")).cast("decimal(20,0)")
    return F.when(F.col("kept") > 0, 1 + F.call_function("div", top, bottom))


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def divergence(df: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every pair of sources and the telling terms of each.

    Nulls count as empty. A language keeps the terms of ``least`` documents or more. Part
    ``pair`` has every other source of the language with the divergence from it, 0 if no term is
    kept; part ``term`` the terms that the source has more often than its language, the ``top``
    first. Repeated rows count each time. An empty table gives an empty result.
    """
    spark = df.sparkSession
    picked = pick(df, lang=lang_col, source=source_col, text=text_col)
    rows = picked.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in picked.columns))
    before = {key: spark.conf.get(key) for key in _BATCH}
    for key, value in _BATCH.items():
        spark.conf.set(key, value)
    try:
        counts = stage(term_counts(_distinct_texts(rows)), "counts")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least)
    kept = stage(kept.drop("docs"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    own = stage(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "own")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    # every group that occurs, with terms or without
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = groups.withColumn("g", F.concat(F.length("lang"), F.lit(":"), "lang", "source")).withColumn("p0", _share(F.lit(0)))
    groups = stage(groups, "groups")
    total = groups.agg(F.coalesce(F.sum("terms"), F.lit(0))).first()[0]
    info = groups.where("terms > 0").select("g", F.col("terms").alias("weight"), "total", "kept", "lang_total", "p0")
    keyed = own.select("lang", F.concat(F.length("lang"), F.lit(":"), "lang", "source").alias("g"), "source", "term", "n", "lang_n")
    found = lookup(keyed, info, "g", "weight", total, "term").withColumn("p", _share(F.col("n")))
    whole = _share(F.col("lang_n")).alias("q")
    found = stage(found.select("lang", "source", "term", "p", F.col("lang_total").alias("total"), "kept", "lang_n").select("lang", "source", "term", "p", whole), "shares")
    return _ranked(_pairs(found, groups), "pair", None).unionByName(_ranked(_terms(found), "term", top))


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for each group and each other source of its language."""
    keys = ["lang", "source", "item"]
    side = groups.select("lang", "source", "p0", "kept")
    other = side.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = stage(side.join(other, "lang").where("source <> item"), "pairs")
    base = pairs.select(*keys, F.expr(f"coalesce(kept * {_f('p0', 'q0')}, 0)").alias("v"))
    # how often each frequency occurs in a source
    values = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    single = values.join(pairs, ["lang", "source"])
    ahead = single.select(*keys, F.expr(f"k * ({_f('p', 'q0')} - {_f('p0', 'q0')})").alias("v"))
    back = single.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.expr(f"k * ({_f('q0', 'p')} - {_f('q0', 'p0')})").alias("v"))
    zero = groups.select("lang", "source", "p0")
    a = shares.join(zero, ["lang", "source"]).select("lang", "term", "source", "p", "p0")
    b = a.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    met = a.join(b, ["lang", "term"]).where("source < item").groupBy(*keys)
    ways = [F.sum(F.expr(f"{_f(x, y)} - {_f(x, y + '0')} - {_f(x + '0', y)} + {_f(x + '0', y + '0')}")) for x, y in (("p", "q"), ("q", "p"))]
    both = stage(met.agg(ways[0].alias("ahead"), ways[1].alias("back")), "both")
    shared = both.select(*keys, F.col("ahead").alias("v")).union(both.select("lang", "item", "source", "back"))
    return base.union(ahead).union(back).union(shared).groupBy(*keys).agg(F.sum("v").alias("value"))


def _terms(shares: DataFrame) -> DataFrame:
    return shares.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))


def _ranked(rows: DataFrame, part: str, top: int | None) -> DataFrame:
    """Ranks from 1; of more than ``top`` rows a task passes no more on."""
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = rows.withColumn("rank", rank)
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
