"""Jaccard join of texts by blocked sparse products of the document by n-gram incidence.

A document's row of the incidence is the set of its distinct word n-grams. Equal sets are one
class and enter once. The join of the classes has three steps.

1. Column blocks. Two sets within the bound differ in at most ``d`` grams, which follows from the
   larger size. The axis of gram hashes is cut into more than ``d`` blocks, so both sets agree
   wholly on some of them (``signatures``); sets that agree nowhere are never multiplied. Sets of
   up to ``SHORT`` grams take triples of their first grams instead, two of which agree likewise.
2. Row blocks. Sets connected by agreements form a group, and a group is dealt into row blocks of
   bounded size. A task multiplies a block with itself, column block by column block: it adds
   overlap counts up and discards the pairs whose remaining columns cannot lift them to the bound
   that their sizes set. A few hubs of a large group take part in each of its blocks and link them.
3. Blocks of a large group that hold different components after that are multiplied by each other,
   pairs of one component left out.

Every pair within the bound is either multiplied or already in one component. Pairs are never
written out: a product yields a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watttrail.llm.columns import pick
from watttrail.llm.memory import BATCH_BYTES, released
from watttrail.operators.components import connected_components
from watttrail.operators.skew import lookup
from watttrail.session import stage

#: The bound ``num / den`` of similarity; smaller ones than 0.8 are not taken.
NUM, DEN = 90, 100
SHINGLE = 3
#: Sets of up to so many grams meet by triples of grams.
SHORT = 64
#: A block with fewer grams is no agreement, unless a set has more such blocks than it can spare.
LEAST_GRAMS = 2
#: Rows and grams of a row block, about; both are dealt by hash.
ROWS, GRAMS = 512, 1 << 20
HUBS = 8
#: A key that about so many nodes have is hot; one node in ``SAMPLED`` tells, and ``PARTS`` tasks share its nodes.
HOT, SAMPLED, PARTS = 1 << 12, 1 << 6, 64
COLUMNS = 2048
#: The filter of the texts that are read again has a word for about so many of them, up to ``FILTER_WORDS``
#: (about 32 bytes each as a broadcast relation: 32 MB); beyond that more texts pass it, and all results stay.
TEXTS_PER_WORD, FILTER_WORDS = 4, 1 << 20
SEED = 42
_ROWS_AT_ONCE = 256
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(_ROWS_AT_ONCE), "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
_BLANKS = np.frombuffer(b" \t\n\v\f\r", np.uint8)
_NONE = np.zeros(0, np.uint64)

#: Keys of a set of gram hashes; sets to be compared share one.
Keys = Callable[[np.ndarray], np.ndarray]


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Few rows and bytes go to Python at once, as a row holds a whole text or its grams."""
    before = {key: spark.conf.get(key) for key in _BATCH}
    for key, value in _BATCH.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle."""
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    word = ~np.isin(raw, _BLANKS)
    if not word.any():
        return _NONE
    # every word with one blank after it; the last has none
    after = np.concatenate(([False], word[:-1])) & ~word
    joined = np.where(word, raw, _BLANKS[0])[word | after].tobytes().rstrip()
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == _BLANKS[0]), len(joined))
    starts = np.concatenate(([0], ends[:-1] + 1))
    stops = ends[shingle - 1 :] if len(ends) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), stops.tolist(), strict=False)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(stops)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def most_apart(size: int, num: int, den: int) -> int:
    """Grams in which two sets within the bound can differ, the larger having ``size``."""
    return 2 * size * (den - num) // (den + num)


@cache
def _edges(num: int, den: int) -> list[int]:
    """Least sizes of the size classes of longer sets; partners are in one class or in neighbouring ones."""
    edges = [SHORT + 1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * den // num + 1)
    return edges


@cache
def _triples(n: int) -> np.ndarray:
    return np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)


def _short_keys(hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Triples of a prefix of which partners share at least three grams."""
    n = len(hashes)
    least = -(-num * n // den)
    if least == n and n * den // num == n:
        return _NONE  # nothing but an equal set is within the bound
    at = mixed(hashes[: n - least + 3])[_triples(min(n, n - least + 3))]
    return mixed(at.sum(axis=1, dtype=np.uint64))


def _block_keys(hashes: np.ndarray, size_class: int, num: int, den: int) -> np.ndarray:
    """One key for each column block of the class, of the block's grams."""
    apart = most_apart(_edges(num, den)[size_class + 1] - 1, num, den)
    spare = 2 + apart // 16
    blocks = apart + 1 + spare
    block = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    bounds = np.searchsorted(block, np.arange(blocks + 1, dtype=np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)))
    held = sums[bounds[1:]] - sums[bounds[:-1]]
    place = np.uint64((size_class + 1) << 32) + np.arange(blocks, dtype=np.uint64)
    keys = mixed(held ^ mixed(place))
    full = np.diff(bounds) >= LEAST_GRAMS
    # partners agree on `spare` blocks and one more, so at most `spare` may be left out
    return keys[full] if blocks - full.sum() <= spare else keys


def signatures(hashes: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Keys of a sorted set; any two sets within the bound that differ share one."""
    n = len(hashes)
    if num == den:
        return _NONE  # equal sets are one class already
    found = [_short_keys(hashes, num, den)] if n <= SHORT else []
    edges = _edges(num, den)
    own = int(np.searchsorted(edges, n, "right")) - 1
    found += [_block_keys(hashes, k, num, den) for k in (own, own + 1) if k >= 0 and n * den // num >= edges[k]]
    return np.unique(np.concatenate(found)) if found else _NONE


def product_links(sizes: np.ndarray, grams: list[np.ndarray], num: int = NUM, den: int = DEN, apart: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links ``(first of a component, member)`` among the rows of a block, from its sparse product with itself.

    With ``apart``, a label for each row, only pairs of different labels are multiplied.
    """
    m = len(sizes)
    lo, hi = np.minimum(sizes[:, None], sizes), np.maximum(sizes[:, None], sizes)
    need = -(-num * (lo + hi) // (num + den))
    alive = np.triu(den * lo >= num * hi, 1)
    if apart is not None:
        alive &= apart[:, None] != apart
    every, owner = np.concatenate([*grams, _NONE]), np.repeat(np.arange(m), [len(g) for g in grams])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.append(True, every[1:] != every[:-1])[: len(every)]
    column = np.cumsum(first) - 1
    # a gram of one row adds to no overlap
    shared = np.bincount(column, minlength=1)[column] > 1 if len(column) else np.zeros(0, bool)
    owner, column = owner[shared], np.cumsum(first[shared]) - 1
    rest = np.bincount(owner, minlength=m)
    overlap = np.zeros((m, m), np.int64)
    for lo_column in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        alive &= overlap + np.minimum(rest[:, None], rest) >= need
        rows = np.flatnonzero(alive.any(axis=0) | alive.any(axis=1))
        if not len(rows):
            break
        a, b = np.searchsorted(column, [lo_column, lo_column + COLUMNS])
        block = np.zeros((m, min(COLUMNS, int(column[-1]) + 1 - lo_column)), np.float32)
        block[owner[a:b], column[a:b] - lo_column] = 1
        part = block[rows]
        overlap[np.ix_(rows, rows)] += (part @ part.T).astype(np.int64)
        rest = rest - np.bincount(owner[a:b], minlength=m)
    linked = alive & (overlap >= need)
    linked |= linked.T
    links, unseen = [], linked.any(axis=0)
    for i in np.flatnonzero(unseen):
        frontier = np.array([i])[unseen[i : i + 1]]
        unseen[frontier] = False
        while len(frontier):
            frontier = np.flatnonzero(linked[frontier].any(axis=0) & unseen)
            unseen[frontier] = False
            links += [(int(i), int(j)) for j in frontier]
    return links


def prints(docs: DataFrame, shingle: int, keys: Keys, fingerprint: Callable[[str | None], int] | None = None) -> DataFrame:
    """``docs(id, text)`` without the text, plus ``n`` (size of the set), ``node`` (its hash), ``keys`` and hashes of the text.

    ``node`` is null for an empty set. With ``fingerprint``, a function of a text, its value comes as ``fp``.
    """
    rows = docs.select("id", F.xxhash64("text").alias("t"), F.hash("text").alias("u"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released():
            for batch in batches:
                for lo in range(0, batch.num_rows, _ROWS_AT_ONCE):
                    part = batch.slice(lo, _ROWS_AT_ONCE)
                    texts = part.column(3).to_pylist()
                    sets = [shingles(t, shingle) for t in texts]
                    nodes = [node_of(s) for s in sets]
                    found = [keys(s).view(np.int64) if len(s) else _NONE.view(np.int64) for s in sets]
                    arrays = [*part.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
                    if fingerprint:
                        arrays.append(pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)))
                    yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["id", "t", "u", "n", "node", "keys", *(["fp"] if fingerprint else [])]
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, t long, u int, n long, node long, keys array<bigint>{', fp long' if fingerprint else ''}")


def node_of(hashes: np.ndarray) -> int | None:
    """A set's hash as a signed long; of 10^9 different sets two share one with a chance of 0.03."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 1)).view(np.int64)) if len(hashes) else None


def _agreements(keyed: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect all nodes with a common key in ``keyed(node, key)``.

    Every key passes one exchange. Keys that a sample of the nodes shows to be hot are dealt into
    ``PARTS`` parts, whose least nodes are then linked to each other.
    """
    sample = keyed.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SAMPLED)) == 0)
    often = sample.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT // SAMPLED)
    hot = [r[0] for r in often.orderBy(F.desc("n"), "key").limit(1000).select("key").collect()]
    part = F.when(F.col("key").isin(hot), F.xxhash64("key", F.pmod(F.hash("node"), F.lit(PARTS)))).otherwise(F.col("key"))
    dealt = keyed.select("node", part.alias("part"), *([F.when(F.col("key").isin(hot), F.col("key")).alias("hot")] if hot else []))
    so_far = W.partitionBy("part").orderBy("node").rowsBetween(W.unboundedPreceding, 0)
    hubs = dealt.withColumn("a", F.first("node").over(so_far))
    if not hot:
        return hubs.where("a < node").select("a", F.col("node").alias("b"))
    met = stage(hubs.where("a < node or hot is not null").select("a", F.col("node").alias("b"), "hot"), "met")
    tops = met.where("hot is not null and a = b").groupBy("hot").agg(F.sort_array(F.collect_set("a")).alias("tops"))
    between = tops.select(F.col("tops")[0].alias("a"), F.explode("tops").alias("b"))
    return met.select("a", "b").union(between).where("a < b")


def _blocks(rows: Column, grams: Column) -> Column:
    return F.greatest(F.ceil(rows / ROWS), F.ceil(grams / GRAMS)).cast("long")


def _products(rows: DataFrame, by: list[str], num: int, den: int) -> DataFrame:
    """Links ``(a, b)`` within each group of ``rows(node, apart, grams)``; a group is one row block or two."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        nodes = block.column("node").to_numpy()
        grams = [np.frombuffer(g.as_buffer(), np.uint64) for g in block.column("grams")]
        labels = block.column("apart").to_numpy()
        links = product_links(np.array([len(g) for g in grams], np.int64), grams, num, den, labels)
        ends = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": nodes[ends[:, 0]], "b": nodes[ends[:, 1]]})

    return rows.select(*by, "node", "apart", "grams").groupBy(*by).applyInArrow(run, "a long, b long")


def _picked(texts: DataFrame, wanted: DataFrame, count: int) -> DataFrame:
    """The rows of ``texts(t, u, ...)`` that ``count`` rows ``wanted(t, u)`` may name: all of these and few others.

    A blocked Bloom filter, three bits of one 64-bit word a text, meets the rows where they are
    read, so that the others pass no exchange.
    """
    words = min(FILTER_WORDS, -(-count // TEXTS_PER_WORD)) or 1
    word = F.pmod("t", F.lit(words)).alias("word")
    bits = F.expr(" | ".join(f"shiftleft(1L, shiftrightunsigned(u, {6 * k}) & 63)" for k in range(3))).alias("bits")
    held = wanted.select(word, bits).groupBy("word").agg(F.bit_or("bits").alias("held"))
    met = texts.select("*", word, bits).join(F.broadcast(held), "word")
    return met.where(F.col("held").bitwiseAND(F.col("bits")) == F.col("bits")).select(*texts.columns)


def _rows(docs: DataFrame, wanted: DataFrame, count: int, shingle: int) -> DataFrame:
    """The sets of the ``count`` nodes ``wanted(t, u, node, ...)``, worked out again from one text each."""
    texts = _picked(docs.select(F.xxhash64("text").alias("t"), F.hash("text").alias("u"), "text"), wanted.select("t", "u"), count)
    kept = [c for c in wanted.columns if c not in ("t", "u", "node")]
    # copies of a text are one row before the exchange
    once = texts.groupBy("t", "u").agg(F.first("text").alias("text")).join(wanted, ["t", "u"]).select("node", "text", *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released():
            for batch in batches:
                for lo in range(0, batch.num_rows, _ROWS_AT_ONCE):
                    part = batch.slice(lo, _ROWS_AT_ONCE)
                    grams = pa.array([shingles(t.as_py(), shingle).tobytes() for t in part.column(1)], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], grams], ["node", *kept, "grams"])

    kinds = ", ".join(f"{c} {once.schema[c].dataType.simpleString()}" for c in ("node", *kept))
    return once.mapInArrow(run, f"{kinds}, grams binary")


def _cross(rows: DataFrame, links: DataFrame, num: int, den: int) -> DataFrame:
    """Links between different components within the large groups of ``rows(node, root, n, blocks, grams)``.

    Components of a block or more have blocks of their own, the rest of a group are pooled.
    """
    found = connected_components(links).select(F.col("node"), F.col("root").alias("part"))
    large = rows.where("blocks > 1").join(found, "node", "left").withColumn("part", F.coalesce("part", "node"))
    parts = stage(large.groupBy("root", "part").agg(F.count("*").alias("m"), F.sum("n").alias("g")), "parts")
    open_roots = parts.groupBy("root").agg(F.count("*").alias("k")).where("k > 1").select("root")
    own = parts.join(open_roots, "root").withColumn("own", _blocks(F.col("m") * 2, F.col("g") * 2) > 1)
    pools = own.where("not own").groupBy("root").agg(_blocks(F.sum("m"), F.sum("g")).alias("pools"))
    dealt = own.join(pools, "root", "left")
    name = F.when(F.col("own"), F.concat(F.lit("c"), "part", F.lit(":"), F.pmod(F.xxhash64("node"), _blocks(F.col("m"), F.col("g"))))).otherwise(
        F.concat(F.lit("p"), F.pmod(F.xxhash64("part"), "pools"))
    )
    placed = stage(large.join(dealt.select("root", "part", "own", "m", "g", "pools"), ["root", "part"]).withColumn("block", name), "placed")
    sides = placed.groupBy("root", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.when(F.col("own"), F.col("part"))).alias("only"))
    left, right = sides.select("root", *(F.col(c).alias(f"{c}1") for c in sides.columns[1:])), sides.select("root", *(F.col(c).alias(f"{c}2") for c in sides.columns[1:]))
    open_pair = F.col("only1").isNull() | F.col("only2").isNull() | (F.col("only1") != F.col("only2"))
    sized = (F.col("hi1") * den >= F.col("lo2") * num) & (F.col("hi2") * den >= F.col("lo1") * num)
    pairs = left.join(right, "root").where((F.col("block1") <= F.col("block2")) & open_pair & sized)
    ends = pairs.select("root", "block1", "block2", F.explode(F.array_distinct(F.array("block1", "block2"))).alias("block"))
    met = ends.join(placed.select("root", "block", "node", F.col("part").alias("apart"), "grams"), ["root", "block"])
    return _products(met, ["root", "block1", "block2"], num, den)


def linked_sets(docs: DataFrame, shown: DataFrame, shingle: int, num: int, den: int, proposed: DataFrame | None = None) -> DataFrame:
    """``(node, root)`` for nodes linked to others, among ``shown = prints(docs)``.

    Nodes with a common key and those of an edge ``proposed(a, b)`` are in one group.
    """
    spark = docs.sparkSession
    rows = shown.where("node is not null")
    copies = rows.groupBy("node").agg(F.count("*").alias("k"), F.min("id").alias("own"))
    most = stage(copies.where(F.col("k") >= SAMPLED), "copies")
    many = most.where(F.col("k") >= max(SAMPLED, most.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0] // 1000))  # 1000 nodes at most
    once = rows.join(F.broadcast(many.select("node", "own")), "node", "left").where("own is null or own = id")
    keyed = once.select("node", F.explode("keys").alias("key"))
    agreements = _agreements(keyed)
    groups = connected_components(agreements if proposed is None else agreements.union(proposed))
    known = shown.groupBy("node").agg(F.min(F.struct("t", "u")).alias("text"), F.first("n").alias("n"))
    members = stage(groups.join(known, "node").select("node", "root", "n", "text.t", "text.u"), "members")
    sizes = members.groupBy("root").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"))
    wanted = members.join(sizes, "root")
    with small_batches(spark):
        rows = stage(_rows(docs, wanted, members.count(), shingle), "rows")
    large = rows.where("blocks > 1")
    hubs = large.groupBy("root", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(HUBS)).alias("k")).agg(F.min("node").alias("node")).select("node")
    own = F.pmod(F.xxhash64("node"), "blocks")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    others = large.join(hubs, "node").select(*rows.columns, each).where(F.col("block") != own)
    sent = rows.withColumn("block", own).unionByName(others)
    links = stage(_products(sent.withColumn("apart", F.col("node")), ["root", "block"], num, den), "links")
    if not large.isEmpty():
        links = links.union(stage(_cross(rows, links, num, den), "cross"))
    return connected_components(links)


def similar_texts(
    df: DataFrame, num: int = NUM, den: int = DEN, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row of ``df``; texts link where ``den * overlap >= num * union``.

    ``component_id`` is the least id among the rows that links reach (null ids are ignored). A
    text of fewer words than a shingle is one shingle; a null text or one without words has none
    and links with nothing. Repeated rows share a component. An empty table gives an empty result.
    """
    if num * 5 < den * 4 or num > den:
        raise ValueError("the bound is at least 0.8 and at most 1")
    docs = pick(df, id=id_col, text=text_col)
    with small_batches(df.sparkSession):
        shown = stage(prints(docs, shingle, lambda s: signatures(s, num, den)), "prints")
    found = row_components(shown, linked_sets(docs, shown, shingle, num, den))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def row_components(shown: DataFrame, found: DataFrame) -> DataFrame:
    """``(id, n, component_id)`` for every row of ``shown = prints(docs)``, whose nodes are linked as ``found(node, root)`` says."""
    classes = stage(shown.where("node is not null").groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("rows")), "classes")
    linked = stage(found.join(classes, "node").select("node", "root", "first"), "linked")
    least = stage(linked.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("k")), "least")
    total = least.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    component = lookup(linked, least, "root", "k", total, "node").select("node", "least")
    entries = classes.join(component, "node", "left").select("node", "rows", F.coalesce("least", "first").alias("component"))
    count = classes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    rows = shown.select("id", "n", "node", F.monotonically_increasing_id().alias("row"))
    own = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return lookup(rows, stage(entries, "entries"), "node", "rows", count, "row").select("id", "n", own.alias("component_id"))
