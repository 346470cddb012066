"""The Jaccard join against all pairs of a small table."""

import random
import re

import numpy as np
import pytest

from watttrail.llm import overlap
from watttrail.llm.overlap import product_links, shingles, signatures, similar_texts


def plain_set(text, shingle=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", low) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1)))


def plain(rows, num=90, den=100):
    """``(id, size, component)`` by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and num * max(len(a), len(b)) <= den * min(len(a), len(b)) and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted((str(key), len(s), str(least.get(root(i)))) for i, ((key, _), s) in enumerate(zip(rows, sets, strict=True)))


def families(seed, sizes, copies):
    """Texts of each size with copies that differ from it and from each other in a few words."""
    rng, rows = random.Random(seed), []
    for size in sizes:
        base = [f"w{rng.randrange(40 * size)}" for _ in range(size)]
        rows.append(base)
        for _ in range(copies):
            words = list(rng.choice(rows[-copies:]))
            for _ in range(rng.randrange(1, max(2, size // 50 + 2))):
                at, way = rng.randrange(len(words)), rng.random()
                if way < 0.5:
                    words[at] = f"x{rng.randrange(1000)}"
                elif way < 0.75:
                    del words[at]
                else:
                    words.insert(at, "added")
                words = words or ["w"]
            rows.append(words)
    return [" ".join(r) for r in rows]


EDGES = [None, "", " \t\n", "a", "A", "a b", "a\vb", "a  B c", "a b c", "ünï Ünï", "\x1cx y z", "x y z", "a b c d e f g h i j k l", "a b c d e f g h i j k l m"]


def rows_of(df):
    return sorted((str(r[0]), r[1], str(r[2])) for r in df.collect())


def table_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as node", "'q' as Text_", "1 as n", "2 as id", "3 as c0")


def test_components_match_all_pairs(spark):
    texts = EDGES + families(1, [5, 12, 20, 30, 45, 60, 66, 90, 130, 200, 400, 900], 6)
    texts += ["hot " * 3 + "copy of many rows"] * 60 + ["word " * 30_000 + "end", "word " * 30_000 + "end of it"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(None, texts[20]), (None, None), (990, texts[10]), (990, texts[10])]
    got = similar_texts(table_of(spark, rows).repartition(5))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert rows_of(got) == plain(rows)


@pytest.mark.parametrize("num", [80, 100])
def test_other_bounds(spark, num):
    rows = [*enumerate(EDGES + families(num, [8, 25, 70, 150], 6))]
    assert rows_of(similar_texts(table_of(spark, rows), num=num)) == plain(rows, num)


def test_large_groups_are_dealt_into_blocks(spark, monkeypatch):
    """A long shared text connects all; chains of near copies and rows that only resemble them."""
    monkeypatch.setattr(overlap, "ROWS", 8)
    monkeypatch.setattr(overlap, "HUBS", 2)
    rng = random.Random(3)
    common = [f"c{i}" for i in range(300)]
    texts = [" ".join(common + [f"own{k}-{i}" for i in range(rng.randrange(12, 40))]) for k in range(60)]
    chain = list(common)
    for k in range(40):
        chain[7 * k % 300] = f"step{k}"
        texts.append(" ".join(chain))
    rows = [*enumerate(texts)]
    assert rows_of(similar_texts(table_of(spark, rows))) == plain(rows)


def test_empty_table_and_bounds(spark):
    assert similar_texts(table_of(spark, [(1, "a")]).where("false")).collect() == []
    with pytest.raises(ValueError):
        similar_texts(table_of(spark, [(1, "a")]), num=70)


@pytest.mark.parametrize("size", [3, 9, 10, 19, 20, 40, 63, 64, 65, 72, 100, 500, 3000])
def test_sets_within_the_bound_share_a_key(size):
    rng = np.random.default_rng(size)
    for _ in range(30):
        base = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        drop = rng.integers(0, size * 10 // 100 + 1)
        add = rng.integers(0, size * 10 // 100 + 1)
        other = np.unique(np.concatenate((rng.permutation(base)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64))))
        both = len(np.intersect1d(base, other))
        if 100 * both >= 90 * (len(base) + len(other) - both) and not np.array_equal(base, other):
            assert len(np.intersect1d(signatures(base), signatures(other)))


def test_product_of_a_block():
    texts = families(9, [40, 80, 2500], 8)
    grams = [shingles(t) for t in texts]
    links = product_links(np.array([len(g) for g in grams]), grams)
    got = {frozenset((a, b)) for a, b in links}
    assert all(a < b for a, b in links)
    want = plain([*enumerate(texts)])
    least = {i: i for i in range(len(texts))} | {b: a for a, b in links}
    assert sorted((str(i), len(plain_set(t)), str(least[i])) for i, t in enumerate(texts)) == want
    assert len(got) == len(links)


def test_hot_keys_connect_all_their_nodes(spark, monkeypatch):
    from watttrail.llm import overlap
    from watttrail.operators.components import connected_components

    monkeypatch.setattr(overlap, "HOT", 64)
    monkeypatch.setattr(overlap, "SAMPLED", 1)
    monkeypatch.setattr(overlap, "PARTS", 4)
    rows = [(n, 1) for n in range(300)] + [(n, 1000 + n // 2) for n in range(1000, 1006)] + [(5, 8), (1000, 9), (9999, 10)]
    edges = overlap._agreements(spark.createDataFrame(rows, "node long, key long"))
    assert edges.where("a >= b").isEmpty()
    found = {r.node: r.root for r in connected_components(edges).collect()}
    assert found == {n: 0 for n in range(300)} | {n: n - n % 2 for n in range(1000, 1006)}


def shuffled_bytes(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_without_partners_pass_no_exchange(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"{rng.getrandbits(256):064x}" for _ in range(300))) for i in range(150)]
    rows += [(1000 + i, t + " end" * (i % 2)) for i, t in enumerate([t for _, t in rows[:3]] * 4)]
    docs = table_of(spark, rows).repartition(3)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = docs.select("doc_id", "text").localCheckpoint()
        before = shuffled_bytes(spark)
        got = rows_of(similar_texts(texts))
        moved = shuffled_bytes(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == plain(rows)
    assert moved < sum(len(t) for _, t in rows) / 3


@pytest.mark.parametrize("words", [1 << 20, 3])
def test_filter_of_texts_loses_none(spark, monkeypatch, words):
    monkeypatch.setattr(overlap, "FILTER_WORDS", words)
    rows = spark.range(6000).selectExpr("id", "xxhash64(id) as t", "hash(id) as u")
    wanted = rows.where("id % 5 = 0").select("t", "u")
    got = {r.id for r in overlap._picked(rows, wanted, wanted.count()).collect()}
    assert got >= set(range(0, 6000, 5))
    if words > 3:
        assert len(got) < 1500
    assert overlap._picked(rows, wanted.where("false"), 0).isEmpty()
