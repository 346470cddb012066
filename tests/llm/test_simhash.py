import numpy as np
import xxhash
from pyspark.sql import functions as F

from watttrail.llm import simhash
from watttrail.operators.components import connected_components


def brute_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, distance=3):
    """pairs: (id, fingerprint); the least id reachable, by repeated relaxation."""
    label = [i for i, _ in pairs]
    moved = True
    while moved:
        moved = False
        for x, (_, f) in enumerate(pairs):
            for y, (_, g) in enumerate(pairs):
                if (f ^ g).bit_count() <= distance and label[y] < label[x]:
                    label[x], moved = label[y], True
    return label


def test_fingerprint_matches_brute_force():
    texts = [None, "", " \n\t", "one", "one two", "A b C d é É", "x " * 500, "\x1c a b\x0bc d", "Ünder the ÄPFEL tree " * 3]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_components_match_brute_force(spark):
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        base = list(rng.permutation(words)[:200]) if i % 6 == 0 or not rows else rows[-1][1].split(" ")
        if i % 6:
            base[int(rng.integers(len(base)))] = "changed"
        rows.append((i * 3, " ".join(base)))
    rows += [(1001, None), (1002, ""), (1000, "  \n"), (2000, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("id", F.lit("x"))
    got = simhash.near_duplicates(df).collect()
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{f:016x}" for _, f in prints], brute_components(prints), strict=True))
    assert sorted(map(tuple, got)) == want
    stay = simhash.drop_near_duplicates(df)
    assert stay.columns == df.columns
    assert {r.doc_id for r in stay.collect()} == {c for _, _, c in want}


def test_midpoints_and_buckets_agree(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**62), 2**62, 4)
    values = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            x = int(b)
            for bit in rng.integers(0, 63, int(rng.integers(1, 5))):
                x ^= 1 << int(bit)
            values.add(x)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = []
    for kwargs in ({"bucket": 2048}, {"bucket": 3}, {"bucket": 3, "blocks": 6}):
        found = {r.node: r.root for r in connected_components(simhash.links(fps, 3, **kwargs)).collect()}
        roots.append([found.get(v, v) for v in sorted(values)])
    ordered = sorted(values)
    want = brute_components([(v, v & (2**64 - 1)) for v in ordered])
    assert roots[0] == roots[1] == roots[2] == want


def test_blocks_grow_with_the_number_of_fingerprints():
    assert [simhash.choose_blocks(10**k) for k in (3, 6, 8, 12)] == [5, 5, 6, 8]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
