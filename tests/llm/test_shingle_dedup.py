"""The near stage against all pairs of exact Jaccard similarity."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from watttrail.llm import shingle_dedup


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def documents():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(40):  # copies with 0 to 7 of 120 words changed, on both sides of 0.8
        base = [*rng.choice(words, 120)]
        rows.append((i * 10, " ".join(base)))
        for k in range(1, 5):
            copy = [*base]
            for at in rng.integers(0, 120, int(rng.integers(1, 8))):
                copy[at] = f"changed{k}"
            rows.append((i * 10 + k, " ".join(copy)))
    hub = [*rng.choice(words, 300)]
    for i in range(150):  # a bucket larger than a group
        copy = [*hub]
        copy[int(rng.integers(300))] = f"other{i}"
        rows.append((1000 + i, " ".join(copy)))
    return [*rows, (2000, None), (2001, ""), (2002, "two words"), (2003, "Two  WORDS"), (2004, "two other")]


def test_near_stage_matches_all_pairs(spark):
    rows = documents()
    sets = [grams(t) for _, t in rows]
    label = [i for i, _ in rows]
    pairs = [(x, y) for x in range(len(rows)) for y in range(x) if jaccard(sets[x], sets[y]) >= 0.8]
    moved = True
    while moved:
        moved = False
        for x, y in pairs:
            if label[x] != label[y]:
                label[x] = label[y] = min(label[x], label[y])
                moved = True
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stay = {r.doc_id for r in corpus_pipeline.near(spark, df, "").collect()}
    assert stay == set(label)
    assert len(set(label)) < len(rows) - 200


def test_similarity_is_of_sets():
    for a, b in [("a b c d e f", "a b c d e g"), ("", ""), ("x", "X"), ("a b c d e f g", "b c d e f g h")]:
        got = shingle_dedup.similarity(shingle_dedup.shingles(a), shingle_dedup.shingles(b))
        assert got == jaccard(grams(a), grams(b))


def test_empty_table(spark):
    assert corpus_pipeline.near(spark, spark.createDataFrame([], "doc_id long, text string"), "").collect() == []


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    other = " ".join(f"v{i}" for i in range(50))
    rows = [(5, text), (5, text), (5, other), (None, text + " x"), (3, text + " y"), (7, ""), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("k"), "id": F.lit(1), "row": F.lit(2)})
    kept = shingle_dedup.drop_similar(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(3, text + " y"), (5, other), (7, ""), (7, "")])
    alone = shingle_dedup.drop_similar(df.where("doc_id = 5"))
    assert sorted(r.text for r in alone.collect()) == sorted([text, other])


def chain(places, variants):
    """Windows of one text, neighbours of which are just similar; each has variants, similar to it and to no other window."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(180 + 19 * places)]
    windows = [words[19 * place : 19 * place + 180] for place in range(places)]
    rows = []
    for place, window in enumerate(windows):
        for k in range(variants):
            copy = [*window]
            copy[int(rng.integers(25, 155))] = f"v{place}of{k}"
            rows.append((place * variants + k, " ".join(copy)))
    return rows + [(100_000 + place, " ".join(window)) for place, window in enumerate(windows)]


def test_large_buckets_lose_no_link(spark):
    rows = chain(10, 120)
    whole = dict(rows)
    links = [(grams(whole[100_000 + p]), grams(whole[100_001 + p])) for p in range(9)]
    assert all(0.8 <= jaccard(a, b) < 0.81 for a, b in links)
    assert all(jaccard(grams(t), grams(whole[100_000 + i // 120])) > 0.9 for i, t in rows if i < 100_000)
    kept = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert [r.doc_id for r in kept.collect()] == [0]
