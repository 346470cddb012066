import re
from hashlib import sha256

from watttrail.llm import exact_dedup
from watttrail.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from watttrail.llm.sharding import permute, shard_rows


def brute_keep(rows):
    groups = {}
    for i, (key, text) in enumerate(rows):
        sha = sha256(re.sub(r"[\x20\x09-\x0d]", "", text or "").encode()).hexdigest()
        groups.setdefault(sha, []).append((-len(text or ""), key is None, key or 0, i))
    out = []
    for i, (key, text) in enumerate(rows):
        sha = sha256(re.sub(r"[\x20\x09-\x0d]", "", text or "").encode()).hexdigest()
        best = min(groups[sha])
        out.append((str(key), str(None if best[1] else best[2]), len(groups[sha]), sha))
    return sorted(out), len(groups)


TEXTS = ["a b", "ab", "a  b", None, "", " \n", "ünï", "ü nï", "x" * 50_000, "x" * 49_999 + " x", "\x1cab", "a b", "𝒳 y", "𝒳y"]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(1, "ab"), (1, "ab"), (None, "zz"), (None, "zz"), (7, "zz")] + [(100 + i, "hot") for i in range(300)]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as sha", "1 as id")
    got = exact_duplicates(df).collect()
    want, groups = brute_keep(rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == groups
    kept = drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted(
        (str(r.doc_id), next(t or "" for k, t in sorted(rows, key=lambda x: -len(x[1] or "")) if k == r.doc_id and sha256(re.sub(r"[\x20\x09-\x0d]", "", t or "").encode()).hexdigest() == r.text_sha256))
        for r in got if r.kept
    )


def test_exact_duplicates_match_brute_force(spark):
    check(spark, ROWS)


def test_without_a_filter(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FILTER_WORDS", 0)
    check(spark, ROWS)


def test_unique_rows_are_not_flagged(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(2000)] + [(5000, "text 7")], "doc_id long, text string")
    hashed = rows.select(exact_dedup.digest(rows.text).alias("sha"))
    flagged = exact_dedup.mark_repeats(hashed, hashed).where("may_repeat").count()
    assert 2 <= flagged < 40


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_duplicates(empty).collect() == drop_exact_duplicates(empty).collect() == []
    assert shard_rows(empty, ["doc_id"], 4).collect() == []


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 5, 17, 100, 997):
        df = spark.range(n).selectExpr("id", f"cast({n} as bigint) n")
        assert sorted(r[0] for r in df.select(permute(df.id, df.n, 7)).collect()) == list(range(n))


def test_shards_are_even_reproducible_and_computable(spark):
    rows = [(i if i % 9 else None, f"t{i}") for i in range(501)] + [(3, "same")] * 90
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 as slot")
    got = shard_rows(df, ["doc_id", "text"], 7, seed=4)
    found = got.collect()
    assert got.columns == ["doc_id", "text", "row_number", "shard", "slot"] and len(found) == len(rows)
    assert sorted(r.row_number for r in found) == list(range(len(rows)))
    for shard in range(7):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) - len(rows) // 7 in (0, 1)
    again = shard_rows(df.repartition(5), ["doc_id", "text"], 7, seed=4).collect()
    key = lambda rs: sorted((str(r.doc_id), r.text, r.shard, r.slot) for r in rs)
    assert key(found) == key(again)
    assert key(found) != key(shard_rows(df, ["doc_id", "text"], 7, seed=5).collect())
    numbered = spark.createDataFrame([(r.row_number, r.shard, r.slot) for r in found], "i long, shard int, slot long")
    placed = numbered.selectExpr("*", f"cast({len(rows)} as bigint) n")
    assert {(r.i, r[1]) for r in placed.select("i", permute(placed.i, placed.n, 4)).collect()} == {(r.row_number, r.slot * 7 + r.shard) for r in found}
