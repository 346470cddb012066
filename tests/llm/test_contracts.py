"""The registered queries on small tables: columns, types and values against plain versions."""

import hashlib
import re
import zlib
from collections import Counter
from math import isqrt, log10

import numpy as np
import pytest
import xxhash
from test_dedup_and_shards import brute_keep
from test_models import corpus
from test_simhash import brute_components, brute_fingerprint
from test_text_tools import check_pieces

from watttrail.llm import queries, sharding
from watttrail.session import new_path

BLANK = re.compile(r"[\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def place(spark):
    path = new_path(spark, "contracts")
    rows = [(i, t, lang) for i, t, lang in corpus(90, 3)]
    rows += [(200 + i, t, lang) for i, t, lang in rows[:8]]
    rows += [(300, None, "aa"), (301, "", None), (302, "12 34", None), (303, "Ünï  Wörds\tand\x0bmore", None), (304, "word " * 4000, None)]
    docs = [(i, t, lang, None if i % 9 == 0 else "s", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    long = "<html>" + "ä" * 80
    pages = [(1, "u", long), (2, "v", long), (3, None, None), (4, "w", "x"), (5, "w", "x"), (6, "y", "<p>" * 50)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=32).astype("f4").tolist()) for i in range(400)] + [(400, None), (401, [0.0] * 32), (402, [float("nan")] * 32)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path, {i: t for i, t, *_ in docs}, pages, dict(vectors)


def kinds(df):
    return dict(df.dtypes)


def has(df, **wanted):
    assert {c: kinds(df)[c] for c in wanted} == wanted


def rest(doc_id, by):
    return zlib.crc32(str(doc_id).encode()) % by


def plain_position(number, n, seed):
    """The Feistel permutation with cycle walking, on Python's integers."""
    a = isqrt(n - 1) + 1
    b = -(-n // a)

    def mix(i, half, modulus):
        state = 42
        for value, width in ((seed, 8), (i, 4), (half, 8)):
            state = xxhash.xxh64_intdigest(value.to_bytes(width, "little"), state)
        return (state - (1 << 64) if state >> 63 else state) % modulus

    while True:
        left, right = divmod(number, b)
        for i in range(sharding.ROUNDS):
            if i % 2 == 0:
                left = (left + mix(i, right, a)) % a
            else:
                right = (right + mix(i, left, b)) % b
        number = left * b + right
        if number < n:
            return number


def test_op1(spark, place):
    found = queries.op1_license_scan(spark, place[0])
    has(found, doc_id="bigint", license="string", own_license="string", own_licenses="array<string>")
    assert sorted(r.doc_id for r in found.collect()) == sorted(place[1])


def test_op2(spark, place):
    found = queries.op2_feistel_shards(spark, place[0])
    has(found, size="bigint", text_crc32="bigint", law="string", shard="int", slot="bigint", grown_shard="int")
    rows, n = found.collect(), len(place[1])
    order = sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in place[1].items())
    want = {}
    for number, (i, size, crc) in enumerate(order):
        slot, shard = divmod(plain_position(number, n, 20), 40)
        want[i] = (size, crc, "rows", shard, slot, None)
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in rows} == want
    assert len(rows) == n


def test_op3(spark, place):
    found = queries.op3_byte_gru_language(spark, place[0])
    has(found, doc_id="bigint", held_out="boolean", lang_pred="string", score="double")
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == sorted(place[1])
    for r in rows:
        assert r.held_out == (rest(r.doc_id, 3) == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", place[1][r.doc_id] or ""))


def test_op4(spark, place):
    found = queries.op4_bloom_exact_dedup(spark, place[0])
    has(found, doc_id="bigint", keep_id="bigint", group_size="bigint", kept="boolean", text_sha256="string")
    rows = found.collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rows) == brute_keep([*place[1].items()])[0]
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)


def test_op5(spark, place):
    rows = queries.op5_nbest_pieces(spark, place[0]).collect()
    assert sorted(r.doc_id for r in rows) == sorted(place[1])
    assert all(r.round_trip and (r.second_score is None or r.second_score <= r.best_score) for r in rows)


def test_op6(spark, place):
    found = queries.op6_content_addressed_warc(spark, place[0])
    has(found, page_id="bigint", payload_bytes="bigint", payload_digest="string", record_type="string", refers_to="bigint")
    raw = {i: (t or "").encode() for i, _, t in place[2]}
    first = {}
    for i in sorted(raw):
        first.setdefault(raw[i], i)
    want = set()
    for i, body in raw.items():
        again = len(body) >= 100 and first[body] != i
        want.add((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()} == want


def test_op7(spark, place):
    found = queries.op7_suffix_tree_scores(spark, place[0])
    has(found, doc_id="bigint", held_out="boolean", n_tokens="bigint", n_known="bigint", train_tokens="bigint", base_score="double", score="double")
    lower = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for i, t in place[1].items()}
    tokens = {i: [w for w in BLANK.split(t) if w] + [None] for i, t in lower.items()}
    counts = Counter(w for i, ws in tokens.items() if rest(i, 7) != 2 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == sorted(place[1])
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (rest(r.doc_id, 7) == 2, len(ws), sum(w in counts for w in ws), total)
        assert r.base_score == pytest.approx(sum(log10((counts[w] + 1) / (total + distinct + 1)) for w in ws))
        assert r.score <= 0


def test_op8(spark, place):
    found = queries.op8_multi_index_hashing(spark, place[0])
    has(found, query_id="bigint", rank="int", vec_id="bigint", score="double")
    vectors = {i: np.array(v, "f8") for i, v in place[3].items() if i < 400}
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [*range(0, 400, 20)]
    hits = 0
    for q, found_rows in got.items():
        scores = {i: float(vectors[q] @ v) for i, v in vectors.items() if i != q}
        assert [rank for rank, *_ in found_rows] == [*range(1, 21)]
        assert all(s == pytest.approx(scores[i]) for _, i, s in found_rows)
        assert found_rows == sorted(found_rows, key=lambda x: (-x[2], x[1]))
        hits += len({i for _, i, _ in found_rows} & set(sorted(scores, key=lambda i: (-scores[i], i))[:20]))
    assert hits >= 0.9 * 20 * len(got)


def test_op9(spark, place):
    found = queries.op9_simhash_blocks(spark, place[0])
    has(found, doc_id="bigint", fingerprint="string", component_id="bigint")
    prints = [(i, brute_fingerprint(t)) for i, t in sorted(place[1].items())]
    want = {i: (f"{f:016x}", root) for (i, f), root in zip(prints, brute_components(prints), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found.collect()} == want


def test_op10(spark, place):
    found = queries.op10_sum_of_squares_packing(spark, place[0])
    has(found, doc_id="bigint", start="bigint", length="bigint", ids_crc32="bigint", doc_tokens="bigint", sequence_id="bigint", offset="bigint")
    check_pieces(found.collect(), place[1])
