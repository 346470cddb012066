"""Packing, piece segmentation and licences against plain versions."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from watttrail.llm import licenses, packing, pieces
from watttrail.llm.queries import piece_bpe, word_bpe
from watttrail.llm.wordbpe import WordEncoder

ODD = [
    None, "", " ", "Plain words, twice. Plain words!", "don't we'll IT'S 123 4.5", "ÀÉÎ çàé ß ÿ Œuvre", "é ́x ﬁ ǅ İ Σς", "<|endoftext|> a<|startoftext|>b",
    "日本語 テキスト 😀😀", " nbsp wide\x1cfs\x85nel", "a\tb\nc\rd\x0be\x0cf", "### --- ***!!! <a href='x'>", "x" * 5000, "µ ª º × ÷ ¼ ²", " private", "🏳️‍🌈 family",
]

# --- tokens and packing


def test_words_give_the_tokenizers_ids():
    plain, own = Tokenizer.from_file(word_bpe()), WordEncoder(word_bpe(), cache=20)
    for text in [t or "" for t in ODD] + [" ".join(t or "" for t in ODD)]:
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want, text


def test_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(0)
    packer = packing.SumOfSquares(16)
    for _ in range(400):
        size = int(rng.integers(1, 16))
        before = packer.counts.copy()

        def cost(level, size=size, before=before):
            after = before.copy()
            after[level] -= level > 0
            if level + size < 16:
                after[level + size] += 1
            return int((after[1:16] ** 2).sum())

        levels = [0] + [h for h in range(1, 16 - size + 1) if before[h]]
        chosen = packer.level(size)
        assert chosen in levels and cost(chosen) == min(map(cost, levels))
        assert chosen == max(h for h in levels if cost(h) == cost(chosen))
        packer.place((0, 0, b"\0" * 4 * size))


def check_pieces(rows, texts):
    """Every id once, offsets without gaps, sequences full or a power of two."""
    plain = Tokenizer.from_file(word_bpe())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sorted(by_doc) == sorted(texts)
    for key, parts in by_doc.items():
        ids = np.array([*plain.encode(texts[key] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0


def test_packing(spark):
    rng = np.random.default_rng(1)
    texts = {i: " ".join(rng.choice(["the", "unthinkable", "ÄPFEL", "x1"], int(rng.integers(0, 1500)))) for i in range(120)}
    texts |= {1000 + i: t for i, t in enumerate(ODD)} | {5000: "word " * 20_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("start", F.lit("x")).repartition(3)
    check_pieces(packing.pack_documents(df, word_bpe()).collect(), texts)
    again = packing.pack_documents(df.limit(1).union(df.limit(1)), word_bpe())
    assert again.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).first()[1:] and again.select("sequence_id").distinct().count() >= 1
    assert packing.pack_documents(df.where("false"), word_bpe()).collect() == []


def test_open_windows_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "OPEN", 8)
    docs = [(i, b"\1\0\0\0" * 1500) for i in range(50)]  # no two fit one window whole
    done = list(packing.sequences(iter(docs)))
    sizes = [sum(len(p[2]) // 4 for p in s) for s in done]
    assert sum(sizes) == 75_000 and all(s & (s - 1) == 0 for s in sizes)
    assert sizes.count(2048) >= 30


# --- pieces


def all_segmentations(lattice, text):
    """Every path of the lattice with its score, by recursion."""
    ends, _ = lattice.edges(text)

    def back(stop):
        if not stop:
            return [(0.0, ())]
        return [(s + score, ids + own) for start, score, own in ends[stop] for s, ids in back(start)]

    return sorted(back(len(text)), key=lambda x: -x[0])


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(piece_bpe())


def test_nbest_matches_all_paths(lattice):
    for text in (" the", " thnterer", "ouñ", " a", "   in", "é😀x", "\n"):
        every = all_segmentations(lattice, text)
        for n in (1, 4, 20):
            got = lattice.best(text, n)
            assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in every[:n]]
            assert len({ids for _, ids in got}) == len(got) and {ids for _, ids in got} <= {ids for _, ids in every}


def test_text_nbest_matches_the_whole_lattice(lattice):
    units = pieces.Units(lattice, 5)
    for text in ("to the", "in a\nof it", "on", "", "a,b!", "x: é😀"):
        ids, scores, back = units.text(text)
        every = all_segmentations(lattice, " " + text)
        assert scores == pytest.approx([s for s, _ in every[:5]]) and back
        assert tuple(np.frombuffer(ids, "<u4")) in {i for s, i in every if s == pytest.approx(every[0][0])}


def test_segmentations_have_their_scores_and_spell_the_text(lattice, spark):
    texts = [t for t in ODD if t != "x" * 5000] + ["the unbelievable untimely rebuilding of houses " * 30]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    of_id = {k: score for score, k in lattice.scores.values()}
    for row in pieces.encode_texts(df, piece_bpe(), n=5, segmentations=True).collect():
        assert len(row.nbest_ids) == len(row.nbest_scores) == len({tuple(x) for x in row.nbest_ids})
        assert row.nbest_ids[0] == row.piece_ids
        for ids, score in zip(row.nbest_ids, row.nbest_scores, strict=True):
            assert lattice.decode(ids) == lattice.decode(row.piece_ids)
            if all(i in of_id for i in ids):
                assert math.isclose(sum(of_id[i] for i in ids), score, rel_tol=1e-9, abs_tol=1e-6)


def test_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, "word " * 3000), (99, "word " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("round_trip", F.lit(0))
    found = pieces.decode_ids(pieces.encode_texts(df, piece_bpe(), n=3), piece_bpe()).collect()
    assert len(found) == len(rows) and all(r.round_trip for r in found)
    assert [r.decoded for r in sorted(found, key=lambda r: r.doc_id)] == [t or "" for _, t in sorted(rows, key=lambda r: r[0])]
    assert all(list(r.nbest_scores) == sorted(r.nbest_scores, reverse=True) and len(r.nbest_scores) <= 3 for r in found)
    assert pieces.encode_texts(df.where("false"), piece_bpe()).collect() == []


# --- licences


def test_best_license_matches_plain_cosines():
    held = {"license": 3, "the": 90, "mit": 5}
    matcher = licenses.Matcher(licenses.TEMPLATES, held, 100)

    def cosine(a, b):
        weight = lambda t: math.log(101 / (1 + held.get(t, 0))) + 1
        x, y = ({t: n * weight(t) for t, n in licenses.terms(s).items()} for s in (a, b))
        dot = sum(w * y.get(t, 0) for t, w in x.items())
        return dot / math.sqrt(sum(w * w for w in x.values()) * sum(w * w for w in y.values())) if dot else 0.0

    units = [s for group in licenses.TEMPLATES.values() for s in group]
    units += ["Released under the MIT license", "licensed under the", "# Licensed under the Apache License, Version 2.0 (the License)", "the of to", "", "mit mit mit license"]
    for unit in units:
        every = [(cosine(unit, s), name) for name, group in licenses.TEMPLATES.items() for s in group]
        top = max(s for s, _ in every)
        got, name = matcher.best(unit)
        if top >= licenses.LEAST:
            assert got == pytest.approx(top) and name in {n for s, n in every if s == pytest.approx(top)}
        else:
            assert got < licenses.LEAST


def test_inheritance(spark):
    mit, gpl, apache = "Released under the MIT License.", licenses.TEMPLATES["GPL-3.0"][0], "Licensed under the Apache License, Version 2.0."
    files = [
        ("LICENSE", f"intro\n{mit}\n"), ("a/COPYING.txt", gpl), ("a/b/c/x.py", "code"), ("a/b/c/y.py", f"# {apache}"), ("ab/z.py", None),
        ("a/b/license.md", "nothing here"), ("q", "top"), (None, "lost"), (None, apache), ("a/b/c/x.py", "code"),
    ]
    df = spark.createDataFrame(files, "path string, text string").withColumn("license", F.lit(1))
    found = licenses.scan_licenses(df)
    assert found.columns == ["path", "own_license", "own_score", "own_licenses", "license", "inherited_from"]
    got = sorted((str(r.path), str(r.license), r.inherited_from) for r in found.collect())
    assert got == sorted([
        ("LICENSE", "MIT", None), ("a/COPYING.txt", "GPL-3.0", None), ("a/b/c/x.py", "GPL-3.0", "a"), ("a/b/c/x.py", "GPL-3.0", "a"), ("a/b/c/y.py", "Apache-2.0", None),
        ("ab/z.py", "MIT", ""), ("a/b/license.md", "GPL-3.0", "a"), ("q", "MIT", ""), ("None", "None", None), ("None", "Apache-2.0", None),
    ], key=lambda r: (r[0], r[1]))
    assert licenses.scan_licenses(df.where("false")).collect() == []


def test_licence_files_wrapped_headers_and_two_licences(spark):
    mit, apache = licenses.TEMPLATES["MIT"][-1], licenses.TEMPLATES["Apache-2.0"][-1]
    header = "\n".join(f" * {part}" for part in (apache[:60], apache[60:]))
    files = [
        (1, "MIT License\n\nCopyright (c) 2020 A B\n\n" + mit.replace("\n", " ").replace(". ", ".\n\n"), "MIT", ["MIT"]),
        (2, "Redistribution notes\n" + licenses.TEMPLATES["BSD-3-Clause"][-1], "BSD-3-Clause", ["BSD-3-Clause"]),
        (3, f"/*\n{header}\n */\n" + "code here;\n" * 2000, "Apache-2.0", ["Apache-2.0"]),
        (4, "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + "terms and conditions\n" * 500, "GPL-3.0", ["GPL-3.0"]),
        (5, "Released under the MIT License.\nmore\nSPDX-License-Identifier: GPL-3.0-only\n", "GPL-3.0", ["GPL-3.0", "MIT"]),
        (6, "word " * 200_000, None, []), (7, "", None, []), (8, None, None, []),
    ]
    df = spark.createDataFrame([(i, t) for i, t, *_ in files], "path long, text string").withColumn("path", F.concat(F.lit("d/f"), "path"))
    odd = df.withColumns({c: F.lit("x") for c in ("lent", "above", "_hot", "_cold", "_dir", "dir", "own_licenses")})
    found = licenses.scan_licenses(odd)
    assert found.columns == ["path", "lent", "above", "_hot", "_cold", "_dir", "dir", "own_license", "own_score", "own_licenses", "license", "inherited_from"]
    got = {int(r.path[3:]): (r.own_license, r.own_licenses) for r in found.collect() if r.lent == r.dir == r._dir == "x"}
    assert got.keys() == {i for i, *_ in files}
    for i, _, best, every in files:
        assert got[i][1] == every and (best is None) == (got[i][0] is None) and (i == 5 or got[i][0] == best), i
