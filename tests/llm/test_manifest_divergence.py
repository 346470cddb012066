"""Manifest and divergence against plain versions on small tables."""

import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest

from watttrail.llm.divergence import count_terms, divergence
from watttrail.llm.manifest import manifest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(*fields):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree_paths(leaves):
    """The root, and for each leaf the nodes left and right of it, level by level."""
    paths, at, level = [[] for _ in leaves], [*range(len(leaves))], [*leaves]
    while len(level) > 1:
        for i, pos in enumerate(at):
            lo = pos - pos % 16
            paths[i].append((level[lo:pos], level[pos + 1 : lo + 16]))
        at = [pos // 16 for pos in at]
        level = [digest("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
    return level[0], paths


def lowered(text):
    return None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_manifest(rows):
    groups, out = {}, []
    for key, text, lang, source, n in rows:
        groups.setdefault(source, []).append((key is not None, key or 0, leaf_of(key, source, lang, n, text), (key, text, lang, source, n)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree_paths([leaf for _, _, leaf, _ in sorted(groups[s], key=lambda x: x[:3])]) for s in names]
    root, above = tree_paths([t[0] for t in trees])
    for name, (subroot, paths), upper in zip(names, trees, above, strict=True):
        for (_, _, leaf, (key, text, lang, source, n)), path in zip(sorted(groups[name], key=lambda x: x[:3]), paths, strict=True):
            way = path + upper
            proof = digest("".join("".join(a + b) for a, b in way))
            own = leaf
            if key is not None and zlib.crc32(str(key).encode()) % 5 == 0:
                own = leaf_of(key, source, lang, n, lowered(text))
            for a, b in way:
                own = digest("".join(a) + own + "".join(b))
            out.append((str(key), leaf, subroot, root, proof, own, own == root))
    return sorted(out)


def plain_divergence(rows, least=3, top=200):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text or "")))) for _, text, lang, source, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, c in own for t in c)
        kept = [t for t, n in seen.items() if n >= least]

        def shares(groups, kept=kept):
            total = sum(c[t] for c in groups for t in kept)
            return {t: 1 + 10**9 * (sum(c[t] for c in groups) + 1) // (total + len(kept)) for t in kept}

        q = shares([c for _, _, c in own])
        sources = sorted({s for _, s, _ in own})
        p = {s: shares([c for _, o, c in own if o == s]) for s in sources}
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            has = {t for _, o, c in own if o == s for t in c}
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if t in has and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def made(n):
    names = [None, "", "web", "Books", "é", "zz"]
    words = ["Tree", "leaf", "ROOT", "äpfel", "x1y", "of", "the", "only" * 3, "日本"]
    rows = []
    for i in range(n):
        text = None if i % 23 == 0 else " ".join(words[(i * k) % (9 - i % 3)] for k in range(1, 2 + i % 40))
        rows.append((i, text, [None, "aa", "bb"][i % 3], "web" if i % 2 else names[i % 6], None if i % 11 == 0 else i))
    return rows


ROWS = made(700) + [(900, "Tree", None, "alone", 4), (901, "", "cc", "only", 0), (901, "", "cc", "only", 0), (None, "A b", "aa", "web", 3), (902, "Long word " * 20_000, "aa", "web", 9)]


def table_of(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).selectExpr("*", "5 as pos", "'x' as g", "'y' as digest", "'z' as Term", "7 as n", "8 as size", "9 as c0")


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], made(17), made(2)])
def test_manifest_matches_a_plain_tree(spark, rows):
    got = manifest(table_of(spark, rows).repartition(3))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == plain_manifest(rows)


def test_divergence_matches_plain_sums(spark):
    got = divergence(table_of(spark, ROWS).repartition(3))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(ROWS)


def test_few_terms_are_ranked_and_ties_go_by_item(spark):
    rows = [(i, "one two three four" if i % 2 else "one five six", "aa", f"s{i % 4}", 1) for i in range(40)]
    got = divergence(table_of(spark, rows), top=2)
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(rows, top=2)


def test_empty_tables_and_terms(spark):
    empty = table_of(spark, ROWS[:1]).where("false")
    assert manifest(empty).collect() == divergence(empty).collect() == []
    assert count_terms("aB-c Äß\x00d3e".encode()) == {b"ab": 1, b"c": 1, "Äß".encode(): 1, b"d": 1, b"e": 1}
