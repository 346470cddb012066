"""Language identification, suffix-tree scores and vector search against plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from watttrail.llm import ann, langid, suffix_tree

# --- language identification


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    parts = {"aa": ["ka", "to", "mi", "ra", "su"], "bb": ["sch", "ung", "ein", "ver", "keit"], "cc": ["éa", "oux", "aie", "que", "lle"]}
    rows = []
    for i in range(n):
        lang = sorted(parts)[i % 3]
        words = ["".join(rng.choice(parts[lang], int(rng.integers(1, 4)))) for _ in range(30)]
        rows.append((i, " ".join(words), lang))
    return rows


def test_gradients_match_differences():
    net = langid.Network.start(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    batch = langid.Batch.of([b"abc", b"de", b"\xc3\xa9f"])
    labels = np.array([0, 1, 2])[batch.order]

    def loss():
        prob, _ = net.probabilities(batch)
        rows, steps = np.arange(3)[:, None], np.arange(prob.shape[1])[None, :]
        return -(np.log(prob[rows, steps, labels[:, None]]) * batch.mask).sum() / batch.mask.sum()

    grads = net.gradients(batch, labels)
    for name, at in [("xf", (98, 3)), ("xb", (100, 8)), ("uf", (1, 2)), ("ub", (2, 7)), ("v", (3, 1)), ("c", (2,))]:
        old, step = net.p[name][at], 1e-4
        net.p[name][at] = old + step
        up = loss()
        net.p[name][at] = old - step
        assert (up - loss()) / (2 * step) == pytest.approx(grads[name][at], rel=0.02, abs=2e-5)
        net.p[name][at] = old


def test_language_held_out_accuracy_and_edges(spark):
    rows = corpus(240, 1)
    held = spark.createDataFrame(corpus(90, 2), "doc_id long, text string, truth string")
    net = langid.train(spark.createDataFrame([*rows, (999, None, "aa"), (998, "x", None)], "doc_id long, text string, lang string"))
    assert net.languages == ["aa", "bb", "cc"]
    odd = [(1000, None, ""), (1001, "", ""), (1002, "12 %% -", ""), (1003, "sch" * 5000, "bb"), (1004, "katomi 12 %%", "aa"), (1004, "katomi 12 %%", "aa")]
    both = held.union(spark.createDataFrame(odd, "doc_id long, text string, truth string")).withColumn("score", F.lit("x"))
    got = langid.predict(both, net)
    assert got.columns == ["doc_id", "text", "truth", "lang_pred", "score"]
    found = got.collect()
    assert [(r.lang_pred, r.score) for r in found if 1000 <= r.doc_id <= 1002] == [("und", 0.0)] * 3
    known = [r for r in found if r.truth]
    assert sum(r.lang_pred == r.truth for r in known) / len(known) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    docs = spark.createDataFrame([(1, "katomi " * 20 + "schung einver " * 20), (2, "12 %"), (3, None), (4, "")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in langid.label_spans(docs, net).collect()}
    each = [s.lang for s in spans[1] for _ in range(s.length)]
    assert Counter(each[:140]).most_common(1)[0][0] == "aa" and Counter(each[140:]).most_common(1)[0][0] == "bb"
    assert [s.start for s in spans[1]][1:] == list(np.cumsum([s.length for s in spans[1]]))[:-1] and sum(s.length for s in spans[1]) == 420
    assert [tuple(s) for s in spans[2]] == [(0, 4, "und")] and spans[3] == spans[4] == []


def plain_pass(net, data):
    """Distribution at every byte by the plain equations, one byte at a time over the whole string."""
    def run(octets, d):
        h, out, n = np.zeros(net.hidden), [], net.hidden
        for b in octets:
            x, a = net.p["x" + d][b].astype(float), h @ net.p["u" + d].astype(float)
            z, r = 1 / (1 + np.exp(-(x[:n] + a[:n]))), 1 / (1 + np.exp(-(x[n : 2 * n] + a[n : 2 * n])))
            h = (1 - z) * np.tanh(x[2 * n :] + r * a[2 * n :]) + z * h
            out.append(h)
        return np.array(out)

    states = np.concatenate([run(data, "f"), run(data[::-1], "b")[::-1]], axis=1)
    e = np.exp(states @ net.p["v"] + net.p["c"])
    return e / e.sum(axis=1, keepdims=True)


def test_whole_texts_match_a_plain_pass(monkeypatch):
    net = langid.fit([(t.encode(), lang) for _, t, lang in corpus(60, 3)], epochs=1)
    texts = [t for _, t, _ in corpus(8, 4)] + ["Éa 12 oux", "x", "KATO"]
    found = langid.read_texts(texts, net)
    for text, got, labels in zip(texts, found.probabilities, found.labels, strict=True):
        data = text.encode().lower()
        assert len(data) <= langid.CORE
        prob = plain_pass(net, data)
        letters = [chr(b).isalpha() or b > 127 for b in data]
        assert np.allclose(got, prob[letters].mean(axis=0), atol=2e-3)
        sure = np.sort(prob, axis=1)[:, -1] - np.sort(prob, axis=1)[:, -2] > 0.01
        assert (labels == prob.argmax(axis=1))[sure].all()
    monkeypatch.setattr(langid, "CORE", 40)  # windows that see enough around them change little
    cut = langid.read_texts(texts, net)
    assert np.allclose(cut.probabilities, found.probabilities, atol=0.02)
    assert [len(x) for x in cut.labels] == [len(x) for x in found.labels]
    monkeypatch.setattr(langid, "_WINDOWS_AT_ONCE", 3)
    assert np.allclose(langid.read_texts(texts, net).probabilities, cut.probabilities, atol=1e-6)


def test_training_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "DOCUMENTS", 5)
    rows = [(None, f"text {i}", "aa") for i in range(300)] + [(7, f"word {i}", "bb") for i in range(300)] + [(1, "x", "cc")]
    got = langid.sample_examples(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert Counter(lang for _, lang in got) == {"aa": 5, "bb": 5, "cc": 1}


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    net = langid.train(empty)
    docs = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert [tuple(r)[2:] for r in langid.predict(docs, net).collect()] == [("und", 0.0)]
    assert langid.predict(empty, net).collect() == []


def test_pieces_cover_a_text():
    data = bytes(range(256)) * 5
    assert b"".join(langid.pieces(data)) == data and langid.pieces(b"") == []


# --- suffix tree


def plain_tree(rows, depth):
    """From rows of (id, text, held): per id the scores, and P(w | context), from counts held in memory.

    Written from the model's definition alone; it shares no code with the operator.
    """
    seqs = [(i, ["\n", *(t or "").lower().split(), "\n"], held) for i, t, held in rows]
    train = [s for _, s, held in seqs if not held]
    words = Counter(w for s in train for w in s[1:])
    n, v = sum(words.values()), len(words)
    grams = Counter(tuple(s[i - k : i + 1]) for s in train for k in range(1, depth + 1) for i in range(k, len(s)))
    nexts = {}
    for g, c in grams.items():
        nexts.setdefault(g[:-1], {})[g[-1]] = c

    def count(context):
        return words[context[0]] if len(context) == 1 else grams[context]

    known = {}

    def tested(context):
        """Contexts that occur twice are tested; those over two words also extend a retained and a tested one."""
        return count(context) >= 2 and (len(context) <= 2 or (tested(context[:-1]) and strength(context[1:]) > 0))

    def strength(context):
        if context not in known:
            known[context] = 0.0
            if tested(context):
                c = count(context)
                twice = [(k, 2 ** (-round(-6 * math.log2(prob(context[1:], w))) / 6)) for w, k in nexts.get(context, {}).items() if k >= 2]
                left = c - sum(k for k, _ in twice)
                gains = []
                for a in (1 / 64, 1 / 16, 1 / 4, 1.0, 4.0):
                    gain = sum(k * math.log((k - 1 + a * (c - 1) * p) / ((c - 1) * (1 + a) * p)) for k, p in twice)
                    gains.append((gain + left * math.log(a / (1 + a)), -a))
                best, a = max(gains)
                known[context] = -a if best > 2.0 else 0.0
        return known[context]

    def prob(context, w):
        if not context:
            return (words[w] + 1) / (n + v + 1)
        a, c = strength(context), count(context)
        shorter = prob(context[1:], w)
        return (grams[(*context, w)] + a * c * shorter) / (c * (1 + a)) if a else shorter

    out = {}
    for i, s, _ in seqs:
        score = 0.0
        for k in range(1, len(s)):
            score += math.log10(prob(tuple(s[max(0, k - depth) : k]), s[k]))
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in s[1:])
        out[i] = (len(s) - 1, sum(words[w] > 0 for w in s[1:]), n, base, score)
    return out, max((len(c) for c, a in known.items() if a), default=0)


def docs(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words, 25)) for _ in range(12)]
    rows = []
    for i in range(80):
        text = base[i % 12] if i % 3 else " ".join(rng.choice(words, 12))
        rows.append((i, "The " + text + (" END" if i % 2 else ""), zlib.crc32(str(i).encode()) % 7 == 2))
    return [*rows, (200, None, False), (201, "", True), (202, " \n", False), (203, "unseen words here", True), (3, rows[3][1], rows[3][2])]


def scored(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").withColumn("score", F.lit(1))
    return suffix_tree.score_texts(df, F.col("held")).collect()


@pytest.mark.parametrize("depth", [2, 4])
def test_scores_match_brute_force(spark, depth):
    rows = docs(1)
    unique = {r[0]: r for r in rows}
    want, longest = plain_tree([*unique.values(), (10_000, rows[3][1], rows[3][2])], depth)
    assert longest >= min(depth, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").withColumn("score", F.lit(1))
    got = suffix_tree.score_texts(df, F.col("held"), depth=depth).collect()
    assert len(got) == len(rows)
    for r in got:
        n_tokens, n_known, n, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=1e-5)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_chunks_and_buckets_do_not_change_scores(spark):
    rows = docs(2)
    one = sorted((r.doc_id, round(r.score, 6)) for r in scored(spark, rows))
    assert suffix_tree.HOT * sum(len(suffix_tree.tokens_of(t)) for _, t, _ in rows) < 2.1  # so all contexts are hot
    plain = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    none_hot = suffix_tree.score_texts(plain, F.col("held"), hot_share=1.0)
    assert sorted((r.doc_id, round(r.score, 6)) for r in none_hot.collect()) == one
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(7)
    again = sorted((r.doc_id, round(r.score, 6)) for r in suffix_tree.score_texts(df, F.col("held")).collect())
    assert one == again


def test_sorted_places():
    rng = np.random.default_rng(0)
    for top in (5, 1 << 40, 1 << 62):
        key = rng.integers(0, top, 500)
        one, number = suffix_tree._distinct(key)
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        assert (one == first).all() and (number == inverse).all()
        assert (suffix_tree._order(key) == np.argsort(key, kind="stable")).all()


def test_packing_of_arrays():
    for kind in ("<u4", "<u8", "u1", "<f4"):
        values = np.arange(1000).astype(kind)
        assert (suffix_tree._unpack(suffix_tree._pack(values), kind) == values).all()
    assert len(suffix_tree._unpack(suffix_tree._pack(np.zeros(0, "<u4")), "<u4")) == 0


def test_empty_and_all_held_out(spark):
    assert scored(spark, []) == []
    only = scored(spark, [(1, "a b", True)])
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in only] == [(3, 0, 0, 0.0)]


# --- vector search


def test_multi_index_retrieves_the_whole_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (300, 4), dtype=np.uint8)
    queries = codes[:20] ^ (rng.random((20, 4)) < 0.2).astype(np.uint8)
    padded = [np.concatenate([x, np.zeros((len(x), 4), np.uint8)], axis=1) for x in (codes, queries)]
    index = ann.MultiIndex(padded[0])
    for radius in (0, 3, 5, 9, 12):
        near = ann._distances(padded[1], padded[0]) <= radius
        got = list(index.within(padded[1], radius))
        assert all((np.flatnonzero(row) == g).all() for row, g in zip(near, got, strict=True))


def test_neighbours_and_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(600 + i, x[40].tolist()) for i in range(5)]  # ties
    bad = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] + [1.0] * 15), (1060, [None] + [1.0] * 15), (1080, [float("inf")] * 16), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit(0))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=10).collect()
    ids, data = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    truth, queries = set(), [i for i in ids if i % 20 == 0]
    for q in queries:
        score = data @ data[q]
        score[ids == q] = -np.inf
        truth |= {(q, int(ids[j])) for j in np.lexsort((ids, -score))[:10]}
    assert len(got) == 10 * len(queries)
    assert ann.recall(((r.query_id, r.vec_id) for r in got), truth) >= 0.9
    for r in got:
        assert r.score == pytest.approx(float(data[r.query_id] @ data[r.vec_id]), abs=1e-12)
    ties = [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 40][:5]
    assert ties == [600, 601, 602, 603, 604]
    few = ann.nearest(df.where("vec_id < 4"), F.lit(True), k=10).collect()
    assert len(few) == 12
    assert ann.nearest(df.where("false"), F.lit(True)).collect() == []
