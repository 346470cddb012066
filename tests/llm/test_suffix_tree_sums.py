"""Suffix-tree probabilities over the vocabulary and one unknown word sum to 1, and scores are made of them."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import docs

from watttrail.llm import suffix_tree

UNKNOWN = b"never seen"


class Brute:
    """Counts of all contexts in memory; the formula applied to every next word of every context."""

    def __init__(self, rows, depth):
        self.depth = depth
        train = [[b"\n", *suffix_tree.tokens_of(t)] for _, t, held in rows if not held]
        self.words = Counter(w for s in train for w in s[1:])
        self.n = sum(self.words.values())
        self.next = {}
        for s in train:
            for i in range(1, len(s)):
                for k in range(1, min(depth, i) + 1):
                    self.next.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
        self.strengths = {}

    def strength(self, s):
        if s not in self.strengths:
            total = sum(self.next[s].values())
            pairs = [(c, self.prob(s[1:], w)) for w, c in self.next[s].items()]
            coarse = 2.0 ** (suffix_tree._coarse(np.array([p for _, p in pairs])) / -6.0)
            gain, covered = suffix_tree.gains(np.array([float(c) for c, _ in pairs]), np.full(len(pairs), float(total)), coarse, np.zeros(len(pairs), int), 1)
            self.strengths[s] = float(suffix_tree.best_strength(gain, covered, np.array([float(total)]))[0])
        return self.strengths[s]

    def prob(self, s, w):
        if not s:
            return (self.words[w] + 1) / (self.n + len(self.words) + 1)
        parent, total = self.prob(s[1:], w), sum(self.next.get(s, Counter()).values())
        a = self.strength(s) if total >= 2 else 0.0
        return (self.next[s][w] + a * total * parent) / (total * (1 + a)) if a else parent

    def score(self, text):
        s = [b"\n", *suffix_tree.tokens_of(text)]
        return sum(math.log10(self.prob(tuple(s[max(0, i - self.depth) : i]), s[i])) for i in range(1, len(s)))


def rows_of(seed):
    rows = list({r[0]: r for r in docs(seed)}.values())
    rng = np.random.default_rng(seed)
    for i in range(40):  # rare words in and after repeated passages, taught and held out
        words = rows[int(rng.integers(80))][1].split()
        words[int(rng.integers(len(words)))] = f"rare{int(rng.integers(25))}"
        rows.append((300 + i, " ".join(words), i % 3 == 0))
    return rows


@pytest.mark.parametrize("hot_share", [suffix_tree.HOT, 1.0])
@pytest.mark.parametrize("parts", [1, 7])
def test_scores_are_of_a_normalised_model(spark, parts, hot_share):
    rows = rows_of(3)
    brute = Brute(rows, suffix_tree.DEPTH)
    retained = [s for s, c in brute.next.items() if sum(c.values()) >= 2 and brute.strength(s)]
    assert {len(s) for s in retained} == set(range(1, suffix_tree.DEPTH + 1))
    for s in retained:
        assert sum(brute.prob(s, w) for w in [*brute.words, UNKNOWN]) == pytest.approx(1, rel=1e-9)
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(parts)
    got = {r.doc_id: r.score for r in suffix_tree.score_texts(df, F.col("held"), hot_share=hot_share).collect()}
    assert got == pytest.approx({i: brute.score(t) for i, t, _ in rows}, rel=1e-5)
