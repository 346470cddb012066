"""The corpus pipeline, stage by stage against plain versions, and whole."""

import corpus_pipeline
import numpy as np
from test_dedup_and_shards import brute_keep
from test_models import corpus
from test_shingle_dedup import grams, jaccard
from test_text_tools import check_pieces

from watttrail.llm import langid
from watttrail.session import new_path


def documents(spark):
    rng = np.random.default_rng(5)
    rows = corpus(150, 7)
    rows += [(200 + i, t.replace(" ", "  "), lang) for i, t, lang in rows[:12]]
    for i, t, lang in rows[:9]:
        long = " ".join([t] * 12).split(" ")
        changed = [*long]
        changed[int(rng.integers(len(long)))] = "changed"
        rows += [(300 + i, " ".join(long), lang), (400 + i, " ".join(changed), lang)]
    rows += [(500, None, "aa"), (501, "", None), (502, "12 34 %", "bb"), (503, "katomi sura", None)]
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")


def brute_kept(texts):
    """Least ids of the components of all pairs with a five-word Jaccard similarity of 0.8 or more."""
    label, sets = {i: i for i in texts}, {i: grams(t) for i, t in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    for _ in texts:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return set(label.values())


def test_pipeline(spark):
    docs = documents(spark)
    path = new_path(spark, "pipeline-test")
    docs.write.parquet(f"{path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert [*steps] == ["language", "exact", "near", "pack"]

    spoken = steps["language"](spark, docs, path)
    assert spoken.columns == docs.columns
    net = langid.train(docs)
    given = {r.doc_id: r.text for r in docs.collect()}
    prob = langid.document_probabilities([*given.values()], net).max(axis=1)
    want = {i for i, p in zip(given, prob, strict=True) if p >= corpus_pipeline.LEAST_SCORE}
    got = {r.doc_id for r in spoken.collect()}
    assert got == want and not {500, 501, 502} & got and set(range(150)) <= got

    once = steps["exact"](spark, spoken, path)
    rows = [(r.doc_id, r.text) for r in spoken.collect()]
    verdict, groups = brute_keep(rows)
    assert once.columns == docs.columns
    kept = {r.doc_id for r in once.collect()}
    assert kept == {int(i) for i, keep, _, _ in verdict if i == keep} and len(kept) == groups

    far = steps["near"](spark, once, path)
    assert far.columns == docs.columns
    assert {r.doc_id for r in far.collect()} == brute_kept({i: given[i] for i in kept})

    final = corpus_pipeline.run(spark, path).collect()
    check_pieces(final, {r.doc_id: r.text for r in far.collect()})


def test_near_stage_runs_simhash_blocks(spark, monkeypatch):
    from watttrail.llm import simhash

    proposed, components = [], simhash.components

    def seen(rows, *more):
        proposed.append(components(rows, *more))
        return proposed[-1]

    monkeypatch.setattr(simhash, "components", seen)
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(1, text), (2, text + " x"), (3, "a b c d e f"), (4, None), (5, "")]
    kept = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4, 5}
    # the operator of op9 links the first two, and the wordless, which the exact similarity tells apart
    assert len(proposed) == 1 and len({r.component for r in proposed[0].collect()}) == 3
