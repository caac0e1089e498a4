"""Steps of the n-gram join: sketches that tell long sets apart, and as many searches for components as there are turns."""

import random

import numpy as np
from test_ngram_join import corpus, plain_join

from chronolith.llm import ngram_join, similar


def test_sketches_tell_long_sets_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(similar, "saved", lambda df: df)
    rng = np.random.default_rng(5)
    some = np.unique(rng.integers(-(1 << 62), 1 << 62, 9000))
    sets = {1: some[:4050], 2: np.concatenate([some[:4000], some[4050:4200]]), 3: some[2000:6100], 4: some[4200:8300], 5: some[:900], 6: some[:1100]}
    nodes = spark.createDataFrame([(k, len(s), similar.sketch(np.unique(s)).tolist()) for k, s in sets.items()], "key bigint, n bigint, bits array<bigint>")
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a bigint, b bigint")
    assert len(similar.sketch(sets[1])) < len(similar.sketch(sets[2])) and len(similar.sketch(sets[5])) < len(similar.sketch(sets[6]))
    assert {tuple(r) for r in similar._near(pairs, nodes).collect()} == {(1, 2), (5, 6)}


def test_one_search_for_components_in_a_turn(documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG_COLUMN", 2)
    monkeypatch.setattr(ngram_join, "HUBS", 2)
    calls = []
    for name in ("components", "_hub_pairs", "_across"):
        monkeypatch.setattr(ngram_join, name, lambda *a, name=name, plain=getattr(ngram_join, name): calls.append(name) or plain(*a))
    docs = list(enumerate(corpus(3)))
    random.Random(3).shuffle(docs)
    found = [str((r.doc_id, r.n_shingles, r.component_id)) for r in ngram_join.join_groups(documents(docs)).collect()]
    assert sorted(found) == plain_join(docs)
    assert calls.count("_hub_pairs") and calls.count("components") <= 2 + calls.count("_hub_pairs") + calls.count("_across")
