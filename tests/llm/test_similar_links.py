"""Links of the pipeline's near-duplicates: as few as join the groups, and no join by shingle between groups that are not alike."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_similar import plain_groups

from chronolith.llm import ngram_join, similar


def test_links_grow_with_the_rows_of_a_group(documents, monkeypatch):
    kept = []
    plain = similar.components
    monkeypatch.setattr(similar, "components", lambda edges: kept.append(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().count()) or plain(edges))
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(words[: rng.randrange(len(words))] + [f"x{i}"] + words)) for i in range(3)]
    docs += [(10 + i, " ".join([*words, f"y{i}"])) for i in range(20)]  # alike, every two of them
    found = {(r.doc_id, r.component_id) for r in similar.groups(documents(docs)).collect()}
    assert found == plain_groups(docs) and kept[0] <= 2 * len(docs)


def test_long_lists_of_unlike_texts_meet_in_blocks(documents, monkeypatch):
    monkeypatch.setattr(similar, "LONG_LIST", 4)
    monkeypatch.setattr(similar, "HUBS", 2)
    monkeypatch.setattr(similar, "_frequent", lambda source: np.zeros(0, np.int64))  # no order: the page's shingles lead too
    tiles = []
    plain = ngram_join._across
    monkeypatch.setattr(ngram_join, "_across", lambda *a: tiles.append(1) or plain(*a))
    rng = random.Random(4)
    page = [f"p{i}" for i in range(40)]  # most of every text, but not enough of it
    docs = [(i, " ".join([*page, *(f"z{i // 2}_{k}" for k in range(rng.randint(14, 16)))])) for i in range(40)]
    found = {(r.doc_id, r.component_id) for r in similar.groups(documents(docs)).collect()}
    assert found == plain_groups(docs) and tiles
