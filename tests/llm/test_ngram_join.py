"""The n-gram Jaccard join against brute force."""

import random

import numpy as np
import pytest
from conftest_llm import EDGES, LARGE
from test_similar import plain_set

from chronolith.llm import ngram_join, registry


def plain_join(docs):
    """(doc_id, n, component) as sorted text; ids may repeat or be null."""
    sets = [plain_set(ascii_lower(t)) for _, t in docs]
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return sorted(str((d, len(sets[i]), least.get(top(i)) if sets[i] else d)) for i, (d, _) in enumerate(docs))


def ascii_lower(text):
    """A-Z alone in lower case, and the six ASCII spaces alone as spaces."""
    words = (text or "").encode().lower().split()
    return b" ".join(words).decode("latin-1").replace("\x85", "\x84").replace("\xa0", "\xa1").replace("\x1c", "\x1b").replace("\x1d", "\x1b").replace("\x1e", "\x1b").replace("\x1f", "\x1b")


def corpus(seed, families=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(families):
        words = rng.choices(vocabulary, k=rng.randint(1, 120))
        for _ in range(rng.choice([1, 3, 9])):
            copy = list(words)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
            words = copy if rng.random() < 0.3 else words
    page = rng.choices(vocabulary, k=60)  # a passage that makes up most of texts that are not alike
    texts += [" ".join(page + rng.choices(vocabulary, k=rng.randint(0, 24))) for _ in range(30)]
    base = rng.choices(vocabulary, k=90)  # sets inside each other, near the bound of sizes
    texts += [" ".join(base[:k]) for k in range(60, 91, 3)]
    return texts + ["One two", "one TWO", "one two three four", "Ünï cödé", "ünï cödé"]


@pytest.mark.parametrize(("long_column", "seed"), [(24, 1), (2, 2)])
def test_equal_to_brute_force(documents, monkeypatch, long_column, seed):
    monkeypatch.setattr(ngram_join, "LONG_COLUMN", long_column)
    monkeypatch.setattr(ngram_join, "HUBS", 2)
    monkeypatch.setattr(ngram_join, "COLUMN_BLOCK", 16)
    monkeypatch.setattr(ngram_join, "ROW_BLOCK", 8)
    docs = list(enumerate(corpus(seed)))
    random.Random(seed).shuffle(docs)
    found = [str((r.doc_id, r.n_shingles, r.component_id)) for r in ngram_join.join_groups(documents(docs)).collect()]
    assert sorted(found) == plain_join(docs)
    assert len({f.rsplit(",", 1)[1] for f in found}) < len(docs) - 10


def test_edge_rows_and_registered_query(spark, documents, tmp_path):
    docs = EDGES + LARGE + [(None, "a text of a null id"), (None, "a text of a null id"), (40, "a text of a null id"), (41, " "), (42, ""), (43, "no id at all"), (9, None)]
    documents(docs).write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.queries()["op11_ngram_join"](spark, str(tmp_path)).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in found) == plain_join(docs)
    assert ngram_join.join_groups(documents(docs).limit(0)).count() == 0


def test_product_counts_shared_columns():
    rng = np.random.default_rng(3)
    matrix = rng.random((30, 200)) < 0.1
    a, b, shared = ngram_join.multiply([np.flatnonzero(matrix[:, c]) for c in range(200)])
    whole = matrix.astype(int) @ matrix.T.astype(int)
    assert {(i, j, n) for i, j, n in zip(a, b, shared)} == {(i, j, whole[i, j]) for i in range(30) for j in range(i + 1, 30) if whole[i, j]}
