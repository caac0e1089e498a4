"""Near-duplicates of the pipeline: five-word shingles at similarity 0.8 or more, against brute force."""

import random

import pytest

from chronolith.llm import similar, simhash


def plain_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(docs):
    sets = [plain_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return {(doc_id, least[top(i)]) for i, (doc_id, _) in enumerate(docs)}


@pytest.mark.parametrize("long_list", [24, 2])
def test_groups_equal_brute_force(documents, monkeypatch, long_list):
    monkeypatch.setattr(similar, "LONG_LIST", long_list)
    monkeypatch.setattr(similar, "HUBS", 2)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        words = rng.choices(vocabulary, k=rng.randint(3, 120))
        for _ in range(rng.choice([1, 3, 9])):
            copy = list(words)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
            words = copy if rng.random() < 0.3 else words
    page = rng.choices(vocabulary, k=60)  # a passage that makes up most of texts that are not alike
    texts += [" ".join(page + rng.choices(vocabulary, k=rng.randint(0, 24))) for _ in range(30)]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    found = {(r.doc_id, r.component_id) for r in similar.groups(documents(docs)).collect()}
    wanted = plain_groups(docs)
    assert found == wanted and 0 < sum(a != b for a, b in wanted) < len(docs) - 5
    if long_list == 24:
        assert {r.doc_id for r in simhash.keep_first(documents(docs)).collect()} == {b for _, b in wanted}
