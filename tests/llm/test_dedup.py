"""Substring and suffix dedup, near-duplicates and their components, against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from conftest_llm import EDGES

from chronolith.llm import components, repeats, simhash, substrings, suffixes

WORDS = [f"w{i}" for i in range(400)]


def texts(seed, n=40):
    """Random texts that share passages, with exact and near copies."""
    rng = random.Random(seed)
    passages = [" ".join(rng.choices(WORDS, k=rng.randint(30, 90))) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 80)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), rng.choice([" ", "\n", "\t "]), " ".join(rng.choices(WORDS, k=rng.randint(0, 20)))]
        out.append(" ".join(parts))
    return out + out[:5] + [out[0] + " end", "a " * 200, "ab" * 300, "ab" * 250, "ab" * 250 + "c"]


def brute_words(docs, size=50):
    first = {}
    for i, t in sorted((i, (t or "").encode().split()) for i, t in docs):
        for k in range(len(t) - size + 1):
            first.setdefault(tuple(t[k : k + size]), i)
    out = {}
    for i, t in docs:
        words = (t or "").encode().split()
        gone = np.zeros(len(words), bool)
        for k in range(len(words) - size + 1):
            if first[tuple(words[k : k + size])] < i:
                gone[k : k + size] = True
        out[i] = (len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def brute_bytes(docs, size=100):
    seen, out = set(), {}
    for i, t in sorted(docs):
        body = (t or "").encode()
        gone = np.zeros(len(body), bool)
        for k in range(len(body) - size + 1):
            if body[k : k + size] in seen:
                gone[k : k + size] = True
            seen.add(body[k : k + size])
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(body), int(gone.sum()), runs, np.frombuffer(body, np.uint8)[~gone].tobytes())
    return out


def test_substrings(documents):
    docs = list(enumerate(texts(1)))
    found = {r.id: (r.n_words, r.n_removed, bytes(r.kept)) for r in substrings.repeated_words(documents(docs)).collect()}
    assert found == brute_words(docs) and sum(r[1] for r in found.values()) > 500


@pytest.mark.parametrize("merged", [4000, 3, 1])
def test_suffixes(documents, monkeypatch, merged):
    monkeypatch.setattr(suffixes, "MERGED", merged)  # 3, 1: shared anchors are dealt over parts
    docs = list(enumerate(texts(2)))
    found = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.repeated_bytes(documents(docs)).collect()}
    assert found == brute_bytes(docs)


def test_edges(documents):
    word = {(r.id, r.n_words): r for r in substrings.repeated_words(documents(EDGES)).collect()}
    assert len(substrings.repeated_words(documents(EDGES)).collect()) == len(EDGES)
    assert word[(1, 0)].n_removed == 0 and word[(6, 60_000)].n_removed == 0
    found = suffixes.repeated_bytes(documents(EDGES)).collect()
    assert len(found) == len(EDGES)
    by_id = {r.id: r for r in found}
    assert by_id[1].n_bytes == 0 and by_id[6].n_removed == by_id[6].n_bytes - 10 and by_id[8].n_removed == 50_000 - 1 and by_id[None].n_removed == 0
    assert substrings.repeated_words(documents([])).count() == 0 and suffixes.repeated_bytes(documents([])).count() == 0


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for alphabet in ("a", "ab", "abcd"):
        parts = ["".join(rng.choices(alphabet, k=rng.randint(5, 60))).encode() for _ in range(8)]
        joined = b"\0".join(parts)
        text = np.frombuffer(joined, np.uint8).astype(np.uint16) + 1
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        begins = ends - [len(p) for p in parts]
        text[ends[:-1]] = 0
        order = suffixes.suffix_array(text)
        plain = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert order.tolist() == plain
        steps = np.array([max(0, len(p) - 4) for p in parts])
        found = suffixes.common_prefixes(joined, begins, ends, steps, order, 5)
        place = {p: k for k, p in enumerate(plain)}
        for b, e, s in zip(begins, ends, steps, strict=True):
            for i in range(b, b + s):
                k = place[i]
                j = plain[k - 1] if k else None
                shared = 0
                while j is not None and shared < 5 and i + shared < e and j + shared < len(text) and text[i + shared] == text[j + shared]:
                    shared += 1
                assert found[i] == shared


def test_shards_of_one_anchor_are_merged(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 300)
    rng = random.Random(5)
    common = bytes(rng.choices(b"xyz", k=40))
    bodies = [bytes(rng.choices(b"ab", k=rng.randint(0, 2))) + common + bytes(rng.choices(b"ab", k=rng.randint(0, 2))) for _ in range(30)]
    rows = [(1, k, k % 7, 10 * k, b) for k, b in enumerate(bodies)]
    frame = spark.createDataFrame(rows, "g bigint, rid bigint, id bigint, l int, content binary")
    found = {r.rid: {w for x in r.s for w in range(x >> 32, (x & 0xFFFFFFFF) + 1)} for r in suffixes._earlier_starts(frame, 40).collect()}
    first = {}
    for _, k, i, at, b in rows:
        for w in range(len(b) - 39):
            first[b[w : w + 40]] = min(first.get(b[w : w + 40], (99, 0)), (i, at + w))
    plain = {k: {w for w in range(len(b) - 39) if first[b[w : w + 40]] < (i, at + w)} for _, k, i, at, b in rows}
    assert found == {k: w for k, w in plain.items() if w}


def test_runs_cover_all_windows_and_agree(monkeypatch):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    for block in (1 << 23, 256):
        monkeypatch.setattr(repeats, "BLOCK", block)
        first, last, anchor = repeats.runs(repeats.mix(repeats.rolled(h, 8)), 50, 8)
        assert first[0] == 0 and last[-1] == 3000 - 50 and (first[1:] == last[:-1] + 1).all()
        grams = repeats.mix(repeats.rolled(h, 8))
        for a, b, g in zip(first, last, anchor, strict=True):
            assert (grams[a : a + 43].min() >> np.uint64(24)) == (g >> np.uint64(24)) and (grams[b : b + 43].min() >> np.uint64(24)) == (g >> np.uint64(24))


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(documents):
    docs = list(enumerate(texts(4, 10))) + [(100 + k, t) for k, (_, t) in enumerate(EDGES)]
    found = {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(documents(docs)).collect()}
    assert found == {i: plain_fingerprint(t) for i, t in docs} and found[100] == 0


@pytest.mark.parametrize("long_list", [24, 2])
def test_links_are_complete(spark, monkeypatch, long_list):
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)  # 2: all posting lists but pairs go through middle points
    rng = random.Random(6)
    values = [0, (1 << 64) - 1]
    for _ in range(12):
        x = rng.getrandbits(64)
        values += [x, *(x ^ (1 << rng.randrange(64)) for _ in range(4)), x ^ 7, x ^ (3 << 62), x ^ (1 << 63) ^ 1]
    values = sorted(set(values))
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp bigint")
    found = {tuple(sorted((r.a, r.b))) for r in simhash.links(frame).collect()}
    true = {tuple(sorted(map(simhash._signed, (a, b)))) for k, a in enumerate(values) for b in values[:k] if (a ^ b).bit_count() <= 2}
    assert found <= true

    def classes(edges):
        root = {simhash._signed(v): simhash._signed(v) for v in values}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = sorted((top(a), top(b)))
            root[b] = a
        return {x: top(x) for x in root}

    assert classes(found) == classes(true)
    reached = {r.node: r.root for r in components.components(simhash.links(frame)).collect()}
    assert {x: reached.get(x, x) for x in classes(true)} == classes(true)


def test_components_of_a_long_chain(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    frame = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(100, 101), (101, 101)], "a bigint, b bigint")
    assert {r.node: r.root for r in components.components(frame).collect()} == dict.fromkeys(range(60), 0) | {100: 100, 101: 100}


def test_near_duplicates_and_the_first_of_each(documents):
    docs = EDGES + [(20, "one two three four five six seven"), (21, "one two three four five six seven"), (22, "ONE two  three four five six seven")]
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(documents(docs)).collect()}
    assert {(20, 20), (21, 20), (22, 20), (1, 1), (2, 1), (3, 1), (7, 7)} <= found
    frame = documents(docs)
    kept = simhash.keep_first(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 7, 8, 20]
    assert simhash.near_duplicates(documents([])).count() == 0
