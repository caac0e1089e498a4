"""The registered queries and corpus_pipeline.run as a whole, against plain Python over small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest_llm import EDGES
from test_dedup import brute_bytes, brute_words, plain_fingerprint, texts
from test_placement import plain_jump
from test_similar import plain_groups
from test_text import RANKS, TOKENIZER, plain_overlaps, plain_spans

import corpus_pipeline
from chronolith.llm import registry

KINDS = ("email", "ip", "card", "phone")
VALUES = ["write to a.b@c.example or 10.0.0.256 or 10.0.0.25", "card 4111 1111 1111 1111, call +1 (555) 123-4567", "é🎉 x@y.zz 8.8.8.8.8"]
#: Shared passages, copies, personal data and edge rows; every id once, so that plain versions can go by id.
DOCS = list(enumerate(texts(9, 25) + VALUES + [t for i, t in EDGES if i not in (6, 7, 8)] + ["long text " * 3_000, "Mixed CASE words here", "mixed case WORDS here"]))


def digest(body):
    return hashlib.sha256(body).hexdigest()


@pytest.fixture
def answer(spark, documents, tmp_path):
    """Rows of a registered query over DOCS, by doc_id."""
    documents(DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in DOCS], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    def rows(name):
        found = registry.queries()[name](spark, str(tmp_path)).collect()
        assert len(found) == len(DOCS)
        return {r.doc_id: r for r in found}

    return rows


def test_op1(answer):
    found = answer("op1_pii")
    for i, t in DOCS:
        spans = sorted(plain_spans(t or ""))
        joined = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
        r = found[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, _, _ in spans) for n in range(4))
        assert r.base_sha256 == digest(joined.encode()) and r.spans.startswith(joined) and r.spans.count(":") == 2 * (len(spans) + r.n_term)
    assert sum(r.n_email for r in found.values()) == 2


def test_op3_and_op5(answer):
    plain = brute_bytes(DOCS)
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in answer("op3_suffix_dedup").items()} == {i: (*p[:3], digest(p[3])) for i, p in plain.items()}
    plain = brute_words(DOCS)
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in answer("op5_substring_dedup").items()} == {i: (*p[:2], digest(p[2])) for i, p in plain.items()}


def test_op2_and_op4(answer):
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in DOCS}
    for i, r in answer("op2_toxicity").items():
        assert r.held_out == held[i] and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    for i, r in answer("op4_language").items():
        assert r.held_out == held[i] and 0 <= r.score <= 1 and r.lang_pred == ("en" if any(c.isalpha() for c in dict(DOCS)[i] or "") else "und")


def test_op6(answer):
    found = answer("op6_byte_bpe")
    for i, t in DOCS:
        ids = TOKENIZER.encode_ordinary(t or "")
        r = found[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(np.array(ids, "<u4").tobytes()), digest((t or "").encode())) and len(RANKS)


def test_op8(answer):
    prints = {i: plain_fingerprint(t) for i, t in DOCS}
    least = {i: i for i in prints}
    for _ in DOCS:  # each pass hands on the smallest id along every link
        least = {i: min(least[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2) for i in prints}
    assert {i: (r.fingerprint, r.component_id) for i, r in answer("op8_simhash").items()} == {i: (f"{p:016x}", least[i]) for i, p in prints.items()}


def test_op10(answer):
    found = answer("op10_jump_sharding")
    for i, t in DOCS:
        body, r = (t or "").encode(), found[i]
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len(body) + 8, zlib.crc32(body), "key", plain_jump(i, 24), plain_jump(i, 25))
    for s in range(24):
        held = sorted(r.slot for r in found.values() if r.shard == s)
        assert held == list(range(len(held)))


def plain_clean(text):
    at, parts = 0, []
    for a, b, kind in sorted((a, b, f"[{KINDS[k].upper()}]") for k, a, b in plain_spans(text)):
        if a >= at:
            parts += [text[at:a], kind]
        at = max(at, b)
    return "".join(parts) + text[at:]


def test_pipeline_equals_plain_stages(spark, documents, tmp_path):
    """Toxic words that labels tell apart, copies at 0.8 and below, whole and changed benchmark items, values that stand once."""
    rng = random.Random(17)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(500):
        body = rng.choices(words, k=40)
        if i % 5 == 0:
            body[rng.randrange(40)] = rng.choice(["grobnik", "zwivel"])
        if i % 7 == 1:
            body.insert(rng.randrange(40), f"user{i}@host{i}.example")
        docs.append((i, " ".join(body)))
        labels.append((i, 1, int(i % 5 == 0)))
    items = [(j, " ".join(rng.choices(words, k=rng.randint(10, 30)))) for j in range(4)]
    for k in range(24):  # near copies with one to five changed words, and leaks with every sixth word changed
        body = docs[5 * k + 1][1].split()
        for at in rng.sample(range(len(body)), k % 6):
            body[at] = "changed"
        leak = [("other" if k % 2 and n % 6 == 5 else w) for n, w in enumerate(items[k % 4][1].split())]
        docs += [(1000 + 2 * k, " ".join(body)), (1001 + 2 * k, " ".join(rng.choices(words, k=9) + leak + rng.choices(words, k=9)))]
    docs += [(2000, None), (2001, ""), (2002, "日本語 🎉"), (2003, "Word")]
    rng.shuffle(docs)
    documents(docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    civil = [(i, t) for i, t in docs if not {"grobnik", "zwivel"} & set((t or "").split())]
    firsts = {least for _, least in plain_groups(civil)}
    single = [(i, t) for i, t in civil if i in firsts]
    leaked = {i for i, _ in plain_overlaps(single, items)}
    wanted = {}
    for i, t in single:
        if i not in leaked:
            text = plain_clean(t or "")
            wanted[i] = (np.array(TOKENIZER.encode_ordinary(text), "<u4").tobytes(), digest(text.encode()))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (bytes(r.ids), r.decoded_sha256) for r in found} == wanted and len(found) == len(wanted)
    assert len(docs) > len(civil) > len(single) > len(wanted) and len(leaked) >= 24 and all(4 * r.n_tokens == len(r.ids) for r in found)
