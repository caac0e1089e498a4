"""Personal data, toxicity, language, tokens and benchmark leaks."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest_llm import EDGES

from chronolith.llm import bpe, decontamination, language, pii, toxicity

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    rng = random.Random(1)
    for alphabet in ("12 5.+@-(a4", "0123456789 -", "ab.@-_", "25.0"):
        for _ in range(3000):
            text = "".join(rng.choices(alphabet, k=40))
            assert pii.base_spans(text) == plain_spans(text), text
    text = "é x@y.zz 4111 1111 1111 1111 +1 (555) 123-4567 or 1.2.3.256 10.0.0.1"
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [(0, "x@y.zz"), (1, "10.0.0.1"), (2, "4111 1111 1111 1111"), (3, "+1 (555) 123-4567")]
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []


def test_revealing_terms_and_sanitising(documents):
    filler = [f"common words stand in text number {i} of many" for i in range(300)]
    secret = [f"please ask falconer at boss@corp.example for item {i} common words" for i in range(8)]
    docs = documents(filler + secret)
    found = {r["__id"]: r for r in pii.find_personal_data(docs).collect()}
    assert all(not found[i]["__base"] and not found[i]["__terms"] for i in range(300))
    text = secret[0]
    assert [text[x.start : x.stop] for x in found[300]["__terms"]] == ["ask", "falconer"] or "falconer" in [text[x.start : x.stop] for x in found[300]["__terms"]]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[5] == filler[5] and "[EMAIL]" in clean[300] and "falconer" not in clean[300] and "common words" in clean[300]
    assert pii.sanitise(docs).columns == docs.columns


def test_pii_edges(documents):
    docs = documents(EDGES)
    assert pii.find_personal_data(docs).count() == len(EDGES)
    clean = pii.sanitise(docs)
    assert sorted((r.doc_id or -1, r.text or "") for r in clean.collect()) == sorted((i or -1, t or "") for i, t in EDGES) and clean.where("text IS NULL").count() == 1
    assert pii.find_personal_data(documents([])).count() == 0 and pii.sanitise(documents([])).count() == 0


def test_folding():
    assert toxicity.fold("Y0u 1D1OT!") == toxicity.fold("you idiot") and toxicity.fold("id​iоt") == toxicity.fold("idiot") and toxicity.fold("c1own") == toxicity.fold("clown") and toxicity.fold("tr@sh!!") == toxicity.fold("trash")
    assert toxicity.fold("") == toxicity.fold("  ") == "  "


def test_lexicon_matches_words_prefixes_and_exceptions():
    lexicon = toxicity.Lexicon({toxicity.fold("trash"): 2.0, f" {toxicity.fold('grum').strip()}": 1.0, toxicity.fold("grumble"): 3.0}, [toxicity.fold("trash can")], (0.0, 1.0, 1.0, 1.0))
    assert sorted(lexicon.matches(toxicity.fold("Trash trashy grumpy grumble the trash can")).values()) == [1.0, 2.0, 3.0]
    assert lexicon.score("trash") > lexicon.score("trash " + "word " * 500) > lexicon.score("word") == 0.5


def labelled(spark, documents, n=600):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        body = rng.choices(words, k=30) + (["grobnik", "5natch"] if toxic and i % 2 else ["zwivel"] if toxic else [])
        rng.shuffle(body)
        docs.append((i, " ".join(body)))
        labels.append((i, 1, int(toxic)))
    return documents(docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_is_learned(spark, documents):
    docs, labels = labelled(spark, documents)
    lexicon = toxicity.fit(docs, labels)
    scored = {r.doc_id: r.s for r in toxicity.score_documents(docs, lexicon, score_col="s").select("doc_id", "s").collect()}
    held = [i for i in scored if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all((scored[i] >= toxicity.THRESHOLD) == (i % 5 == 0) for i in held)
    kept = toxicity.keep_civil(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == 480
    edges = toxicity.score_documents(documents(EDGES), lexicon, score_col="s").collect()
    assert len(edges) == len(EDGES) and all(0 <= r.s <= 1 for r in edges) and toxicity.score_documents(documents([]), lexicon, score_col="s").count() == 0
    none = toxicity.fit(docs, labels.where("false"))
    assert none.score("grobnik") < toxicity.THRESHOLD and toxicity.fit(documents([]), labels).score("x") < toxicity.THRESHOLD


def test_language_is_learned(spark, documents):
    rng = random.Random(4)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["ßü", "sch", "ei"], "cc": ["ки", "мо", "ра"]}
    rows = [(i, "".join(rng.choices([*syllables[x], " "], k=60)), x) for i, x in enumerate(rng.choices(list(syllables), k=300))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(docs, rows_per_language=60)
    held = [r for r in language.identify(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in held)
    assert model.predict(None) == model.predict("12 34!") == (language.UNKNOWN, 0.0) and 0.05 <= model.temperature <= 10
    edges = language.identify(documents(EDGES), model).collect()
    assert len(edges) == len(EDGES) and language.identify(documents([]), model).count() == 0
    assert language.fit(docs.where("false")).predict("ka") == (language.UNKNOWN, 0.0)


def test_counts_do_not_depend_on_blocks(monkeypatch):
    text = "Ein kurzer Text, mit Umlauten: ÄÖÜ. " * 40
    whole = language.counts(text)
    assert language.counts(text.upper())[1].sum() == whole[1].sum() and language.counts("!!") [2] is False and language.counts("𐐀")[2] is True
    monkeypatch.setattr(language, "BLOCK", 100)
    assert abs(language.counts(text)[1].sum() - whole[1].sum()) < 0.2 * whole[1].sum()


RANKS, PATTERN = bpe.load_ranks(bpe.default_vocabulary()[0]), public_tokenizers.PATTERN
TOKENIZER = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
SAMPLES = ["", "Hello, world! it's we'll", "日本語テキスト 한국어 🎉🎉", "ab" * 500, "a" * 3000, "  \n\n x \t", "Überraschung éàü ñandú", "<|endoftext|>", "\u0000\u0001"]


def test_bpe_equals_the_tokenizer(documents):
    rng = random.Random(5)
    samples = SAMPLES + ["".join(rng.choices("abcdefgh tionéß\n", k=200)) for _ in range(30)]
    replay = bpe.MergeReplay(RANKS, PATTERN)
    for _ in range(2):  # the second time from memory
        for text, ids in zip(samples, replay.encode_batch(samples), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == TOKENIZER.encode_ordinary(text) and replay.decode(ids) == text.encode()
    found = bpe.encode_documents(documents(EDGES), *bpe.default_vocabulary()).collect()
    assert sorted((r.doc_id or -1, bytes(r.decoded).decode()) for r in found) == sorted((i or -1, t or "") for i, t in EDGES)
    assert all(r.n_tokens * 4 == len(r.ids) for r in found) and bpe.encode_documents(documents([]), *bpe.default_vocabulary()).count() == 0


def test_merges_of_a_vocabulary_whose_parts_rank_above_their_whole():
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"ab": 9, b"abc": 3, b"cd": 20, b"aa": 5}
    odd = tiktoken.Encoding("odd", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    samples = ["abab", "ababcd", "aaab", *("".join(rng.choices("abcd", k=12)) for _ in range(200))]
    for text, ids in zip(samples, bpe.MergeReplay(ranks, r"\S+").encode_batch(samples), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == odd.encode_ordinary(text), text


def plain_words(text):
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


def plain_overlaps(docs, items):
    out = {}
    for i, t in docs:
        d = plain_words(t)
        for j, it in items:
            b = plain_words(it)
            if len(b) < decontamination.MIN_WORDS:
                continue
            good = []
            for shift in range(-len(b), len(d)):
                equal = [int(0 <= shift + k < len(d) and d[shift + k] == w) for k, w in enumerate(b)]
                size = min(len(b), decontamination.WINDOW)
                if any(sum(equal[s : s + size]) >= np.ceil(0.8 * size) for s in range(len(b) - size + 1)):
                    good.append(sum(equal) / len(b))
            if good:
                out[(i, j)] = (len(good), max(good))
    return out


def test_leaks_with_substitutions(spark, documents):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(j, " ".join(rng.choices(vocabulary, k=rng.randint(8, 40)))) for j in range(12)] + [(50, "too short"), (51, None), (52, "")]
    docs = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        if i % 3 == 0:
            leak = items[i % 12][1].split()
            step = rng.choice([0, 5, 6])
            leak = [("changed" if step and k % step == step - 1 else w) for k, w in enumerate(leak)]
            leak = leak[: len(leak) if i % 2 else max(8, len(leak) * 3 // 4)]
            words[5:5] = [w.upper() + "," for w in leak]
        docs.append((i, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): (r.overlaps, r.similarity) for r in decontamination.overlaps(documents(docs), bench).collect()}
    plain = plain_overlaps(docs, items)
    assert found == plain and len(found) >= 12
    clean = decontamination.keep_clean(documents(docs), bench)
    assert {r.doc_id for r in clean.collect()} == set(range(60)) - {i for i, _ in found} and clean.columns == documents(docs).columns


def test_leak_edges(spark, documents):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine")] * 2, "item_id bigint, text string")
    docs = [*EDGES, (30, "x one two three four FIVE six seven eight nine"), (30, "x one two three four FIVE six seven eight nine"), (None, "one two three four five six seven eight nine ten")]
    found = [(r.doc_id, r.overlaps, r.similarity) for r in decontamination.overlaps(documents(docs), bench).collect()]
    assert sorted(found, key=str) == [(30, 1, 1.0), (None, 1, 1.0)]
    assert decontamination.overlaps(documents([]), bench).count() == 0 and decontamination.overlaps(documents(docs), bench.where("false")).count() == 0


@pytest.mark.parametrize("residue", range(5))
def test_a_mask_survives_every_fifth_word_changed(residue):
    assert any(all((s + o) % 5 != residue for o in mask) for s in range(5) for mask, _, high in decontamination.SEEDS if high is None)
