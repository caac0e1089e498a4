"""Fill-in-the-middle against plain Python."""

import hashlib
import re

import numpy as np
import pytest
from conftest_llm import EDGES, LARGE
from pyspark.sql import functions as F

from chronolith.llm import fim, registry

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = ["one two  three\n", " lead and trail \t", "a<P>b already marked", "x <S", "<M> y", "S>  <", "ünï cödé 日本 語 no break", "a", " ", " em space is a word"] + [f"word{i} " * (i % 9) + "end" for i in range(120)]


def plain(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


@pytest.mark.parametrize("slice_bytes", [fim.SLICE_BYTES, 64])
def test_equal_to_plain_python(documents, monkeypatch, slice_bytes):
    rows = list(enumerate(TEXTS, 100)) + EDGES + LARGE
    docs = documents(rows)
    monkeypatch.setattr(fim, "SLICE_BYTES", slice_bytes)
    found = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    wanted = sorted((str(i), *map(str, plain(i, t)), t or "") for i, t in rows)
    assert sorted((str(r.doc_id), *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), r.back) for r in found) == wanted
    assert {r.form for r in found} == set(fim.FORMS)


def test_kernel_over_slices_of_any_size():
    texts = TEXTS + [""] + [t or "" for _, t in EDGES]
    bodies = [t.encode() for t in texts]
    ids = np.arange(len(texts))
    for step in (1, 3, len(texts)):
        for at in range(0, len(texts), step):
            part = bodies[at : at + step]
            offsets = np.concatenate(([0], np.cumsum([len(b) for b in part])))
            n, first, second, prefix, middle = fim.cut(np.frombuffer(b"".join(part), np.uint8), offsets, ids[at : at + step] * 7 + 3, ids[at : at + step] * 5 + 1)
            for k, text in enumerate(texts[at : at + step]):
                units = TOKEN.findall(text)
                i, j = sorted((((at + k) * 7 + 3) % (len(units) + 1), ((at + k) * 5 + 1) % (len(units) + 1)))
                a, b = "".join(units[:i]), "".join(units[i:j])
                assert (n[k], first[k] - offsets[k], second[k] - offsets[k], prefix[k], middle[k]) == (len(units), len(a.encode()), len((a + b).encode()), len(a), len(b))


def test_other_shares_and_empty_table(spark, documents):
    docs = documents([(i, f"some words {i} here") for i in range(40)])
    assert {r.form for r in fim.fill_in_middle(docs, cut_share=0).collect()} == {"plain"}
    assert {r.form for r in fim.fill_in_middle(docs, cut_share=100, suffix_first_share=0).collect()} == {"psm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_registered_query(spark, documents, tmp_path):
    rows = [r for r in list(enumerate(TEXTS, 100)) + EDGES + LARGE]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = registry.queries()["op13_fill_in_middle"](spark, str(tmp_path)).collect()
    assert sorted(map(str, found)) == sorted(
        f"Row(doc_id={i}, n={p[0]}, form={p[1]!r}, prefix_chars={p[2]}, middle_chars={p[3]}, output_sha256={sha(p[4])!r}, restored_sha256={sha(t or '')!r})" for i, t in rows for p in [plain(i, t)]
    )
