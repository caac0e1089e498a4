"""Revealing terms away from their value and with little support."""

import math

from chronolith.llm import pii

FILLER = [f"common words stand in text number {i} of many, one more of them is here" for i in range(2000)]


def _terms(docs):
    return {r["__id"]: [t for t in r["__terms"] or []] for r in pii.find_personal_data(docs).collect()}


def test_terms_are_marked_wherever_they_stand(documents):
    pad = "common words stand in text of many " * 3
    secret = [f"Falconer {pad} boss@corp.example number {i} of many" for i in range(8)]
    away = ["here stands (FALCONER) alone", "nothing"]
    docs = documents(FILLER + secret + away)
    found = _terms(docs)
    text = away[0]
    assert [text[x.start : x.stop] for x in found[2008]] == ["FALCONER"] and found[2009] == [] and len(found[2000]) == 1
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[2008] == "here stands ([word]) alone" and clean[2009] == "nothing" and "alconer" not in clean[2003]


def test_two_different_windows_are_enough_but_copies_are_not(documents):
    twice = [f"please write number {i} to falconer at boss@corp.example of many" for i in range(2)]
    copies = ["please write to kestrel at clerk@corp.example of many"] * 3
    docs = documents(FILLER + twice + copies)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("falconer" not in clean[2000 + i] and "[EMAIL]" in clean[2000 + i] for i in range(2))
    assert all("kestrel" in clean[2002 + i] for i in range(3)) and clean[7] == FILLER[7]


def test_disclosure_counts_all_words(documents):
    secret = [f"please tell falconer at boss@corp.example number {i} of many" for i in range(8)]
    rare = [f"once{i} twice{i}" for i in range(500)]
    docs = FILLER + secret + ["falconer stands here"] + rare
    share = next(x.share for r in pii.find_personal_data(documents(docs)).collect() if r["__id"] == 2000 for x in r["__terms"] if secret[0][x.start : x.stop] == "falconer")
    n = sum(len(t.split()) for t in docs) + 1
    assert abs(share - math.log2(8 * n / (9 * 8)) / math.log2(n / 8)) < 1e-12
