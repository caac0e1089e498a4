"""Large ids beside null ones, repeated ids, and the tables that operators leave behind."""

import pytest
from conftest_llm import EDGES, LARGE

import corpus_pipeline
from chronolith.llm import bpe, common, decontamination, language, pii, sharding, simhash, substrings, suffixes, toxicity

IDS = sorted((i for i, _ in LARGE), key=str)
LEXICON = toxicity.Lexicon({toxicity.fold("trash"): 2.0}, [], (0.0, 1.0, 1.0, 1.0))
OPERATORS = {
    "pii": lambda d: pii.find_personal_data(d).withColumnRenamed("__id", "doc_id"),
    "sanitise": pii.sanitise,
    "toxicity": lambda d: toxicity.score_documents(d, LEXICON),
    "suffixes": lambda d: suffixes.repeated_bytes(d).withColumnRenamed("id", "doc_id"),
    "language": lambda d: language.identify(d, language.train(["ka"], ["k"])),
    "substrings": lambda d: substrings.repeated_words(d).withColumnRenamed("id", "doc_id"),
    "bpe": lambda d: bpe.encode_documents(d, *bpe.default_vocabulary()),
    "simhash": simhash.near_duplicates,
    "keep_first": simhash.keep_first,
    "sharding": sharding.shard_documents,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_stay_exact(documents, name):
    found = OPERATORS[name](documents(LARGE)).collect()
    assert sorted((r.doc_id for r in found), key=str) == IDS


def test_ids_stay_exact_in_leaks(spark, documents):
    bench = spark.createDataFrame([(1, "large id")], "item_id bigint, text string")
    assert sorted(r.doc_id for r in decontamination.overlaps(documents(LARGE), bench).collect()) == sorted(i for i, t in LARGE if "large id" in t)


def test_components_of_large_ids(documents):
    docs = [(i, "the very same words") for i, _ in LARGE]
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(documents(docs)).collect()} == {(i, -(1 << 53) - 1) for i, _ in LARGE}


def test_rows_of_one_id_that_are_not_alike_all_stay(documents):
    docs = [(1, "alpha beta gamma delta epsilon zeta"), (1, "quite other words stand here now"), (2, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (None, "quite other words stand here now")]
    kept = simhash.keep_first(documents(docs)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted({docs[0], docs[1]})


def test_copies_without_an_id_go_after_those_with_one(documents):
    docs = [(None, "just some words"), (None, "just some words"), (5, "just some words"), (None, "alone")]
    assert sorted((str(r.doc_id), r.text) for r in simhash.keep_first(documents(docs)).collect()) == [("5", "just some words"), ("None", "alone")]


def test_runs_of_thousands_of_digits():
    text = f"1.2.{'9' * 5000}.4 and 1.2.{'0' * 5000}7.4"
    assert [(k, text[a:b][:4]) for k, a, b in pii.base_spans(text) if k == 1] == [(1, "1.2.")]


def test_blocks_leave_no_trace(monkeypatch):
    text = "Ein Wort, das 𐐀lang   ist!!  ÄÖ " * 40
    whole = language.counts(text)
    for block in (1, 2, 3, 7, 64, len(text)):
        monkeypatch.setattr(language, "BLOCK", block)
        found = language.counts(text)
        assert (found[0] == whole[0]).all() and (found[1] == whole[1]).all() and found[2] is whole[2]
    assert not language.counts("🎉🎉 🎉")[2] and language.counts("🎉 ")[1].sum() == language.counts("!")[1].sum()


def test_a_long_run_of_equal_rows_is_dealt_in_pieces(documents, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 7)
    found = sharding.shard_documents(documents([(9, "hot")] * 100 + [(i, "cold") for i in range(50)])).collect()
    assert len(found) == 150
    for s in range(24):
        held = sorted(r.slot for r in found if r.shard == s)
        assert held == list(range(len(held)))


def test_scratch_tables_go(spark, documents):
    before = len(common._scopes[0])
    with common.scratch():
        gone = common.saved(spark.range(3).toDF("a"))
        stays = common.result(spark.range(5).toDF("a"))
    assert stays.count() == 5 and len(common._scopes[0]) == before + 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FileNotFound|does not exist"):
        spark.read.parquet(gone.saved_at).count()


def test_stages_take_edge_rows(spark, documents, tmp_path):
    """Nulls, blanks, very long texts, repeated rows, large ids, columns that clash, and no row at all."""
    for name, rows in (("labels", spark.createDataFrame([(4, 1, 0), (5, None, 1)], "doc_id bigint, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, "no id at all"), (2, None)], "item_id bigint, text string"))):
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    for rows in (EDGES + LARGE, []):
        docs = documents(rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            kept = [(r.doc_id, r.text) for r in out.collect()]
            assert set(kept) <= set(rows) or name == "pii"
            docs = documents(kept)
        if rows:
            assert {i for i, _ in LARGE} <= {i for i, _ in kept} and (1, None) in kept and (None, "no id at all") not in kept
        assert stage is corpus_pipeline.STAGES[3][1] and corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() == len(kept)
