"""Sharding, exact search, the pipeline and the registered queries."""

import zlib

import duckdb
import numpy as np
import pytest
from conftest_llm import EDGES

import corpus_pipeline
from chronolith.llm import registry, sharding, vafile

FOLDER = "/root/testdata/sf0.001"


def plain_jump(key, n):
    b, j, key = -1, 0, key % (1 << 64)
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, 2, -1, 10**15, -(1 << 63), (1 << 63) - 1, *range(100, 400)]
    frame = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for n in (1, 2, 24, 25):
        assert [(r.k, r.s) for r in frame.select("k", sharding.jump_hash(frame.k, n).alias("s")).collect()] == [(k, plain_jump(k, n)) for k in keys]


def test_sharding(documents):
    docs = EDGES + [(i, f"text {i}") for i in range(100, 400)] + [(9, "hot")] * 200
    found = sharding.shard_documents(documents(docs), slot_ranges=8).collect()
    assert len(found) == len(docs)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in found) == sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    for s in range(24):
        held = sorted(r.slot for r in found if r.shard == s)
        assert held == list(range(len(held)))
    assert all(r.shard == plain_jump(r.doc_id or 0, 24) and r.grown_shard in (r.shard, 24) and r.law == "key" for r in found)
    assert sharding.shard_documents(documents([])).count() == 0


def plain_top(rows, queries, k):
    out = []
    for n, (q, qv) in enumerate(queries):
        scored = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in rows if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("scale", [64, 1 << 26])
def test_top_k(spark, monkeypatch, scale):
    monkeypatch.setattr(vafile, "VECTOR_BLOCK", 37)
    monkeypatch.setattr(vafile, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(150)] + [(200 + i, [0.5] * 8) for i in range(60)]
    bad = [(900, None), (901, [float("nan")] * 8), (902, [float("inf")] + [0.0] * 7), (903, [None] + [0.0] * 7), (None, [1.0] * 8)]
    odd = [(904, []), (905, [1.0] * 3)]
    frame = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows + bad + odd], "vec_id bigint, embedding array<float>, rank int, score double").repartition(4)
    whole = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows + odd]
    wanted = [x for x in whole if x[0] % 20 == 0]
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vafile.top_k(frame, frame.where("vec_id % 20 = 0"), k=7, scale=scale).collect())
    assert found == sorted(plain_top(whole, wanted, 7))


def test_top_k_of_few_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [3.0])], "vec_id bigint, embedding array<float>")
    found = sorted((r["rank"], r.vec_id, r.score) for r in vafile.top_k(frame, frame.where("vec_id = 0")).collect())
    assert found == [(1, 1, 64 * 192), (2, 1, 64 * 128)]
    assert vafile.top_k(frame.where("false"), frame).count() == 0 and vafile.top_k(frame, frame.where("false")).count() == 0


def test_registered_queries_equal_their_sql(spark):
    for t in ("documents", "embeddings", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        ours, theirs = registry.queries()[name](spark, FOLDER), duckdb.sql(sql)
        order = sorted(ours.columns)
        assert order == sorted(theirs.columns)
        nulls_last = lambda row: [(x is None, x) for x in row]  # noqa: E731  some columns hold nulls
        assert sorted(map(tuple, ours.select(order).collect()), key=nulls_last) == sorted(theirs.select(*order).fetchall(), key=nulls_last)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            docs = spark.createDataFrame(out.toPandas(), docs.schema)
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert ids <= before and len(ids) > 0.7 * len(before)
            before = ids
    assert {r.doc_id for r in out.collect()} == before
    whole = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == before
