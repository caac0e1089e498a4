"""Hard negatives, and exact search over components of any size, against plain Python."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronolith.llm import negatives, registry, vafile

SCHEMA = "vec_id bigint, embedding array<double>, label int, key bigint, v string, a_key int, id string"
MOST = (1 << 63) - 1


def held(x):
    return max(-MOST, min(MOST, x))


def whole(vector, scale):
    return [held(math.floor(x * scale)) if math.isfinite(x * scale) else (MOST if x > 0 else -MOST) for x in vector]


def sound(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def product(a, b):
    return held(sum(x * y for x, y in zip(a, b)))


def plain_mine(rows, relabel=True, scale=256):
    rows = [(i, whole(v, scale), (l + 1) % 10 if relabel and i % 7 == 0 else l) for i, v, l in rows if i is not None and l is not None and sound(v)]
    out = []
    for a, va, la in rows:
        if a % 100:
            continue
        scored = [(product(va, v), i, l) for i, v, l in rows if i != a]
        for ps, p in sorted(((s, i) for s, i, l in scored if l == la), key=lambda x: (-x[0], x[1]))[:5]:
            fit = sorted(((s, i) for s, i, l in scored if l != la and 30 * ps <= 100 * s <= 90 * ps), key=lambda x: (-x[0], x[1]))[:10]
            out += [(a, p, k, n, ps, s) for k, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", 2, "i") for r in rows], SCHEMA).repartition(3)


def sample(n, d=12, seed=3):
    rng = np.random.default_rng(seed)
    spread = 0.9 ** np.arange(d)
    return [(i, (rng.normal(size=d) * spread).tolist(), int(rng.integers(0, 4))) for i in range(n)]


ODD = [
    (1001, None, 1), (1002, [1.0, None], 1), (1003, [float("nan")] * 12, 1), (1100, [float("inf")] * 12, 1), (1005, [], 2), (1200, [], 2), (1300, [0.5] * 3, 1), (1007, [0.5] * 12, None), (None, [0.5] * 12, 1),
    (1400, [0.0] * 12, 3), (1401, [0.0] * 12, 3), (1402, [0.0] * 12, 1), (1403, [0.0] * 12, 2), (5, [0.25] * 12, 0), (5, [0.25] * 12, 1), (-100, [0.3] * 12, 2), (-7, [-0.3] * 12, 9),
]


@pytest.mark.parametrize("row_block", [negatives.ROW_BLOCK, 16])
def test_equal_to_plain_python(spark, tmp_path, monkeypatch, row_block):
    monkeypatch.setattr(negatives, "ROW_BLOCK", row_block)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", min(row_block, 4))
    rows = sample(700) + ODD
    table(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = registry.queries()["op12_hard_negatives"](spark, str(tmp_path))
    wanted = plain_mine(rows)
    assert sorted(map(tuple, found.collect())) == wanted and len(wanted) > 100
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_huge_components(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 1.0, -2.5, 1e12, -1e12, 1e300, 3e5]) for _ in range(5)], i % 3) for i in range(0, 600, 4)]
    found = negatives.mine(table(spark, rows), table(spark, rows).where("vec_id % 100 = 0"))
    assert sorted(map(tuple, found.collect())) == plain_mine(rows, relabel=False)


def test_bounds_hold_and_drop_early():
    rng = np.random.default_rng(1)
    v = np.floor(256 * rng.normal(size=(300, 16)) * 0.6 ** np.arange(16)).astype(np.int64)
    turn, cuts = negatives.rotation((v.T @ v).astype(float))
    assert len(cuts) > 1 and np.allclose(turn.T @ turn, np.eye(16))
    a, b, seen = negatives.Block(v[:20], turn, cuts), negatives.Block(v, turn, cuts), []
    true = v[:20] @ v.T

    def wanted(at, low, high):
        assert (low <= true[:, at]).all() and (true[:, at] <= high).all()
        seen.append(len(at))
        return high >= negatives.kth(low, np.ones_like(low, bool), 3)[:, None]

    at, low, high = negatives.bounded(a, b, cuts, wanted)
    assert seen == sorted(seen, reverse=True) and seen[-1] < 300
    for i in range(20):
        assert set(np.argsort(-true[i], kind="stable")[:3]) <= set(at)
    assert np.array_equal(negatives.scores(a, 2, b, at), true[2, at])


def test_empty_table(spark):
    empty = table(spark, sample(3)).limit(0)
    assert negatives.mine(empty, empty).count() == 0


def plain_top(rows, k=20, scale=64):
    rows = [(i, whole(v, scale)) for i, v, _ in rows if i is not None and sound(v)]
    return sorted((q, n, i, s) for q, v in rows if q % 20 == 0 for n, (s, i) in enumerate(sorted(((product(v, w), i) for i, w in rows if i != q), key=lambda x: (-x[0], x[1]))[:k], 1))


def test_search_over_huge_components(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, [rng.choice([0.0, 1.0, -2.5, 1e12, -1e12, 1e300, -1e300, 1e308, 3e5]) for _ in range(4)], 1) for i in range(0, 400, 4)]
    table(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(map(tuple, registry.queries()["op7_exact_topk"](spark, str(tmp_path)).collect())) == plain_top(rows)


def test_search_among_equal_vectors_names_few(spark, tmp_path, monkeypatch):
    """Three thousand zero vectors: of those that tie at a query's floor only the first by id are read."""
    rows = [(i, [0.0] * 8, 1) for i in range(3000)]
    table(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    counted, named = [], vafile._named

    def counting(met, k):
        found = named(met, k)
        counted.append(found.count())
        return found

    monkeypatch.setattr(vafile, "_named", counting)
    found = registry.queries()["op7_exact_topk"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted((q, n, i, 0) for q in range(0, 3000, 20) for n, i in enumerate([i for i in range(21) if i != q][:20], 1))
    assert counted[0] <= 150 * 20 * 3  # k from each of three blocks of cells


def test_a_pair_of_blocks_gives_one_batch():
    """Not one for each anchor and positive: batches cost more than their scores."""

    class Tiles:
        def mapInPandas(self, search, schema):
            return search

    rng = np.random.default_rng(5)
    v, ids, labels = rng.integers(-50, 50, (60, 4)), np.arange(60), np.arange(60) % 3
    flat = {"id": ids.tobytes(), "key": ids.tobytes(), "label": labels.tobytes(), "many": 60, "width": 4, "v": v.tobytes()}
    tile = flat | {f"a_{c}": x for c, x in flat.items()}
    turn, cuts = negatives.rotation((v.T @ v).astype(float))
    (near,) = negatives._positives(Tiles(), turn, cuts, 5)([pd.DataFrame([tile])])
    assert len(near) == 300 and near.groupby("anchor_id").size().eq(5).all()
    near = near.sort_values(["anchor_id", "score"], ascending=[True, False])
    held = {"a_held": np.full(60, 5).tobytes(), "a_p_keys": near.p_key.to_numpy().tobytes(), "a_p_ids": near.positive_id.to_numpy().tobytes(), "a_p_scores": near.score.to_numpy().tobytes()}
    (found,) = negatives._negatives(Tiles(), turn, cuts, 10, 30, 90)([pd.DataFrame([tile | held])])
    scores = v @ v.T
    for (a, p), rows in found.groupby(["anchor_id", "positive_id"]):
        best = sorted((-scores[a, n], n) for n in ids if labels[n] != labels[a] and 30 * scores[a, p] <= 100 * scores[a, n] <= 90 * scores[a, p])[:10]
        assert [(-s, n) for s, n in zip(rows.score, rows.negative_id)] == best
