"""Benchmark leaks whose substitutions are scattered, short items and scripts without spaces."""

import random

import pytest

from chronolith.llm import decontamination as dec


def most_equal_without_seed(n):
    """The largest number of equal words among n that leaves no seed whole, over all patterns."""
    masks = [o for o, low, high in dec.SEEDS if low <= n <= (high or n)]
    states = {(): 0}
    for i in range(n):
        after = {}
        for tail, count in states.items():
            for bit in (0, 1):
                now = (*tail, bit)[-7:]
                if any(i >= m[-1] and all(now[len(now) - 1 - m[-1] + o] for o in m) for m in masks):
                    continue
                after[now] = max(after.get(now, -1), count + bit)
        states = after
    return max(states.values())


@pytest.mark.parametrize("n", range(1, 121))
def test_every_accepted_pattern_has_a_seed(n):
    least = n if n < dec.MIN_WORDS else -(-4 * n // 5)
    assert most_equal_without_seed(n) < least


def test_scattered_substitutions_and_short_items(spark, documents):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    items, docs = [], []
    for j in range(60):
        words = rng.choices(vocabulary, k=rng.choice([8, 9, 10, 11, 12, 13, 15, 20, 40]))
        items.append((j, " ".join(words)))
        spare = len(words) // 5
        for over in (0, 1):  # the whole item, with as many words changed as may be, and with many more
            changed = set(rng.sample(range(len(words)), spare if not over else len(words) // 2))
            docs.append((2 * j + over, " ".join(["x", "y", *(f"c{k}" if k in changed else w for k, w in enumerate(words)), "z"])))
    items += [(100, "What is it?"), (101, "今日は良い天気です"), (102, "明天我们一起去北京看长城好吗"), (103, "...")]
    docs += [(200, "so what IS it, then"), (201, "what is this"), (202, "昨日も今日は良い天気ですね"), (203, "他说明天我们一起去上海看长城好吗是的"), (204, "今日は雨です")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in dec.overlaps(documents(docs), bench).collect()}
    assert {(2 * j, j) for j in range(60)} <= found
    assert {x for x in found if x[0] >= 200} == {(200, 100), (202, 101), (203, 102)}
    assert all(d // 2 == j for d, j in found if d < 200)
