"""What an encoding worker holds is bounded, and the bounds change no id."""

import numpy as np

from chronolith.llm import bpe


def test_bounds_change_no_id(monkeypatch):
    vocabulary, pattern = bpe.default_vocabulary()
    ranks = bpe.load_ranks(vocabulary)
    texts = [f"word{i} the quick brown fox, número {i * 7}; 中文 {'x' * (i % 9)}" for i in range(300)]
    free = bpe.MergeReplay(ranks, pattern).encode_batch(texts)
    monkeypatch.setattr(bpe, "REMEMBERED_PAIRS", 50)
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 20)
    bound = bpe.MergeReplay(ranks, pattern)
    assert [x for run in bpe._pieces(texts, 1000) for x in bound.encode_batch(run)] == free
    assert len(bound.pair_ids) <= 50 and bound.decode(free[7]) == texts[7].encode()
    assert bpe.PIECE_CHARS <= 500_000 and len(list(bpe._pieces(["a" * 300_000] * 4))) == 4


def test_words_are_replayed_once_over_tables_and_tasks(monkeypatch):
    """A table that starts anew takes over what it meets again, and a worker's next task of a query finds its words."""
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 2)
    ranks, seen = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257}, []
    encoder = bpe._kept("query", ranks, r"\S+")
    assert bpe._kept("query", ranks, r"\S+") is encoder and bpe._kept("other", ranks, r"\S+") is not encoder
    replay = encoder.replay
    monkeypatch.setattr(encoder, "replay", lambda words: seen.extend(words) or replay(words))
    for text, ids in (("abc ab c", [257, 256, 99]), ("ab d", [256, 100]), ("abc", [257])):
        assert encoder.encode_batch([text]) == [np.array(ids, "<u4").tobytes()]
    assert seen == [b"ab", b"abc", b"c", b"d"]
