"""Runs of neighbouring file rows, as the pairs of files that change together are counted by."""

import itertools
import random
from collections import Counter

import pytest
from history_records import change, commit

from chronolith.operators import pairs
from chronolith.plans import runs
from chronolith.schema import Limits, Options
from chronolith.sources.jsonl import load

ANY = Limits(coupling_min_changes=1)


def counts(h):
    return {(r.file_a, r.file_b): (r.co_changes, r.changes_a, r.changes_b) for r in pairs.coupling(h, 0, ANY).collect()}


def test_a_commit_that_stands_in_two_places_counts_twice(history):
    parts = [commit("c1"), commit("c2"), change("c1", "a", 5), change("c1", "b", 5), change("c2", "a", 5), change("c2", "z", 5), change("c1", "b", 5), change("c1", "a", 5)]
    assert counts(history(*parts)) == {("a", "b"): (2, 3, 2), ("a", "z"): (1, 3, 1)}


def test_other_records_do_not_part_a_run(history):
    h = history(commit("c1"), change("c1", "a", 5), commit("c2"), {"type": "dev", "email": "z@x"}, {"type": "commit_parent", "sha": "c1"}, change("c1", "b", 5))
    assert counts(h) == {("a", "b"): (1, 1, 1)}


def test_rows_outside_the_window_do_not_part_a_run(history):
    parts = [commit("old", date="2020-01-01T00:00:00Z"), commit("new", date="2024-01-01T00:00:00Z"), change("new", "a", 5), change("old", "x", 5), change("new", "b", 5)]
    assert counts(history(*parts)) == {} and counts(history(*parts, options=Options(since="2023-01-01"))) == {("a", "b"): (1, 1, 1)}


def plain(stream):
    """Pairs and denominators of runs, for (sha, path) rows of each input."""
    pairs_, changes = Counter(), Counter()
    for rows in stream:
        for _, run in itertools.groupby(rows, key=lambda r: r[0]):
            paths = sorted({p for _, p in run})
            changes.update(paths)
            if 2 <= len(paths) <= 50:
                pairs_.update(itertools.combinations(paths, 2))
    return {(a, b): (n, changes[a], changes[b]) for (a, b), n in pairs_.items()}


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_runs_over_chunks_equal_one_pass(history, monkeypatch, bits):
    monkeypatch.setattr(runs, "CHUNK_BITS", bits)
    rng = random.Random(bits)
    rows = [(sha, f"p{rng.randrange(9)}") for _ in range(40) for sha in [f"c{rng.randrange(6)}"] for _ in range(rng.choice([1, 2, 9, 20]))]
    h = history(*(commit(f"c{i}") for i in range(6)), *(change(s, p, 50) for s, p in rows))
    assert counts(h) == plain([rows])


def test_runs_over_splits_and_inputs(spark, tmp_path, monkeypatch):
    """Two inputs in splits of a few lines: runs go on over splits, never over inputs."""
    import json

    rng, stream = random.Random(8), []
    for i in range(2):
        rows = [(sha, f"p{rng.randrange(9)}") for _ in range(12) for sha in [f"c{rng.randrange(4)}"] for _ in range(rng.choice([2, 9, 30]))]
        rows = [("c0", "first"), *rows, ("c0", "last")]
        stream.append([(s, f"in{i}:{p}") for s, p in rows])
        records = [commit(f"c{k}") for k in range(4)] + [change(s, p, 50) for s, p in rows]
        (tmp_path / f"in{i}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        paths = [str(tmp_path / f"in{i}.jsonl") for i in range(2)]
        assert spark.read.text(paths[0]).rdd.getNumPartitions() > 3
        assert counts(load(spark, paths)) == plain(stream)
        assert counts(load(spark, paths, staged=True)) == plain(stream)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
