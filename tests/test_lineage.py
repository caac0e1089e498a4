"""Renames: one canonical path for a file's whole history."""

import pytest
from history_records import change, commit

from chronolith.operators import pairs, ranking
from chronolith.plans.lineage import canonical_paths, follow, follow_distributed
from chronolith.schema import Limits


def rename(sha, old, new, lines=0):
    return change(sha, new, lines, status="R100", old=old)


def churn(h):
    return {r.path: r.churn for r in ranking.hotspots(h, 0).collect()}


def test_merge_and_chain(history):
    h = history(
        commit("4", date="2024-04-01T00:00:00Z"), change("4", "c", 4), commit("3", date="2024-03-01T00:00:00Z"), rename("3", "b", "c", 1), commit("2", date="2024-02-01T00:00:00Z"), rename("2", "a", "b"), commit("1"), change("1", "a", 10)
    )
    assert churn(h) == {"c": 15}
    assert {r.email: r.files_touched for r in ranking.contributors(h).collect()} == {"a@x": 1}


def test_era_keeps_its_extension(history):
    h = history(commit("2", date="2024-02-01T00:00:00Z"), rename("2", "x.js", "x.ts", 3), commit("1"), change("1", "x.js", 7))
    assert {r.ext: (r.files, r.churn) for r in ranking.extensions(h, 0).collect()} == {".js": (1, 7), ".ts": (1, 3)}


def test_reuse_keeps_histories_apart(history):
    single = history(commit("3", date="2024-03-01T00:00:00Z"), change("3", "a", 9), commit("2", date="2024-02-01T00:00:00Z"), rename("2", "a", "b"), commit("1"), change("1", "a", 1))
    assert churn(single) == {"a": 10, "b": 0}
    several = history(commit("4", date="2024-04-01T00:00:00Z"), rename("4", "a", "c"), commit("2", date="2024-02-01T00:00:00Z"), rename("2", "a", "b"), commit("1"), change("1", "a", 1))
    assert churn(several) == {"a": 1, "b": 0, "c": 0}


def test_cycle_and_copies(history):
    h = history(commit("2", date="2024-02-01T00:00:00Z"), rename("2", "b", "a", 1), commit("1"), rename("1", "a", "b", 1), change("1", "k", status="C100", old="a"))
    assert set(churn(h)) == {"a", "b", "k"}


def test_pairs_count_before_the_merge(history):
    h = history(commit("2", date="2024-02-01T00:00:00Z"), rename("2", "a", "b", 5), change("2", "x", 5), change("2", "a", 0, status="D"), commit("1"), change("1", "a", 5), change("1", "x", 5))
    found = pairs.coupling(h, 0, Limits(coupling_min_changes=1)).collect()
    assert [(r.file_a, r.file_b, r.co_changes) for r in found] == [("b", "x", 3)]


STEPS = [{"a": "b", "b": "c"}, {"a": "b", "b": "a", "x": "a"}, {"a": "b", "b": "c", "c": "d", "d": "b", "z": "a"}, {f"n{i}": f"n{i + 1}" for i in range(20)}]


@pytest.mark.parametrize("step", STEPS)
def test_distributed_follow(spark, step):
    frame = spark.createDataFrame(list(step.items()), "path string, next string")
    found = dict.fromkeys(step) | {r.path: r.next for r in follow_distributed(frame).collect()}
    assert {p: c or p for p, c in found.items()} == follow(step)


def test_many_edges_leave_the_driver(history):
    h = history(commit("2", date="2024-02-01T00:00:00Z"), *(rename("2", f"o{i}", f"n{i}") for i in range(5)), commit("1"), *(change("1", f"o{i}") for i in range(5)))
    near, far = canonical_paths(h._authored), canonical_paths(h._authored, driver_edges=2)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.select("path", "canonical").collect()))


def test_search_for_chains_reads_the_facts_of_authors(spark, history, monkeypatch):
    """Rows are added up once, before renames are followed; the dates of the last changes come from these sums."""
    from chronolith.plans import history as plans

    records = [commit("3", date="2024-03-01T00:00:00Z"), change("3", "old", 2), commit("2", date="2024-02-01T00:00:00Z"), rename("2", "a", "b", 5), rename("2", "old", "new", 1), commit("1"), change("1", "a", 5), change("1", "old", 3)]
    seen = []
    monkeypatch.setattr(plans, "canonical_paths", lambda touches, used=None: seen.append(used) or canonical_paths(touches, used=used))
    h = history(*records)
    assert {r.file: r.churn for r in h.file_facts.collect()} == {"b": 10, "old": 5, "new": 1}  # `old` was used again
    assert seen[0] is not None and seen[0].columns == ["path", "ts"]
    assert "file" not in h._raw_facts.columns
    assert {r.file: r.churn for r in history(*records).touches.groupBy("file").agg({"lines": "sum"}).withColumnRenamed("sum(lines)", "churn").collect()} == {"b": 10, "old": 5, "new": 1}
