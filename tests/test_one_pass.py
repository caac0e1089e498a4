"""Statistics of files and owners add up the touches once; pairs of files read no commits; the queries' own lines are packed."""

import os

from history_records import change, commit

from chronolith import testbed
from chronolith.operators import pairs, ranking
from chronolith.plans import history as histories
from chronolith.plans.history import History
from chronolith.schema import Limits, Options


def records():
    return [r for i in range(6) for r in (commit(f"c{i}", f"{i % 2}@x"), change(f"c{i}", "a", i), change(f"c{i}", "b", 5))]


def test_pairs_read_no_commits(history):
    h = history(*records())
    alone = History(None, h.files, None, Options(), renames=False)
    assert pairs.coupling(alone, 0, Limits(coupling_min_changes=1)).collect() == pairs.coupling(h, 0, Limits(coupling_min_changes=1)).collect() != []


def test_touches_are_added_up_once(history, monkeypatch):
    passes = []
    write = histories.written
    monkeypatch.setattr(histories, "written", lambda df: passes.append(1) or write(df))
    h = history(*records())
    assert [(r.path, r.commits, r.churn, r.unique_devs) for r in ranking.hotspots(h, 0).collect()] == [("a", 6, 15, 2), ("b", 6, 30, 2)]
    assert {r.email: r.files_touched for r in ranking.contributors(h, 0).collect()} == {"0@x": 2, "1@x": 2} and len(passes) == 1


def test_authors_of_file_rows_spare_the_join(history):
    h = history(*records())
    own = h.commits.select("sha", "email", "ts")
    known = History(h.commits, h.files.join(own, "sha"), h.parents, Options(), headers=h.commits.drop("additions", "deletions", "files_changed"))
    assert ranking.hotspots(known, 0).collect() == ranking.hotspots(h, 0).collect()


def test_packed_lines_are_read_back(spark, history, tmp_path):
    h = history(*records())
    testbed.write_lines(spark, h, str(tmp_path / "h.jsonl"), testbed.PACKED)
    assert any(f.endswith(".lz4") for f in os.listdir(tmp_path / "h.jsonl"))
    assert ranking.hotspots(testbed.read_lines(spark, h), 0).collect() == ranking.hotspots(h, 0).collect()
