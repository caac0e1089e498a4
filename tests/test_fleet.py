"""Figures over repositories, the index page, and inputs of which one is faulty."""

import datetime as dt
import json

import pytest
from history_records import change, commit, parent

from chronolith import cli
from chronolith.operators import fleet, ranking
from chronolith.schema import Options
from chronolith.sinks import html
from chronolith.sources import discovery, jsonl

FIRST = [commit("1", "a@x", additions=9, deletions=1), change("1", "f.py", 9), parent("1", "0"), parent("1", "00"), commit("2", "b@x", "2024-02-01T00:00:00Z", additions=3), change("2", "f.py", 3), change("2", "g.py", 0)]
SECOND = [commit("1", "a@x", "2023-05-01T00:00:00Z", additions=2), change("1", "f.py", 2), parent("1", "0"), commit("3", "c@x", "2024-03-01T00:00:00Z"), change("9", "orphan.py", 1)]


@pytest.fixture
def inputs(tmp_path):
    def write(**contents):
        paths = []
        for name, records in contents.items():
            path = tmp_path / f"{name}.jsonl"
            path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))
            paths.append(str(path))
        return paths

    return write


def figures(h):
    return {r["repo"]: r for r in fleet.repositories(h).collect()}


def test_developers_of_several_repositories_count_once(spark, inputs):
    rows = jsonl.staged_rows(spark, inputs(one=FIRST, two=SECOND), by_input=True)
    found = figures(jsonl.history_of(rows, multi=True))
    assert (found["one"].devs, found["two"].devs, found[None].devs) == (2, 2, 3)
    assert (found[None].commits, found[None].files, found[None].churn, found[None].merges) == (4, 4, 15, 1)  # f.py of both, g.py, orphan.py
    assert (found[None].first_commit, found[None].last_commit, found[None].total) == ("2023-05-01", "2024-03-01", True)
    assert not jsonl.faults(rows)


def test_each_repository_equals_its_own_summary(spark, inputs):
    paths = inputs(one=FIRST, two=SECOND)
    for options in (Options(), Options(since="2024-01-20")):
        rows = jsonl.staged_rows(spark, paths, by_input=True)
        found = figures(jsonl.history_of(rows, options, multi=True))
        for i, name in enumerate(("one", "two")):
            alone = ranking.summary(jsonl.history_of(rows.where(f"input = {i}"), options)).first()
            got = found[name]
            assert (got.commits, got.devs, got.files, got.additions, got.deletions, got.merges, got.first_commit, got.last_commit) == (
                alone.total_commits, alone.total_devs, alone.total_files, alone.total_additions, alone.total_deletions, alone.merge_commits, alone.first_commit, alone.last_commit
            )


def test_files_without_commits_and_no_rows_at_all(spark, inputs):
    only = figures(jsonl.history_of(jsonl.staged_rows(spark, inputs(one=[change("1", "f.py")], two=[commit("1")]), by_input=True), multi=True))
    assert (only["one"].commits, only["one"].devs, only["one"].files, only["one"].first_commit) == (0, 0, 1, "") and only["two"].files == 0
    assert figures(jsonl.history_of(jsonl.staged_rows(spark, inputs(none=[]), by_input=True))) == {}


def test_jobs_of_the_index_do_not_grow_with_repositories(spark, inputs):
    made = []
    for n in (2, 9):
        h = jsonl.history_of(jsonl.staged_rows(spark, inputs(**{f"n{n}_{i}": FIRST for i in range(n)}), by_input=True), multi=True)
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        held, total = cli.index_figures(h)
        made.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before)
        assert len(held) == n and total["devs"] == 2 and total["commits"] == 2 * n
    assert made[0] == made[1] > 0


def test_a_faulty_input_fails_alone(spark, inputs, tmp_path, monkeypatch):
    paths = inputs(one=FIRST, bad=[FIRST[0], "", "not json"], two=SECOND)
    slugs = ("one", "bad", "two", "gone")
    entries = [discovery.Entry(s, f"/r/{s}", "ok", p) for s, p in zip(slugs, paths, strict=False)] + [discovery.Entry("gone", "/r/gone", "skipped")]
    monkeypatch.setattr(discovery, "scan", lambda *a, **k: discovery.Manifest(["/r"], entries))
    monkeypatch.setattr(cli, "session", lambda: spark)
    folder = tmp_path / "pages"
    assert cli.main(["scan", "--root", "/r", "--report-dir", str(folder)]) == 0
    text = (folder / "index.html").read_text()
    assert "4 repositories: 2 ok, 1 failed, 1 pending" in text and "Unique devs: 3" in text and "Total commits: 4" in text and "line 3" in text
    assert sorted(p.name for p in folder.iterdir()) == ["index.html", "one.html", "two.html"]


def test_index_page():
    entries = [{"slug": "b", "status": "ok", "commits": 2, "last_commit": "2024-01-01", "first_commit": "2023-01-01"}, {"slug": "w", "status": "skipped"}, {"slug": "f", "status": "failed", "error": "<no>"}]
    text = html.scan_index(entries, dt.date(2024, 1, 11), {"commits": 2, "devs": 1234, "files": 0, "churn": 0})
    assert text.index(">f<") < text.index(">w<") < text.index("b.html") and "&lt;no&gt;" in text and "2023-01-01 to 2024-01-01" in text and "10d ago fresh" in text and "Unique devs: 1,234" in text
