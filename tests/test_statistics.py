"""Statistics over small hand-made histories."""

import json

import pytest
from history_records import change, commit, parent

from chronolith.operators import compose, ownership, pairs, profiles, ranking, risk, structure
from chronolith.schema import Limits, Options
from chronolith.sources.jsonl import MalformedInput, load, load_lines


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_basic(history):
    h = history(commit("c1", additions=10, deletions=2, files_changed=1), change("c1", "main.go", 10, 2), {"type": "dev", "email": "z@x"})
    s = ranking.summary(h).first()
    assert (s.total_commits, s.total_devs, s.total_files, s.total_additions, s.merge_commits, s.avg_deletions, s.first_commit) == (1, 1, 1, 10, 0, 2.0, "2024-01-15")
    assert rows(ranking.hotspots(h), "path", "commits", "churn", "unique_devs") == [("main.go", 1, 12, 1)]


def test_empty_history(history):
    h = history(commit("c", date="bad"))
    assert rows(ranking.hotspots(h), "path") == [] and rows(risk.churn_risk(h), "path") == [] and rows(ranking.activity(h), "period") == []
    assert [r.label for r in ownership.pareto(h).collect()][0] == "no data"
    assert ranking.top_commits(h).first().date == "0001-01-01"


def test_window_keeps_both_days_and_undated_commits(history):
    records = [commit("a", date="2024-01-10T00:00:00Z"), change("a", "a.py"), commit("b", date="2024-06-10T23:59:59Z"), change("b", "b.py"), commit("c", date="2024-06-11T00:00:00Z"), change("c", "c.py"), commit("d", date="?"), change("d", "d.py"), change("orphan", "o.py")]
    h = history(*records, options=Options("2024-01-10", "2024-06-10"))
    assert {r[0] for r in rows(ranking.hotspots(h, 0), "path")} == {"a.py", "b.py", "d.py"}
    assert {r[0] for r in rows(ranking.hotspots(history(*records), 0), "path")} == {"a.py", "b.py", "c.py", "d.py", "o.py"}


def test_merges_and_touches_are_records(history):
    h = history(commit("m"), parent("m", "x"), parent("m", "y"), commit("n"), parent("n", "m"), change("m", "f", 1), change("m", "f", 2))
    assert ranking.summary(h).first().merge_commits == 1
    assert rows(ranking.hotspots(h), "commits", "churn") == [(2, 3)]


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"type":"commit","sha":"a"}\n\nnot json\n')
    with pytest.raises(MalformedInput):
        load(spark, str(tmp_path / "h.jsonl"))
    with pytest.raises(MalformedInput):
        load_lines(spark, ["{oops"])


def test_ties_are_ordered_by_name(history):
    records = [r for i in "edcba" for r in (commit(i, f"{i}@x", additions=1), change(i, f"{i}.py"))]
    for _ in range(3):
        h = history(*records)
        assert [r[0] for r in rows(ranking.contributors(h, 3), "email")] == ["a@x", "b@x", "c@x"]
        assert [r[0] for r in rows(ranking.hotspots(h, 0), "path")] == [f"{i}.py" for i in "abcde"]
        assert [r[0] for r in rows(ranking.top_commits(h, 0), "sha")] == list("abcde")


def test_bus_factor_and_zero_line_changes(history):
    h = history(commit("1", "a@x"), change("1", "f", 80), commit("2", "b@x"), change("2", "f", 15), commit("3", "c@x"), change("3", "f", 5), change("3", "g", 0))
    assert rows(ownership.bus_factor(h), "path", "bus_factor", "top_devs") == [("f", 1, ["a@x"])]
    assert dict(rows(ranking.contributors(h), "email", "files_touched"))["c@x"] == 2
    assert dict(rows(ranking.hotspots(h), "path", "unique_devs")) == {"f": 3, "g": 0}


def test_utc_buckets_and_local_hours(history):
    h = history(commit("1", date="2024-01-31T23:30:00-05:00", additions=1))
    assert rows(ranking.activity(h, "month"), "period") == [("2024-02",)] and rows(ranking.activity(h, "week"), "period") == [("2024-W05",)]
    assert rows(ranking.working_patterns(h), "day", "hour", "commits") == [("Wed", 23, 1)]
    assert rows(ranking.activity_grid(h), "year") == [("2024",)]


def test_duplicate_shas(history):
    h = history(commit("s", additions=1), commit("s", "b@x", additions=5))
    assert ranking.summary(h).first().total_commits == 2
    assert rows(ranking.activity(h), "commits", "additions") == [(1, 5)]


@pytest.mark.parametrize(("files", "lines", "kept"), [(9, 1, True), (10, 5, True), (10, 4, False), (50, 9, True), (51, 9, False), (1, 9, False)])
def test_coupling_bounds(history, files, lines, kept):
    h = history(commit("c"), *(change("c", f"f{i:02d}", lines) for i in range(files)))
    assert (pairs.coupling(h, 0, Limits(coupling_min_changes=1)).count() > 0) is kept


def test_coupling_share(history):
    h = history(*(r for i in range(4) for r in (commit(str(i)), change(str(i), "a"), change(str(i), "b" if i < 3 else "c"))))
    assert rows(pairs.coupling(h, 0, Limits(coupling_min_changes=3)), "file_a", "file_b", "co_changes", "coupling_pct", "changes_a") == [("a", "b", 3, 100.0, 4)]


def test_network(history):
    h = history(commit("1", "a@x"), change("1", "f", 10), change("1", "g", 4), commit("2", "b@x"), change("2", "f", 3), change("2", "h", 9))
    assert rows(pairs.dev_network(h, 0, Limits(network_min_files=1)), "dev_a", "dev_b", "shared_files", "shared_lines", "weight") == [("a@x", "b@x", 1, 3, 50.0)]


def test_risk_falls_back_with_few_files(history):
    h = history(commit("1", "a@x", "2023-01-01T00:00:00Z"), change("1", "old.py", 100), commit("2", "a@x", "2024-01-01T00:00:00Z"), change("2", "new.py", 100))
    found = {r.path: r for r in risk.churn_risk(h, 0).collect()}
    assert found["new.py"].label == "active-core" and found["new.py"].age_percentile is None
    assert found["old.py"].trend == 0.0 and found["old.py"].age_days == 365 and found["old.py"].label == "cold"
    assert sum(r.files for r in risk.label_counts(h).collect()) == 2


def test_risk_percentiles_and_labels_agree(history):
    records = [r for i in range(12) for r in (commit(str(i), f"{i % 4}@x", f"2023-{i + 1:02d}-01T00:00:00Z"), change(str(i), f"f{i:02d}", 10 + i))]
    h = history(*records)
    found = risk.churn_risk(h, 0).collect()
    assert sorted(r.age_percentile for r in found) == [i * 100 // 12 for i in range(12)]
    assert {r.label: r.files for r in risk.label_counts(h).collect()} == {x: sum(r.label == x for r in found) for x in {r.label for r in found}}


def test_stream_anchor(history):
    records = [commit("1", date="2024-01-01T00:00:00Z"), change("1", "f", 100), commit("2", date="2024-03-31T00:00:00Z"), change("2", "g", 100)]
    assert dict(rows(ranking.extensions(history(*records, options=Options(anchor="stream")), 0), "ext", "recent_churn")) == {"(none)": 200.0}
    assert dict(rows(ranking.extensions(history(*records), 0), "ext", "recent_churn")) == {"(none)": 150.0}


def test_profile(history):
    h = history(
        commit("1", "a@x", "2024-01-06T10:00:00Z", additions=30, deletions=30, message="m" * 90), change("1", "src/a.py", 30, 30), commit("2", "a@x", "2024-01-08T10:00:00Z", additions=10), change("2", "doc/b.md", 10),
        commit("3", "b@x"), change("3", "src/a.py", 5), change("3", "src/a.py", 0),
    )
    p = profiles.profiles(h, "a@x").first()
    assert (p.commits, p.files_touched, p.active_days, p.pace, p.weekend_pct, p.contrib_ratio, p.contrib_type) == (2, 2, 2, 1.0, 50.0, 0.75, "balanced")
    assert [(x.path, x.lines) for x in p.top_files] == [("src/a.py", 60), ("doc/b.md", 10)] and p.top_commits[0].message == "m" * 77 + "..."
    assert [(x.partner, x.shared_lines) for x in p.collaborators] == [("b@x", 5)] and p.specialization == 0.5 and p.specialist == "focused specialist"
    assert profiles.profiles(h, "A@x").count() == 0 and profiles.profiles(h, n=1).first().email == "a@x"
    assert dict(rows(profiles.directory_focus(h), "email", "specialization")) == {"a@x": 0.5, "b@x": 1.0}


def test_pareto_with_a_bot(history):
    h = history(*(r for i in range(9) for r in (commit(f"b{i}", "bot@x", additions=1), change(f"b{i}", f"d{i}/x", 1))), commit("h", "dev@x", additions=500), change("h", "d0/x", 500))
    found = {r.lens: r for r in ownership.pareto(h).collect()}
    assert found["devs_commits"].top == 1 and found["devs_churn"].top == 1 and found["files_churn"].top == 1 and found["files_churn"].total == 9
    none = {r.lens: r for r in ownership.pareto(history(commit("1"), change("1", "f", 0))).collect()}
    assert none["files_churn"].top == 0 and none["devs_commits"].top == 1


def test_structure(history):
    h = history(commit("1"), change("1", "a/b/c.py", 5), change("1", "a/d.py", 7), change("1", "e", 1), change("1", "a", 2))
    found = {(r.path, r.is_dir): r for r in structure.structure(h).collect()}
    assert found[("", True)].churn == 15 and found[("a", True)].files == 2 and found[("a", False)].churn == 2 and found[("a/b", True)].parent == "a"
    cut = {r.path: r for r in structure.structure(h, max_depth=1).where("is_dir").collect()}
    assert cut["a"].truncated and cut["a"].churn == 12 and "a/b" not in cut
    few = structure.structure(h, max_children=1).collect()
    assert {r.path for r in few} == {"", "a", "a/b", "a/b/c.py"} and next(r for r in few if r.path == "").hidden_children == 2


def test_suspects(history):
    h = history(commit("1"), change("1", "pkg/vendor/x.go", 50), change("1", "vendor/y.go", 5), change("1", "go.sum", 10), change("1", "a.min.js", 1), change("1", "main.go", 100))
    found = structure.suspects(h).collect()
    assert [(r.glob, r.churn, r.suggestions) for r in found] == [("vendor/*", 55, ["pkg/vendor/*", "vendor/*"]), ("go.sum", 10, ["go.sum"]), ("*.min.js", 1, ["*.min.js"])]
    assert found[0].worth_warning and [r.suggestion for r in structure.all_suggestions(h).collect()] == ["pkg/vendor/*", "vendor/*", "go.sum", "*.min.js"]
    assert not structure.suspects(history(commit("1"), change("1", "go.sum", 1), change("1", "m", 99))).first().worth_warning


def test_two_repositories(spark, tmp_path):
    for name, email, sha in (("alpha.v1", "a@x", "s1"), ("beta", "B@x ", "s1")):
        lines = [commit(sha, email, additions=4), change(sha, "README", 4), change(sha, "src/x.py", 1)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, lines)))
    h = load(spark, [str(tmp_path / "alpha.v1.jsonl"), str(tmp_path / "beta.jsonl")])
    assert {r[0] for r in rows(ranking.hotspots(h, 0), "path")} == {"alpha.v1:README", "alpha.v1:src/x.py", "beta:README", "beta:src/x.py"}
    assert rows(ranking.repo_breakdown(h), "repo", "commits", "files", "commits_pct") == [("alpha.v1", 1, 2, 50.0), ("beta", 1, 2, 50.0)]
    assert rows(ranking.repo_breakdown(h, "b@X"), "repo", "commits") == [("beta", 1)]
    assert rows(ranking.extensions(h, 0), "ext", "files") == [("(none)", 2), (".py", 2)]


def test_diff_and_gates(history):
    a = history(commit("1", additions=5), change("1", "f", 5))
    b = history(commit("1", additions=5), commit("2", additions=9), change("2", "g", 9))
    assert dict(rows(compose.diff(a, b), "metric", "delta"))["total_commits"] == 1
    found = compose.gates(a, 1, 1.0).collect()
    assert [(r.rule, r.file) for r in found] == [("busfactor", "f"), ("churn-risk", "f")] and found[0].message == "Bus factor 1 (only a@x)"
    assert compose.gates(a).count() == 0


def test_developers(history):
    from chronolith.sources.jsonl import developers

    h = history(commit("1", "A@x "), commit("2", "a@X"), commit("3", ""), commit("4", "b@x"))
    found = developers(h.commits)
    assert sorted(rows(found, "email")) == [("A@x ",), ("b@x",)] and developers(h.commits, found.where("email = 'b@x'")).count() == 1
