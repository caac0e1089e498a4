"""Text forms, pages, the command line, and the queries against their SQL."""

import json

import duckdb
import pytest
from history_records import change, commit

from chronolith import catalog, oracles
from chronolith.cli import STATS, computed, main, parser
from chronolith.operators import compose
from chronolith.sinks import html, render

RECORDS = [commit("1", "a@x", additions=9), change("1", "src/<a>.py", 9), change("1", "b.md", 2), commit("2", "b@x", "2024-02-01T00:00:00Z", additions=3), change("2", "src/<a>.py", 3)]


def test_every_statistic_has_three_forms(history):
    h, args = history(*RECORDS), parser().parse_args(["stats"])
    for stat in STATS:
        for form in ("table", "csv", "json"):
            text = render.statistic(stat, computed(h, stat, args), form)
            assert text
            if form == "json":
                json.loads(text)
    assert render.statistic("hotspots", computed(h, "hotspots", args), "csv") == "path,commits,churn,unique_devs\nsrc/<a>.py,2,12,2\nb.md,1,2,1\n"
    assert json.loads(render.statistic("contributors", computed(h, "contributors", args), "json"))[0]["FilesTouched"] == 2
    assert "├── src/  (1 files, 12 churn)" in render.statistic("structure", computed(h, "structure", args), "table")
    assert render.statistic("structure", computed(h, "structure", args), "csv").splitlines()[:2] == ["path,type,depth,commits,churn,files,truncated", ".,dir,0,0,14,2,false"]


def test_ci_forms(history):
    found = compose.gates(history(*RECORDS), 1).collect()
    assert render.annotations(found, "github-actions").startswith("::warning file=") and json.loads(render.annotations(found, "gitlab"))[0]["severity"] == "minor"
    assert render.annotations([], "json") == "null\n" and render.annotations([], "gitlab") == "[]\n" and "[warning]" in render.annotations(found, "text")


def test_pages(history):
    h = history(*RECORDS)
    text = html.team_report(h, "A & B")
    assert "A &amp; B" in text and "src/&lt;a&gt;.py" in text and all(f"<h2>{x}</h2>" in text for x in ("Concentration", "Churn Risk", "Structure", "Developer Profiles"))
    assert "Per-Repository Breakdown" in html.profile_report(h, "a@x", "a")
    with pytest.raises(LookupError):
        html.profile_report(h, "nobody", "n")


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "h.jsonl"
    path.write_text("\n".join(map(json.dumps, RECORDS)))
    assert main(["stats", "--input", str(path), "--format", "json"]) == 0
    assert set(json.loads(capsys.readouterr().out)) == {s.replace("-", "_") for s in STATS if s not in ("profile", "structure")}
    assert main(["ci", "--input", str(path), "--fail-on-busfactor", "1"]) == 1 and main(["ci", "--input", str(path)]) == 0
    assert main(["diff", "--input", str(path), "--from", "2024-01-01", "--to", "2024-01-31", "--vs-from", "2024-02-01", "--vs-to", "2024-02-28"]) == 0
    assert "total_commits" in capsys.readouterr().out
    assert main(["report", "--input", str(path), "--output", str(tmp_path / "r.html")]) == 0 and (tmp_path / "r.html").read_text().startswith("<!doctype html>")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    for t in ("orders", "lineitem", "part"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    spark_rows = catalog.queries()[name](spark, folder).toPandas()
    sql_rows = duckdb.sql(oracles.oracle_sql()[name]).df()
    assert sorted(spark_rows.columns) == sorted(sql_rows.columns)
    order = sorted(spark_rows.columns)
    text = lambda df: sorted(tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df[order].astype(object).itertuples(index=False))
    assert text(spark_rows) == text(sql_rows)
