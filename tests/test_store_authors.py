"""A store's file rows carry their authors; a query's own lines are packed tightly; staging sorts no rows."""

import json

import pytest
from history_records import change, commit
from test_store import RECORDS, WINDOWS, write

from chronolith import testbed
from chronolith.operators import ownership, ranking, risk
from chronolith.plans.history import History
from chronolith.sources import jsonl, store


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("options", WINDOWS)
def test_authors_of_the_store_are_those_of_the_commits(spark, tmp_path, options):
    more = [commit("again", "other@x", date="2024-03-01T10:00:00Z"), commit("twice", "third@x", date="2024-02-02T10:00:00Z")]
    store.write(spark, write(tmp_path / "h.jsonl", [*RECORDS, *more]), str(tmp_path / "store"))
    h = store.read(spark, str(tmp_path / "store"), options)
    joined = History(h.commits, h.files, h.parents, h.options)
    assert h.owned is not None and rows(h.touches) == rows(joined.touches)
    assert rows(risk.churn_risk(h, 0)) == rows(risk.churn_risk(joined, 0)) and rows(ownership.bus_factor(h, 0)) == rows(ownership.bus_factor(joined, 0))


def test_files_of_a_store_read_no_commits(spark, tmp_path):
    store.write(spark, write(tmp_path / "h.jsonl", [commit("a", "d@x"), change("a", "f", 3)]), str(tmp_path / "store"))
    h = store.read(spark, str(tmp_path / "store"))
    h.commits = None  # no step that puts authors to files needs it
    assert [(r.file, r.email, r.known) for r in h.touches.collect()] == [("f", "d@x", True)]


def test_inputs_of_one_name_and_older_stores_join(spark, tmp_path):
    paths = []
    for folder in "xy":
        (tmp_path / folder).mkdir()
        paths.append(write(tmp_path / folder / "h.jsonl", [commit("same", f"{folder}@x"), change("same", f"{folder}.py", 3)]))
    store.write(spark, paths, str(tmp_path / "store"))
    h = store.read(spark, str(tmp_path / "store"))
    assert h.owned is None and rows(h.touches) == rows(jsonl.load(spark, paths).touches)
    store.write(spark, paths[:1], str(tmp_path / "old"))
    inputs = spark.read.parquet(str(tmp_path / "old" / "inputs")).drop("authored")
    inputs.write.parquet(str(tmp_path / "inputs"))
    (tmp_path / "old" / "inputs").rename(tmp_path / "gone")
    (tmp_path / "inputs").rename(tmp_path / "old" / "inputs")
    assert store.read(spark, str(tmp_path / "old")).owned is None


def test_own_lines_are_dense_and_staging_does_not_sort(spark, history, monkeypatch):
    seen = []
    plain = testbed.write_lines
    monkeypatch.setattr(testbed, "write_lines", lambda s, h, folder, how="none": seen.append(how) or plain(s, h, folder, how))
    before = spark.conf.get(jsonl.OPEN_FILES)
    h = history(*(json.loads(json.dumps(r)) for r in (commit("a", "d@x"), change("a", "f", 3))))
    assert rows(ranking.hotspots(testbed.read_lines(spark, h), 0)) == rows(ranking.hotspots(testbed.read_store(spark, h), 0)) == rows(ranking.hotspots(h, 0))
    assert seen == ["gzip", "gzip"] and spark.conf.get(jsonl.OPEN_FILES) == before
    with jsonl.open_writers(spark):
        assert int(spark.conf.get(jsonl.OPEN_FILES)) == jsonl.WRITERS


def test_shuffled_file_rows_carry_an_unchanged_path_once(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    dealt, by_range = [], DataFrame.repartitionByRange
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda df, *keys: dealt.append(df) or by_range(df, *keys))
    records = [commit("a", "d@x"), change("a", "f", 3), change("a", "new", 1, status="R100", old="old"), change("a", "gone", 2, status="D")]
    path = write(tmp_path / "h.jsonl", records)
    store.write(spark, path, str(tmp_path / "store"))
    (shuffled,) = [df for df in dealt if "previous" in df.columns]
    stored = spark.read.parquet(str(tmp_path / "store/files"))
    assert "same" in shuffled.columns and "same" not in stored.columns
    assert {r.previous: r.current for r in stored.collect()} == {"f": "f", "old": "new", "gone": "gone"}
    assert rows(store.read(spark, str(tmp_path / "store")).files.select("path", "status", "old_path", "new_path")) == rows(jsonl.load(spark, path).files.select("path", "status", "old_path", "new_path"))
