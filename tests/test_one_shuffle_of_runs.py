"""Pairs and counts of files read the file rows once; a store's shuffles leave out what the input's number tells; a part's folders are released."""

import os
import pathlib

import pytest
from history_records import change, commit, parent
from pyspark.sql import functions as F

from chronolith import testbed
from chronolith.operators import pairs
from chronolith.plans import checkpoints, runs
from chronolith.plans.history import History
from chronolith.plans.together import together
from chronolith.schema import Limits, Options
from chronolith.sources import jsonl, store
from test_store import RECORDS, write

ANY = Limits(coupling_min_changes=1)


def test_pairs_and_counts_read_file_rows_once(spark, history):
    plain = history(*(commit(f"c{i}") for i in range(20)), *(change(f"c{i}", p, 5) for i in range(20) for p in "ab"))
    read = spark.sparkContext.accumulator(0)

    def counted(path):
        read.add(1)
        return path

    files = plain.files.withColumn("path", F.udf(counted, "string")("path"))
    h = History(plain.commits, files, plain.parents, Options(), renames=False)
    assert [(r.file_a, r.file_b, r.co_changes, r.changes_a, r.changes_b) for r in pairs.coupling(h, 0, ANY).collect()] == [("a", "b", 20, 20, 20)]
    assert read.value == 40


@pytest.mark.parametrize("splits", [0, 100_000])
def test_splits_are_joined_or_broadcast(spark, tmp_path, monkeypatch, splits):
    monkeypatch.setattr(runs, "SPLITS", splits)
    folder = tmp_path / "h.jsonl"
    folder.mkdir()
    write(folder / "0.jsonl", [commit("a"), change("a", "x", 5), change("a", "y", 5)])
    write(folder / "1.jsonl", [change("a", "z", 5), commit("b"), change("b", "x", 5), change("b", "y", 5)])
    found = {(r.file_a, r.file_b): (r.co_changes, r.changes_a, r.changes_b) for r in pairs.coupling(jsonl.load(spark, str(folder), staged=True), 0, ANY).collect()}
    assert found == {("x", "y"): (2, 2, 2), ("x", "z"): (1, 2, 1), ("y", "z"): (1, 2, 1)}


def test_shuffles_of_a_store_carry_no_repository(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    dealt, by_range = [], DataFrame.repartitionByRange
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda df, *keys: dealt.append(df.columns) or by_range(df, *keys))
    paths = [write(tmp_path / f"{n}.jsonl", [commit(f"{n}c"), change(f"{n}c", "f.py", 3), parent(f"{n}c", "p")]) for n in ("one", "two")]
    store.write(spark, paths, str(tmp_path / "store"))
    assert len(dealt) == 3 and not any("repo" in columns for columns in dealt)
    h = store.read(spark, str(tmp_path / "store"))
    assert {r.repo: r.path for r in h.files.collect()} == {"one": "one:f.py", "two": "two:f.py"}
    assert {r.repo for r in h.commits.collect()} == {r.repo for r in h.parents.collect()} == {"one", "two"}


def test_stores_and_staged_records_are_packed_tightly(spark, tmp_path):
    store.write(spark, write(tmp_path / "h.jsonl", RECORDS), str(tmp_path / "store"))
    for table in ("commits", "files", "parents"):
        names = [f.name for f in (tmp_path / "store" / table).rglob("*.parquet")]
        assert names and all(".zstd." in n for n in names)
    assert all(".zstd." in f for f in jsonl.staged_rows(spark, [str(tmp_path / "h.jsonl")]).inputFiles())


def test_folders_of_parts_go_with_the_block(spark):
    with checkpoints.released():
        found = together(spark, {"a": lambda: checkpoints.written(spark.range(3)).inputFiles()})["a"]
        files = [f.removeprefix("file://") for f in found]
        assert files and all(os.path.exists(f) for f in files)
    assert not any(os.path.exists(f) for f in files)


def test_lines_go_when_their_store_is_written(spark, history):
    shared = pathlib.Path(checkpoints.shared_folder(spark))
    before = set(shared.iterdir())
    h = testbed.read_store(spark, history(commit("a"), change("a", "f.py", 3)))
    (left,) = set(shared.iterdir()) - before
    assert not list(left.rglob("*.jsonl")) and h.files.count() == 1
