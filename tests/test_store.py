"""The month-clustered store and the streamed store, against the loader."""

import json
import pathlib

import pytest
from history_records import change, commit, parent

from chronolith import cli
from chronolith.operators import pairs, ranking
from chronolith.plans import checkpoints
from chronolith.schema import Limits, Options
from chronolith.sources import jsonl, store
from chronolith.streaming import incremental

#: Orphan rows, a commit that stands twice with two dates, one that stands twice with one, undated commits, copies, deleted and renamed files.
RECORDS = [
    commit("a", date="2024-01-10T00:00:00Z"), parent("a", "x"), parent("a", "y"), change("a", "a.py", 5), change("a", "b.py", 5),
    commit("b", date="2024-02-10T23:59:59-01:00"), change("b", "b.py", 7), parent("b", "a"),
    commit("c", date="?"), change("c", "c.py", 9), change("orphan", "o.py", 11), parent("orphan", "o"),
    commit("twice", date="2024-01-31T10:00:00Z"), commit("twice", date="2024-05-01T10:00:00Z"), change("twice", "t.py", 13), parent("twice", "q"),
    commit("again", date="2024-03-01T10:00:00Z"), commit("again", date="2024-03-01T10:00:00Z"), change("again", "g.py", 15),
    commit("half", date="2024-02-11T10:00:00Z"), commit("half", date="none"), change("half", "h.py", 17),
    {"type": "commit_file", "commit": "b", "path_current": "copy.py", "path_previous": "b.py", "status": "C90", "additions": 1}, {"type": "commit_file", "commit": "a", "path_previous": "gone.py", "status": "D", "deletions": 3},
    {"type": "commit_file", "commit": "b", "path_current": "new.py", "path_previous": "a.py", "status": "R100"}, {"type": "commit_file", "commit": "b"}, {"type": "dev", "email": "z@x"}, {"type": "unheard of"},
]
WINDOWS = [Options(), Options(since="2024-02-01"), Options(until="2024-01-31"), Options("2024-02-01", "2024-02-28"), Options("2024-05-01", "2024-05-01"), Options(since="2030-01-01")]


def write(path, records):
    path.write_text("".join(json.dumps(r) + "\n" for r in records))
    return str(path)


def content(h):
    """All rows of a history, without the places that differ between ways to read it."""
    return [sorted(str(tuple(r)) for r in df.drop("ord").collect()) for df in (h.commits, h.files, h.parents)]


def outcomes(h):
    return [sorted(map(str, x.collect())) for x in (ranking.summary(h), ranking.hotspots(h, 0), ranking.contributors(h, 0), pairs.coupling(h, 0, Limits(coupling_min_changes=1)))]


@pytest.mark.parametrize("options", WINDOWS)
def test_store_equals_loader(spark, tmp_path, options):
    path = write(tmp_path / "h.jsonl", RECORDS)
    store.write(spark, path, str(tmp_path / "store"))
    ours, theirs = store.read(spark, str(tmp_path / "store"), options), jsonl.load(spark, path, options)
    assert content(ours) == content(theirs) == content(jsonl.load(spark, path, options, staged=True))
    if options.since == options.until == "2024-05-01":
        assert outcomes(ours) == outcomes(theirs)


def test_window_of_inputs_that_share_a_name(spark, tmp_path):
    """A commit of two inputs, dated inside the window in one only: rows of the other input go."""
    paths = []
    for folder, date in (("x", "2024-01-01T00:00:00Z"), ("y", "2020-01-01T00:00:00Z")):
        (tmp_path / folder).mkdir()
        paths.append(write(tmp_path / folder / "h.jsonl", [commit("same", date=date), change("same", f"{folder}.py", 3)]))
    store.write(spark, paths, str(tmp_path / "store"))
    window = Options(since="2023-01-01")
    for h in (jsonl.load(spark, paths, window), jsonl.load(spark, paths, window, staged=True), store.read(spark, str(tmp_path / "store"), window)):
        assert [r.path for r in h.files.collect()] == ["h:x.py"] and h.commits.count() == 1
    assert store.read(spark, str(tmp_path / "store")).files.count() == 2


def plan(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_a_window_opens_its_months_alone(spark, tmp_path):
    records = [r for m in range(1, 13) for d in (1, 15) for s in [f"{m:02d}{d:02d}"] for r in (commit(s, date=f"2024-{m:02d}-{d:02d}T00:00:00Z"), change(s, f"f{m}.py", m))]
    store.write(spark, write(tmp_path / "h.jsonl", records), str(tmp_path / "store"))
    h = store.read(spark, str(tmp_path / "store"), Options("2024-03-10", "2024-03-31"))
    assert [(r.sha, r.path) for r in h.files.collect()] == [("0315", "f3.py")]
    text = plan(spark, h.files)
    assert "GreaterThanOrEqual(ts,2024-03-10" in text and "LessThanOrEqual(ts,2024-03-31" in text and "month#" in text.split("PartitionFilters", 1)[1]
    for file in (tmp_path / "store").rglob("*.parquet"):  # what is not opened may be anything
        if "month=" in str(file) and "month=2024-03" not in str(file):
            file.write_bytes(b"no parquet")
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    h = store.read(spark, str(tmp_path / "store"), Options("2024-03-10", "2024-03-31"))
    assert [(r.sha, r.path) for r in h.files.collect()] == [("0315", "f3.py")] and h.commits.count() == 1
    with pytest.raises(Exception, match="no parquet|not a Parquet|FAILED_READ_FILE"):
        store.read(spark, str(tmp_path / "store")).files.collect()


def test_bad_lines_are_named_by_line_and_write_no_store(spark, tmp_path):
    path = tmp_path / "h.jsonl"
    path.write_text('{"type":"commit","sha":"a"}\n\n  \n{"type":"commit","sha":"b"}\nnot json\n')
    with pytest.raises(jsonl.MalformedInput, match="record 3, line 5: not json"):
        store.write(spark, str(path), str(tmp_path / "store"))
    assert not (tmp_path / "store").exists()
    with pytest.raises(jsonl.MalformedInput, match="line 3: .oops"):
        jsonl.load_lines(spark, ["{}", "", "{oops"])


def test_line_numbers_over_splits(spark, tmp_path):
    lines = ['{"type":"commit","sha":"%d","message":"%s"}' % (i, "m" * (i % 90)) if i % 7 else "" for i in range(400)]
    lines[333] = '{"type":"commit","additions":"wrong kind"}'
    path = tmp_path / "with a blank.jsonl"
    path.write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for staged in (False, True):
            with pytest.raises(jsonl.MalformedInput, match="from byte .*, line 334: .*wrong kind"):
                jsonl.load(spark, str(path), staged=staged)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_streamed_store_equals_loader_and_keeps_bad_lines_apart(spark, tmp_path):
    source, kept, check = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "check")
    source.mkdir()
    halves = [RECORDS[:9], RECORDS[9:]]
    for i, records in enumerate(halves):
        write(source / f"{i}.jsonl", records)
        incremental.ingest(spark, str(source), kept, check).awaitTermination()
        incremental.ingest(spark, str(source), kept, check).awaitTermination()  # nothing new: nothing added
    for options in WINDOWS[::3]:
        ours, theirs = incremental.read(spark, kept, options), jsonl.load(spark, str(source), options)
        assert content(ours) == content(theirs)
    assert outcomes(ours) == outcomes(theirs)
    assert incremental.quarantine(spark, kept).count() == 0
    (source / "2.jsonl").write_text('not json\n{"type":"commit","sha":"late","author_email":"l@x","additions":"abc"}\n{"type":"commit","sha":"good","author_email":"g@x"}\n')
    incremental.ingest(spark, str(source), kept, check).awaitTermination()
    assert sorted((r.batch, r.wrong[:8]) for r in incremental.quarantine(spark, kept).collect()) == [(2, "not json"), (2, '{"type":')]
    before = content(incremental.read(spark, kept))
    assert any("'good'" in r for r in before[0]) and not any("'late'" in r for r in before[0])
    batch = spark.read.schema(jsonl.T.StructType(jsonl.RECORD.fields + [jsonl.T.StructField(jsonl.CORRUPT, jsonl.T.StringType())])).json(str(source / "2.jsonl")).selectExpr("*", "_metadata.file_path AS part", "_metadata.file_block_start AS block")
    incremental.write_batch(batch, 2, kept, "in")  # a batch that is run again takes the place of its first run
    assert content(incremental.read(spark, kept)) == before and incremental.quarantine(spark, kept).count() == 2


def test_staged_records_go_when_their_reader_ends(spark, tmp_path, capsys):
    """Of a store's writer, of a command and of one that fails; folders named outside of such a block stay."""
    shared = pathlib.Path(checkpoints.shared_folder(spark))
    kept = pathlib.Path(checkpoints.new_folder(spark))
    kept.mkdir()
    names = lambda: sorted(x.name for x in shared.iterdir())
    before, path = names(), write(tmp_path / "h.jsonl", [commit("a"), change("a", "f.py", 3)])
    store.write(spark, path, str(tmp_path / "store"))
    assert names() == before
    assert cli.main(["stats", "--input", path, "--stat", "summary", "--format", "csv"]) == 0
    assert "total_commits" in capsys.readouterr().out and names() == before
    (tmp_path / "bad.jsonl").write_text("no record")
    assert cli.main(["stats", "--input", str(tmp_path / "bad.jsonl")]) == 2
    assert names() == before and kept.name in before
    assert store.read(spark, str(tmp_path / "store")).files.count() == 1
