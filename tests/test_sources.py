"""The log parser, extraction, discovery and streams."""

import json
import os
import shutil
import subprocess
import threading

import pytest
from history_records import change, commit

from chronolith.operators import ranking
from chronolith.sources import discovery, extract, jsonl, vcs
from chronolith.sources.jsonl import MalformedInput, load

needs_git = pytest.mark.skipif(not shutil.which("git"), reason="no git here")


@pytest.mark.parametrize(("text", "old", "new"), [("a.go", "a.go", "a.go"), ("a => b", "a", "b"), ("src/{a => b}/x", "src/a/x", "src/b/x"), ("{old => new}/f", "old/f", "new/f"), ("a/{ => s}/f", "a//f", "a/s/f")])
def test_numstat_paths(text, old, new):
    assert vcs.moved_paths(text) == (old, new)


def test_raw_lines():
    assert vcs.parse_raw(":1 2 aa bb M\tf") == vcs.Change("M", "aa", "bb", "f", "f")
    assert vcs.parse_raw(":1 2 aa 00 D\tf") == vcs.Change("D", "aa", "00", "f", "")
    assert vcs.parse_raw(":1 2 aa bb R090\told name\tnew name") == vcs.Change("R090", "aa", "bb", "old name", "new name")
    assert vcs.parse_raw("M f") is None and vcs.parse_raw(":1 2 aa") is None


def test_blocks_and_binary_files():
    meta = "\x1f".join(["s" * 40, "t", "p1 p2", "A", "a@x", "2024-01-01T00:00:00Z", "C", "c@x", "2024-01-01T00:00:00Z", "message\n"])
    block = f"{meta}\x1e\x02\n\n:1 2 aa bb M\tf\n:1 2 aa bb M\tb\n3\t4\tf\n-\t-\tb\nnoise\n".encode()
    found = vcs.parse_block(block)
    assert found.meta["parents"] == ["p1", "p2"] and found.meta["message"] == "message" and found.lines == {"f": (3, 4), "b": (0, 0)}
    kept = list(vcs.records(found, lambda p: p == "f"))
    assert (kept[0]["additions"], kept[0]["files_changed"]) == (3, 1) and [r["type"] for r in kept] == ["commit", "commit_parent", "commit_parent", "commit_file"]
    with pytest.raises(vcs.LogError):
        vcs.parse_block(b"nothing")

    class Slow:
        def __init__(self, data):
            self.data = data

        def read(self, _):
            head, self.data = self.data[:3], self.data[3:]
            return head

    assert list(vcs.blocks(Slow(b"\x00\x01abc\x00\x01\x00\x01d\x00e"))) == [b"abc", b"d\x00e"]


def test_states(tmp_path):
    path = tmp_path / "state"
    assert extract.load_state(str(path)) == extract.State()
    for text, state in (("", extract.State()), ("12", extract.State(commit_offset=12)), (json.dumps({"last_processed_sha": "a" * 40}), extract.State("a" * 40))):
        path.write_text(text)
        assert extract.load_state(str(path)) == state
    for text in ("-1", "garbage", '{"commit_offset": -3}', '{"last_processed_sha": "zz"}'):
        path.write_text(text)
        with pytest.raises(extract.StateError):
            extract.load_state(str(path))
    with pytest.raises(extract.StateError):
        extract.load_state(str(path), 3, "a" * 40)
    with pytest.raises(extract.StateError):
        extract.load_state(str(path), sha="abc")


def make_repo(path, commits=3):
    git = lambda *a: subprocess.run(["git", "-C", str(path), "-c", "user.name=Ann", "-c", "user.email=Ann@x", *a], check=True, capture_output=True)
    os.makedirs(path)
    git("init", "-q", "-b", "main")
    for i in range(commits):
        (path / "a.txt").write_text("line\n" * (i + 1))
        (path / f"f{i}.lock").write_text("x\n")
        git("add", ".")
        git("commit", "-q", "-m", f"change {i}")
    return str(path)


@needs_git
def test_extract_and_resume(spark, tmp_path):
    repo, out = make_repo(tmp_path / "r"), str(tmp_path / "o.jsonl")
    assert extract.extract(repo, out, ignore=["*.lock"], messages=True, sizes=True) == 3
    h = jsonl.load(spark, out)
    s = ranking.summary(h).first()
    assert (s.total_commits, s.total_files, s.total_additions) == (3, 1, 3)
    records = [json.loads(line) for line in open(out)]
    assert sum(r["type"] == "dev" for r in records) == 1 and next(r for r in records if r["type"] == "commit")["message"] == "change 2"
    assert next(r for r in records if r["type"] == "commit_file")["new_size"] == 15
    assert extract.extract(repo, out) == 0
    assert extract.extract(repo, out, offset=2) == 1
    assert sum(json.loads(line)["type"] == "dev" for line in open(out)) == 1
    assert vcs.default_branch(repo) == "main"


@needs_git
def test_blob_sizes_come_in_one_exchange(tmp_path):
    repo = make_repo(tmp_path / "r")
    hashes = [vcs.git(repo, "rev-parse", f"HEAD~{back}:a.txt") for back in range(3)]
    commit, absent = vcs.git(repo, "rev-parse", "HEAD"), "1" * 40
    blobs = vcs.BlobSizes(repo, remembered=2)
    expected = dict(zip(hashes, (15, 10, 5), strict=True)) | {commit: 0, absent: 0}
    for _ in range(2):
        assert blobs.sizes([*hashes, commit, absent, "0" * 40, "", hashes[0]]) == expected
    assert blobs.sizes(hashes * 5_000) == dict(zip(hashes, (15, 10, 5), strict=True)) and blobs.sizes([]) == {}
    assert len(set(blobs.sizes(f"{i:040x}" for i in range(1, 20_001)).values())) == 1  # more than a pipe holds
    blobs.close()
    assert blobs.sizes([absent]) == {absent: 0}


@needs_git
def test_repository_as_a_source(spark, tmp_path):
    repo = make_repo(tmp_path / "r", 2)
    spark.dataSource.register(vcs.VcsLog)
    found = spark.read.format("vcslog").load(repo)
    assert found.where("type = 'commit'").count() == 2 and found.where("type = 'commit_file'").count() == 4


@needs_git
def test_scan(tmp_path):
    for place in ("x/one", "y/one", "skip/two", "deep/a/b/three"):
        make_repo(tmp_path / "in" / place, 1)
    (tmp_path / "in" / "broken").mkdir()
    (tmp_path / "in" / "broken" / ".git").write_text("gitdir: nowhere")
    manifest = discovery.scan([str(tmp_path / "in")], str(tmp_path / "out"), discovery.Matcher(["skip/"]), max_depth=2)
    found = {e.slug.split("-")[0]: e.status for e in manifest.repositories}
    assert found == {"one": "ok", "broken": "failed"} and len(manifest.repositories) == 3
    assert json.load(open(tmp_path / "out" / "manifest.json"))["repositories"][0]["slug"]


@pytest.mark.parametrize(("rules", "path", "ignored"), [
    (["vendor"], "a/vendor", True), (["vendor", "!a/vendor"], "a/vendor", False), (["**/tmp"], "x/tmp", True), (["# no", ""], "no", False), (["a/*"], "a/b", True), (["a*"], "abc", True), (["b/"], "b", True), (["!x", "x"], "x", True),
])
def test_matcher(rules, path, ignored):
    assert discovery.Matcher(rules).match(path, True) is ignored


def test_matcher_descends_for_exceptions():
    m = discovery.Matcher(["vendor", "!vendor/keep"])
    assert m.could_reinclude("vendor") and not m.could_reinclude("other/deep") and not discovery.Matcher(["b/"]).match("b", False)


def test_slugs():
    repos = [discovery.Repository(p, p) for p in ("/a/Repo", "/b/repo", "/c/index", "/d/ü x")]
    discovery.assign_slugs(repos)
    slugs = [r.slug for r in repos]
    assert slugs[3] == "__x" and slugs[2].startswith("index-") and len({s.lower() for s in slugs}) == 4


def test_streams(spark, tmp_path):
    from chronolith.streaming import incremental

    source, store, check = (str(tmp_path / x) for x in ("in", "store", "check"))
    os.makedirs(source)
    for i in range(2):
        with open(f"{source}/{i}.jsonl", "w") as file:
            file.write("\n".join(map(json.dumps, [commit(f"c{i}", additions=2), change(f"c{i}", "f")])))
        incremental.ingest(spark, source, store, check).awaitTermination()
        assert spark.read.parquet(store).where("type = 'commit'").count() == i + 1
    stream = spark.readStream.schema(jsonl.RECORD).json(source)
    query = incremental.activity(stream).writeStream.outputMode("complete").format("memory").queryName("buckets").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.commits, r.additions) for r in spark.table("buckets").collect()] == [(2, 4)]


def test_inputs_that_share_a_name_and_folders(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.jsonl").write_text(json.dumps({"type": "commit", "sha": folder, "author_email": f"{folder}@x", "author_date": "2024-01-01T00:00:00Z"}) + "\n")
    h = load(spark, [str(tmp_path / "a" / "same.jsonl"), str(tmp_path / "b" / "same.jsonl")])
    assert [(r.repo, r.sha) for r in h.commits.orderBy("ord").collect()] == [("same", "a"), ("same", "b")]
    assert load(spark, str(tmp_path / "a"), staged=True).commits.count() == 1


@pytest.mark.parametrize("staged", [False, True])
def test_fields_of_another_type_are_an_error_with_their_place(spark, tmp_path, staged):
    path = tmp_path / "h.jsonl"
    path.write_text('{"type":"commit","sha":"a"}\n{"type":"commit","sha":"b","additions":"abc"}\n')
    with pytest.raises(MalformedInput, match="record 2.*abc"):
        load(spark, str(path), staged=staged)


def test_a_scan_that_is_stopped_skips_what_has_not_begun(tmp_path):
    stop, begun = threading.Event(), []
    for name in ("one", "two", "three"):
        (tmp_path / "src" / name / ".git").mkdir(parents=True)
        for part in ("HEAD", "objects", "refs"):
            (tmp_path / "src" / name / ".git" / part).mkdir() if part != "HEAD" else (tmp_path / "src" / name / ".git" / part).write_text("ref: refs/heads/main")

    def run(path, output, state, **_):
        begun.append(path)
        stop.set()
        return 1

    manifest = discovery.scan([str(tmp_path / "src")], str(tmp_path / "out"), parallel=1, run=run, stop=stop)
    assert [e.status for e in manifest.repositories] == ["ok", "skipped", "skipped"] and len(begun) == 1
    written = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert written["generated_at"] and written["repositories"][0]["state_file"].endswith(".state")


def test_an_extraction_that_is_stopped_keeps_its_state(tmp_path, monkeypatch):
    from chronolith.sources import extract as module

    fake = [type("C", (), {"meta": {"sha": f"{i:040x}", "author_email": "", "committer_email": ""}})() for i in range(5)]
    monkeypatch.setattr(module, "commits", lambda _: iter(fake))
    monkeypatch.setattr(module, "records", lambda *_: [])
    asked = iter([False, False, True])
    with pytest.raises(module.Stopped):
        module.extract(str(tmp_path), str(tmp_path / "o.jsonl"), stopped=lambda: next(asked))
    assert module.load_state(str(tmp_path / "o.jsonl.state")).commit_offset == 2
