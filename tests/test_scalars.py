"""Column expressions and plain helpers against tables of cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronolith.cli import UsageError, main, parser, since_date, window
from chronolith.functions import scalars as S
from chronolith.sinks import html, render
from chronolith.sources.extract import should_ignore


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


EXTENSIONS = [
    ("main.go", ".go"), ("a/b/C.PNG", ".png"), ("Makefile", "(none)"), (".gitignore", ".gitignore"), (".env.local", ".local"), ("a.tar.gz", ".gz"), ("foo.", "(none)"), (".", "(none)"), ("", "(none)"), ("dir.d/file", "(none)"),
    ("repo.v1:Makefile", "(none)"), ("repo.v1:x.py", ".py"), ("repo:", "(none)"), ("..", "(none)"), ("a/.ESLINTRC", ".eslintrc"),
]


def test_extension(spark):
    frame = spark.createDataFrame(EXTENSIONS, "x string, y string")
    assert [(r.x, r.e) for r in frame.select("x", S.extension(F.col("x")).alias("e")).collect()] == EXTENSIONS


def test_paths(spark):
    assert one(spark, "a/b/c", S.dirname) == "a/b" and one(spark, "c", S.dirname) == "." and one(spark, "r:a/b", S.strip_repo) == "a/b" and one(spark, "a/b:c", S.strip_repo) == "a/b:c"


def test_times(spark):
    assert one(spark, "2024-01-31T23:30:00-05:30", S.utc_time) == dt.datetime(2024, 2, 1, 5, 0) and one(spark, "2024-01-31T23:30:00.5+02:00", S.local_time) == dt.datetime(2024, 1, 31, 23, 30)
    assert one(spark, "2024-01-15", S.utc_time) is None and one(spark, "2024-13-01T00:00:00Z", S.utc_time) is None
    assert one(spark, dt.date(2024, 5, 31), lambda c: S.minus_months(c, 3), "date") == dt.date(2024, 3, 2)
    assert one(spark, 0.25, lambda c: S.round_k(c, 1), "double") == 0.3 and one(spark, dt.datetime(2021, 1, 3), S.iso_week, "timestamp_ntz") == "2020-W53"


def test_message_is_cut_in_bytes(spark):
    text = one(spark, "é" * 41, lambda c: S.cut_message(c, 80, 77))
    assert text.endswith("...") and len(text.encode()) <= 83 and one(spark, "x" * 80, lambda c: S.cut_message(c, 80, 77)) == "x" * 80


IGNORED = [
    ("a/package-lock.json", ["package-lock.json"], True), ("dist/x/y.js", ["dist/*"], True), ("pkg/dist/y.js", ["dist/*"], False), ("dist/y", ["dist/"], True), ("distant/y", ["dist*"], False), ("dist/y", ["dist*"], True),
    ("a/b.min.js", ["*.min.js"], True), ("a/b.js", ["a/*.js"], True), ("a/c/b.js", ["a/*.js"], False), ("x1", ["x[0-9]"], True), ("xa", ["x[^0-9]"], True), ("x", [], False), ("a.b", ["a?b"], True),
]


@pytest.mark.parametrize(("path", "patterns", "expected"), IGNORED)
def test_ignore_rules_agree(spark, path, patterns, expected):
    assert should_ignore(path, patterns) is expected
    assert one(spark, path, lambda c: S.ignored(c, patterns)) is expected


def test_relative_windows():
    today = dt.date(2024, 5, 31)
    assert [since_date(x, today) for x in ("7d", "2w", "3m", "1y")] == ["2024-05-24", "2024-05-17", "2024-03-02", "2023-05-31"]
    for bad in ("", "d", "0d", "3x", "-1d"):
        with pytest.raises(UsageError):
            since_date(bad)
    for flags in (["--since", "7d", "--from", "2024-01-01"], ["--from", "2024-02-01", "--to", "2024-01-01"], ["--from", "2024-1-1"]):
        with pytest.raises(UsageError):
            window(parser().parse_args(["stats", *flags]))
    assert main(["stats", "--from", "x"]) == 2


def test_text_helpers():
    assert [render.humanize(n) for n in (999, 1000, 1234, 2_000_000, 3_100_000_000)] == ["999", "1k", "1.2k", "2M", "3.1B"]
    assert render.shell_quoted("a'b") == "'a'\\''b'" and render.joined_devs(list("abcde")) == "a, b, c +2"
    now = dt.date(2024, 12, 31)
    assert [html.ago(x, now) for x in ("2024-12-31", "2024-12-21", "2024-11-01", "2024-01-02", "2022-12-31", "2025-01-01", "?")] == [("today", "fresh"), ("10d ago", "fresh"), ("2mo ago", "stable"), ("11mo ago", "stable"), ("2y ago", "stale"), ("", ""), ("", "")]


def test_herfindahl(spark):
    from chronolith.operators.ownership import herfindahl

    frame = spark.createDataFrame([([1, 1],), ([4, -4],), ([],)], "x array<bigint>")
    assert [r.y for r in frame.select(herfindahl(F.col("x")).alias("y")).collect()] == [0.5, 1.0, 0.0]


def test_labels_and_links(tmp_path, monkeypatch):
    from chronolith.cli import file_link, scan_label

    assert [scan_label(r) for r in ([], ["/home/me/work/"], ["/a/one", "/b/two"], ["/a/one", "/b/two", "/c/three"], ["/a/x"] * 4)] == ["scan", "work", "one + two", "one + two + three", "4 roots"]
    monkeypatch.chdir(tmp_path)
    assert scan_label(["."]) == tmp_path.name and file_link("a page#1.html") == f"file://{tmp_path}/a%20page%231.html"
