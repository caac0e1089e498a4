"""Partial states of months, merged, against passes over the records."""

import json
import random

import pytest
from history_records import change, commit

from chronolith.operators import merged, ranking
from chronolith.plans import partials
from chronolith.plans.partials import Merged
from chronolith.schema import Options
from chronolith.sources import jsonl


def made_up(seed, days=150, commits=120):
    """Commits over months by a few developers, in a mixed-up order of dates; several files a commit, some without lines."""
    rng, out = random.Random(seed), []
    for i in range(commits):
        day, sha = rng.randrange(days), f"{seed}-{i}"
        out.append(commit(sha, f"d{rng.randrange(9)}@x", f"2024-{day // 28 + 1:02d}-{day % 28 + 1:02d}T{rng.randrange(24):02d}:00:00Z", additions=rng.randrange(50), deletions=3, author_name=f"name {seed} {i}"))
        out += [change(sha, f"{rng.choice('abc')}/{rng.randrange(70)}.{rng.choice(['py', 'go', 'md'])}", rng.choice([0, 0, 5, 9])) for _ in range(rng.randrange(6))]
    return out


def rows(df):
    return sorted(str(r.asDict()) for r in df.collect())


def same(m, h):
    assert rows(merged.contributors(m, 0)) == rows(ranking.contributors(h, 0))
    assert rows(merged.directories(m, 0)) == rows(ranking.directories(h, 0))
    assert rows(merged.extensions(m, 0)) == rows(ranking.extensions(h, 0).drop("recent_churn"))


def test_any_months_equal_a_pass_over_them(spark, history, tmp_path):
    odd = [commit("u", "u@x", "no date"), change("u", "u.py", 4), change("orphan", "a/o.rs", 8), commit("n", "n@x"), commit("z", "z@x"), change("z", "a/z.py", 0)]
    records = made_up(1) + odd
    partials.add(history(*records), str(tmp_path))
    for since, until in (("", ""), ("2024-02", "2024-03"), ("2031-01", "")):
        options = Options(since=f"{since}-01" if since else "", until=f"{until}-31" if until else "")
        same(Merged(spark, str(tmp_path), since, until), history(*records, options=options))
    plan = spark._jvm.PythonSQLUtils.explainString(Merged(spark, str(tmp_path), "2024-02", "2024-02").state("dev_files")._jdf.queryExecution(), "formatted")
    assert "month" in plan.split("PartitionFilters: [")[1].split("\n")[0]  # folders of other months are not opened


def test_parts_merge_and_the_last_can_be_written_again(spark, history, tmp_path):
    """Parts share developers, files, months and days of a month; a part whose end was not reached is not read."""
    folder, first, second, third = str(tmp_path), made_up(1), made_up(2), made_up(3, days=40)
    assert [partials.add(history(*r), folder) for r in (first, second)] == [0, 1]
    (tmp_path / "ended" / "part=1").rename(tmp_path / "gone")  # as if its last step had not been reached
    assert partials.parts(spark, folder) == 1
    assert rows(merged.contributors(Merged(spark, folder), 0)) == rows(ranking.contributors(history(*first), 0))
    assert partials.add(history(*third), folder) == partials.add(history(*third), folder, part=1) == 1
    assert partials.add(history(*second), folder) == 2
    same(Merged(spark, folder), history(*first, *third, *second))
    same(Merged(spark, folder, "2024-02", "2024-02"), history(*first, *third, *second, options=Options("2024-02-01", "2024-02-29")))
    with pytest.raises(ValueError, match="only the last"):
        partials.add(history(*first), folder, part=1)
    ids = [r.id for r in partials.numbers(spark, folder, "files").collect()]
    assert len(set(ids)) == len(ids) == history(*first, *third, *second).files.select("path").distinct().count()


def test_renamed_files_count_under_one_name_and_for_all_their_extensions(spark, history, tmp_path):
    records = [commit("1", "a@x", "2024-01-01T00:00:00Z"), change("1", "old.js", 5), commit("2", "b@x", "2024-02-01T00:00:00Z"), change("2", "new.ts", 2, status="R090", old="old.js"), commit("3", "c@x", "2024-03-01T00:00:00Z"), change("3", "new.ts", 4)]
    h = history(*records)
    partials.add(h, str(tmp_path))
    m = Merged(spark, str(tmp_path))
    same(m, h)
    assert {r.ext: (r.files, r.unique_devs) for r in merged.extensions(m).collect()} == {".js": (1, 3), ".ts": (1, 3)}
    with pytest.raises(ValueError, match="renames"):
        partials.add(h, str(tmp_path))


def test_an_empty_history_and_no_state(spark, history, tmp_path):
    with pytest.raises(FileNotFoundError):
        merged.contributors(Merged(spark, str(tmp_path)))
    partials.add(history({"type": "dev"}), str(tmp_path))
    assert not merged.contributors(Merged(spark, str(tmp_path))).count() + merged.directories(Merged(spark, str(tmp_path))).count()
    records = made_up(4, commits=10)
    partials.add(history(*records), str(tmp_path))
    assert rows(merged.directories(Merged(spark, str(tmp_path)), 0)) == rows(ranking.directories(history(*records), 0))


def test_inputs_in_the_order_given_decide_the_name(spark, tmp_path):
    """Names are those first seen in the input, whatever the months."""
    paths = []
    for i, date in enumerate(("2024-05-01T00:00:00Z", "2024-01-01T00:00:00Z")):
        paths.append(str(tmp_path / f"{i}.jsonl"))
        (tmp_path / f"{i}.jsonl").write_text("\n".join(json.dumps(r) for r in (commit(f"s{i}", "a@x", date, author_name=f"input {i}"), change(f"s{i}", "f.py", 1))))
    h = jsonl.load(spark, paths)
    partials.add(h, str(tmp_path / "state"))
    m = Merged(spark, str(tmp_path / "state"))
    assert rows(merged.contributors(m)) == rows(ranking.contributors(h))
    assert merged.contributors(m).first().name == "input 0"
