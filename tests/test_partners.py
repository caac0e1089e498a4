"""Pairs of developers where files have many: tiles and bounds, against plain Python."""

import random
from collections import defaultdict

import pytest
from history_records import change, commit
from pyspark.sql import functions as F

from chronolith.operators import pairs, partners
from chronolith.schema import Limits


def sample(seed, files=7, people=14):
    rng = random.Random(seed)
    lines = {}
    for f in range(files):
        for d in rng.sample(range(people), rng.randint(1, people)):
            lines[f"f{f}", f"d{d:02d}@x"] = rng.choice([1, 1, 2, 5, 9, 40, 41])
    return lines


def plain(lines):
    """(a, b) -> (lines, files), both ways."""
    out = defaultdict(lambda: [0, 0])
    for (f, a), la in lines.items():
        for (g, b), lb in lines.items():
            if f == g and a != b:
                out[a, b][0] += min(la, lb)
                out[a, b][1] += 1
    return out


def made(history, lines):
    people = sorted({d for _, d in lines})
    return history(*(commit(d, d) for d in people), *(change(d, f, n) for (f, d), n in lines.items()))


@pytest.mark.parametrize(("block", "seed"), [(512, 1), (3, 1), (2, 2), (1, 3)])
def test_network_and_collaborators(history, monkeypatch, block, seed):
    monkeypatch.setattr(pairs, "BLOCK", block)
    lines = sample(seed)
    h, shared = made(history, lines), plain(lines)
    found = {(r.dev_a, r.dev_b): (r.shared_lines, r.shared_files) for r in pairs.dev_network(h, 0, Limits(network_min_files=2)).collect()}
    assert found == {(a, b): tuple(x) for (a, b), x in shared.items() if a < b and x[1] >= 2}
    for mine in (h.authored, h.authored.where("email < 'd04@x'")):
        wanted = {}
        for a in {r.email for r in mine.collect()}:
            ranked = sorted(((-n, -m, b) for (x, b), (n, m) in shared.items() if x == a))
            if ranked:
                wanted[a] = ([(b, -m, -n) for n, m, b in ranked[:3]], max(0, len(ranked) - 3))
        assert {r.email: ([(c.partner, c.shared_files, c.shared_lines) for c in r.collaborators], r.collaborators_hidden) for r in partners.collaborators(h, mine, 3).collect()} == wanted


@pytest.mark.parametrize("lines", ["1", "1 + pmod(xxhash64(id), 997)"])
def test_a_file_of_forty_thousand_developers_makes_few_pairs(spark, lines):
    rows = spark.range(40_000).select(F.lit("f").alias("file"), F.concat("id", F.lit("@x")).alias("email"), F.expr(lines).cast("bigint").alias("lines"))
    found = partners.candidates(rows, rows, 5)
    assert found.count() < 40_000 * 40  # of 1.6 billion
    best = {r.email: r for r in partners.collaborators(type("H", (), {"authored": rows})(), rows.where("email = '77@x'"), 5).collect()}["77@x"]
    held = sorted(((-min(int(r.lines), mine), r.email) for mine in [rows.where("email = '77@x'").first().lines] for r in rows.collect() if r.email != "77@x"))[:5]
    assert [(c.partner, c.shared_lines) for c in best.collaborators] == [(e, -n) for n, e in held] and best.collaborators_hidden == 39_994
