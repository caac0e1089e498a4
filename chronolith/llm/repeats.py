"""Fixed-length windows that stand elsewhere too, found without shuffling every window.

A text is a sequence of units (bytes or words). In every window of `size` units one gram of `gram` units is its
anchor: the leftmost of those with the smallest hash. Equal windows have equal anchors, so a window whose
anchor's hash stands nowhere else cannot repeat, and needs no further look: a filter that loses nothing. Windows
with one anchor are neighbours and form a run, about one for every (size - gram) / 2 units.

1. mark():       every text's runs: anchor hash, hash of the content, first window, number of windows;
2. survivors():  runs whose anchor hash is shared;
3. distinct():   their different contents, each with its first place. Where an anchor has one content only, that
                 place settles all windows of all its copies;
4. contents():   what anchors with several contents hold, cut out of the texts once for each content; the caller
                 finds the windows that start earlier elsewhere, by suffix arrays or by counted hashes
                 (by_windows() is the plain form, exact for groups of any size);
5. flagged():    back to the texts: the windows that start earlier elsewhere.

Texts are told apart by id and by a hash of the text, so repeated rows do not multiply in joins; in between, the
number `r` of a marked text stands for both. Tables go as soon as no later step reads them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import discard, saved

U = np.uint64
C = U(0x9E3779B97F4A7C15)
#: Positions are packed below 24 bits of a hash, so longer texts are read in overlapping blocks of this many windows.
BLOCK = 1 << 23
KEYS = ["id", "th"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xFF51AFD7ED558CCD)
    return h ^ (h >> U(32))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2^64 of all runs of n values: powers of two are built up, then put together."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, done, span = None, 0, 1
    while True:
        if n & span:
            out = h if out is None else _join(h, out, done, span)
            done += span
        if span * 2 > n:
            break
        h = h[:-span] * _power(span) + h[span:]
        span *= 2
    return out


def _power(n: int) -> np.uint64:
    return U(pow(int(C), n, 1 << 64))


def _join(high: np.ndarray, low: np.ndarray, done: int, span: int) -> np.ndarray:
    """Hashes of span + done values from those of span (first) and of done (after them)."""
    size = min(len(high), len(low) - span)
    return high[:size] * _power(done) + low[span : span + size]


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (w - span)], v[w - span :]) if w > span else v


def runs(grams: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor hash) of each run. grams: mixed hashes, one for each unit that begins one."""
    w = size - gram + 1
    firsts, lasts, anchors = [], [], []
    windows = len(grams) - w + 1
    for at in range(0, windows, BLOCK):
        part = grams[at : at + BLOCK + w - 1]
        keys = (part & U(0xFFFFFFFFFF000000)) | np.arange(len(part), dtype=np.uint64)
        place = (sliding_min(keys, w) & U(0xFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(place[1:] != place[:-1])[0] + 1])
        firsts.append(first + at)
        lasts.append(np.append(first[1:] - 1, len(place) - 1) + at)
        anchors.append(part[place[first]])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(anchors)


Units = Callable[[bytes], np.ndarray]  # a text's units as hashes


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, text): text as UTF-8 bytes, null as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))


Content = Callable[[bytes, np.ndarray], Callable[[int, int], object]]  # text, hashes -> what windows a to b hold


def mark(texts: DataFrame, units: Units, size: int, gram: int, content: Content) -> DataFrame:
    """(r, id, th, g, rid, l, n): a number for the text, and arrays over its runs; saved."""

    def find(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch["text"]:
                hashes = units(text)
                first, last, anchor = runs(mix(rolled(hashes, gram)), size, gram)
                of = content(text, hashes)
                digests = np.fromiter((xxhash.xxh3_64_intdigest(of(a, b)) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first))
                for column, values in zip(out, (anchor.view(np.int64), digests.view(np.int64), first.astype(np.int32), (last - first + 1).astype(np.int32)), strict=True):
                    column.append(values)
            yield pd.DataFrame({"id": batch["id"], "th": batch["th"], **dict(zip(("g", "rid", "l", "n"), out, strict=True))})

    return saved(texts.mapInPandas(find, "id bigint, th bigint, g array<bigint>, rid array<bigint>, l array<int>, n array<int>").where("size(g) > 0").withColumn("r", F.monotonically_increasing_id()))


def survivors(marked: DataFrame, elsewhere: Column) -> tuple[DataFrame, DataFrame]:
    """(g, rid, id, r, l, n): runs whose anchor hash is shared in the sense of `elsewhere` (an aggregate over id); and (r, id, th). Both saved; `marked` goes."""
    names = saved(marked.select("r", "id", "th"))
    shared = saved(marked.select("id", F.explode("g").alias("g")).groupBy("g").agg(elsewhere.alias("shared")).where("shared").select("g"))
    rows = marked.select("id", "r", F.explode(F.arrays_zip("g", "rid", "l", "n")).alias("x")).select("x.g", "x.rid", "id", "r", "x.l", "x.n")
    found = saved(rows.join(shared, "g"))
    discard(marked, shared)
    return found, names


def distinct(rows: DataFrame) -> DataFrame:
    """(g, rid, first, n, m): the different contents, their first place (id, l, r), and how many contents the anchor has; saved."""
    found = saved(rows.groupBy("g", "rid").agg(F.min(F.struct("id", "l", "r")).alias("first"), F.first("n").alias("n")))
    several = saved(found.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    counted = saved(found.join(several, "g", "left").withColumn("m", F.coalesce("m", F.lit(1))))
    discard(found, several)
    return counted


def contents(texts: DataFrame, names: DataFrame, wanted: DataFrame, units: Units, content: Content, kind: str) -> DataFrame:
    """(g, rid, first, content) of the contents in `wanted`, cut out of the texts of their first places."""
    by_text = wanted.groupBy(F.col("first.r").alias("r")).agg(F.collect_list(F.struct(F.col("first.l").alias("l"), "n", "g", "rid")).alias("cuts"))  # a text's own runs
    by_text = by_text.join(names, "r").drop("r")

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["g", "rid", "id", "l", "content"]
        for batch in batches:
            out = []
            for i, text, cuts in zip(batch["id"], batch["text"], batch["cuts"], strict=True):
                of = content(text, units(text))
                for c in cuts:
                    out.append((c["g"], c["rid"], i, c["l"], of(c["l"], c["l"] + c["n"] - 1)))
                if len(out) > 10_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    return texts.join(by_text, KEYS).mapInPandas(cut, f"g bigint, rid bigint, id bigint, l int, content {kind}")


Earlier = Callable[[Column, Column, Column, Column], Column]  # (id, start) of one place, (id, start) of another: does the first count as earlier?


def _packed(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("bigint"), 32) + b


def by_windows(held: DataFrame, windows: Column, earlier: Earlier) -> DataFrame:
    """(g, rid, s): of each content at its own first place, the windows that start earlier elsewhere, counted by equal windows."""
    each = held.select("g", "rid", "id", "l", F.posexplode(windows).alias("i", "h")).withColumn("l", F.col("l") + F.col("i"))
    least = each.groupBy("g", "h").agg(F.min(F.struct("id", "l")).alias("least"))
    found = each.join(least, ["g", "h"]).where(earlier(F.col("least.id"), F.col("least.l"), F.col("id"), F.col("l")))
    return found.groupBy("g", "rid").agg(F.collect_set(_packed(F.col("i"), F.col("i"))).alias("s"))  # a content's own windows


def flagged(rows: DataFrame, names: DataFrame, contents: DataFrame, starts: DataFrame, earlier: Earlier) -> DataFrame:
    """(id, th, spans): first and last starts of flagged windows, packed in a BIGINT; saved. starts: (g, rid, s) of contents at their first place.

    A run whose content has an earlier place is flagged whole; else its windows are those of the first place.
    """
    i, l = F.col("id"), F.col("l")
    placed = rows.join(contents.select("g", "rid", "first", "m"), ["g", "rid"]).withColumn("whole", earlier(F.col("first.id"), F.col("first.l"), i, l))
    placed = saved(placed.where("whole OR m > 1").select("g", "rid", "r", "l", "n", "whole"))
    whole = placed.where("whole").select("r", F.array(_packed(l, l + F.col("n") - 1)).alias("s"))
    some = placed.where("NOT whole").join(starts, ["g", "rid"]).select("r", F.transform("s", lambda x: x + _packed(l, l)).alias("s"))
    spans = whole.unionAll(some).groupBy("r").agg(F.flatten(F.collect_list("s")).alias("spans"))  # a text's own windows
    found = saved(spans.join(names, "r").groupBy(*KEYS).agg(F.first("spans").alias("spans")))  # a row that is repeated has two numbers, and the same spans under both
    discard(rows, contents, starts, placed, names)
    return found


def covered(units: int, spans: np.ndarray | None, size: int) -> np.ndarray:
    """Boolean per unit: inside a flagged window."""
    edge = np.zeros(units + 1, np.int64)
    if spans is not None and len(spans):
        packed = np.asarray(spans, np.int64)
        np.add.at(edge, packed >> 32, 1)
        np.add.at(edge, np.minimum((packed & 0xFFFFFFFF) + size, units), -1)
    return np.cumsum(edge[:-1]) > 0
