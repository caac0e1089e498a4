"""Suffix-array dedup: bytes covered by a 100-byte string that starts earlier are removed.

Runs of windows whose anchor stands elsewhere too (see repeats) are cut out of the documents, equal ones are
put together, and the distinct ones are dealt to shards by anchor, so equal windows share a shard or, where one
anchor has more contents than a shard holds, neighbouring shards. Each shard is one text. Its suffix array is
built by Larsson-Sadakane refinement (prefix doubling that sorts only groups not yet told apart), Kasai's walk
gives the common prefixes, and neighbours with a common prefix of the window's size form a class with one first
place. Shards of one anchor are merged by binary search of their classes' strings in the sorted list so far.

An anchor with more contents than MERGED is more than one task should hold. Its contents are dealt over parts of
about MERGED each, by their hashes. Every part builds its shards and hands on its classes, sorted, with their first
places; the lists of all parts are dealt by string and merged by binary search, a bucket of strings in each task;
first places that lie in another part go back to the parts that hold the string.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import discard, saved, small, table
from chronolith.llm.repeats import KEYS, contents, covered, distinct, flagged, keyed, mark, mix, survivors

WINDOW = 100
GRAM = 32
SHARD_BYTES = 1 << 19
MERGED = 4_000
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def byte_hashes(text: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(text, np.uint8)]


def _cut(size: int) -> Callable:
    def of(text: bytes, _: np.ndarray) -> Callable[[int, int], bytes]:
        return lambda a, b: text[a : b + size]

    return of


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes' starts in sorted order. text: byte values plus 1; 0 stands between parts.

    Larsson-Sadakane: ranks for a prefix length h give the order for 2h; suffixes alone in their group are done.
    """
    n = len(text)
    keys = np.zeros(n, np.uint64)
    padded = np.zeros(n + 7, np.uint64)
    padded[:n] = text
    for i in range(7):  # seven values of nine bits
        keys = (keys << np.uint64(9)) | padded[i : i + n]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = ranked[1:] != ranked[:-1]
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = heads
    h = 7
    while True:
        alone = new & np.append(new[1:], True)
        open_ = np.nonzero(~alone)[0]
        if not len(open_):
            return order
        suffixes = order[open_]
        ahead = suffixes + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[suffixes]
        inner = np.lexsort((second, group))
        suffixes, second, group = suffixes[inner], second[inner], group[inner]
        order[open_] = suffixes
        split = np.empty(len(open_), bool)
        split[:1] = True
        split[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        new[open_] = split
        heads = open_[np.maximum.accumulate(np.where(split, np.arange(len(open_)), 0))]
        rank[suffixes] = heads
        h *= 2


def common_prefixes(joined: bytes, begins: np.ndarray, ends: np.ndarray, steps: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Kasai's walk: for each place, the common prefix (`limit` at most, inside parts) with the suffix before it in the order.

    A step to the next place of a part loses one unit of its prefix at most, so only what lies beyond is compared.
    The parts are walked side by side, eight bytes at a time; `steps` is how many places of each part count.
    """
    n = len(joined)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    raw = np.frombuffer(joined + bytes(8), np.uint8)
    eight = np.lib.stride_tricks.as_strided(raw, (n + 1, 8), (1, 1)).copy().view("<u8").ravel()
    end_of = np.repeat(ends, ends + 1 - begins)[:n]
    out = np.zeros(n, np.int64)
    lanes = np.argsort(-steps, kind="stable")
    begins, steps = begins[lanes], steps[lanes]
    h = np.zeros(len(begins), np.int64)
    for k in range(int(steps.max(initial=0))):
        many = int(np.searchsorted(-steps, -k, side="left"))  # parts with more than k places
        i = begins[:many] + k
        j = before[i]
        known = np.maximum(h[:many] - 1, 0)
        top = np.where(j >= 0, np.minimum(limit, np.minimum(end_of[i] - i, end_of[j] - j)), 0)
        known = np.minimum(known, top)
        open_ = np.nonzero(known < top)[0]
        while len(open_):
            x = eight[i[open_] + known[open_]] ^ eight[j[open_] + known[open_]]
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8)
            known[open_] = np.minimum(known[open_] + same, top[open_])
            open_ = open_[(same == 8) & (known[open_] < top[open_])]
        h[:many] = known
        out[i] = known
    return out


def shard_classes(bodies: list[bytes], ids: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], list[tuple[int, int]]]:
    """Classes of equal windows of a shard: (content, window, class) of every window; strings and first places by class, sorted by string."""
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    joined = b"\0".join(bodies)
    text = np.frombuffer(joined, np.uint8).astype(np.uint16) + 1
    text[begins[1:] - 1] = 0
    windows = sizes - size + 1
    owner = np.repeat(np.arange(len(bodies)), windows)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begins[owner] + inner
    window_of = np.full(len(text), -1, np.int64)
    window_of[at] = np.arange(len(at))
    order = suffix_array(text)
    prefix = common_prefixes(joined, begins, begins + sizes, windows, order, size)[order]
    own = window_of[order] >= 0
    # a suffix between two equal windows shares their bytes and so is a window itself
    chain = np.cumsum(prefix < size)
    ranked = window_of[order][own]
    klass = np.unique(chain[own], return_inverse=True)[1]
    doc, pos = ids[owner[ranked]], starts[owner[ranked]] + inner[ranked]
    by_place = np.lexsort((pos, doc, klass))
    heads = by_place[np.concatenate([[True], klass[by_place][1:] != klass[by_place][:-1]])]
    strings = [joined[a : a + size] for a in at[ranked[heads]].tolist()]
    return owner[ranked], inner[ranked], klass, strings, list(zip(doc[heads].tolist(), pos[heads].tolist(), strict=True))


class Merge:
    """Sorted window strings with their first places; shards are added by binary search."""

    def __init__(self) -> None:
        self.strings = np.zeros(0, object)
        self.places = np.zeros(0, object)

    def add(self, strings: list[bytes], places: list[tuple[int, int]]) -> None:
        new = np.empty(len(strings), object)
        new[:] = strings
        where = np.searchsorted(self.strings, new)
        held = np.empty(len(places), object)
        held[:] = places
        known = np.zeros(len(new), bool)
        inside = where < len(self.strings)
        known[inside] = self.strings[where[inside]] == new[inside]
        for i in np.nonzero(known)[0].tolist():
            w = where[i]
            self.places[w] = min(self.places[w], held[i])
        self.strings = np.insert(self.strings, where[~known], new[~known])
        self.places = np.insert(self.places, where[~known], held[~known])

    def find(self, strings: list[bytes]) -> list[tuple[int, int]]:
        new = np.empty(len(strings), object)
        new[:] = strings
        return self.places[np.searchsorted(self.strings, new)].tolist()


Row = tuple[int, int, int, int, bytes]  # g, rid, id, l, content
ROW = ["g", "rid", "id", "l", "content"]
STARTS = "g bigint, rid bigint, s array<bigint>"


def _rows(batch: pd.DataFrame) -> Iterator[Row]:
    return zip(*(batch[c].tolist() for c in ROW), strict=True)


def _shards(rows: Iterable[Row]) -> list[list[Row]]:
    out, held = [[]], 0
    for r in rows:
        if held > SHARD_BYTES:
            out.append([])
            held = 0
        out[-1].append(r)
        held += len(r[4])
    return out


def _classes(shard: list[Row], size: int) -> tuple:
    return shard_classes([r[4] for r in shard], np.array([r[2] for r in shard], np.int64), np.array([r[3] for r in shard], np.int64), size)


def _merged(built: Iterable[tuple]) -> Merge:
    merged = Merge()
    for b in built:
        merged.add(b[3], b[4])
    return merged


def _earlier(shard: list[Row], built: tuple, places: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
    """STARTS of a shard's windows whose class has an earlier first place."""
    owner, inner, klass, _, _ = built
    place = np.array(places, np.int64).reshape(-1, 2)[klass]
    own_id = np.array([r[2] for r in shard], np.int64)[owner]
    own_start = np.array([r[3] for r in shard], np.int64)[owner] + inner
    earlier = (place[:, 0] < own_id) | ((place[:, 0] == own_id) & (place[:, 1] < own_start))
    owner, inner = owner[earlier], inner[earlier]
    if not len(owner):  # every window of the shard is the first
        return
    in_text = np.lexsort((inner, owner))
    owner, inner = owner[in_text], inner[in_text]
    head = np.ones(len(owner), bool)
    head[1:] = (owner[1:] != owner[:-1]) | (inner[1:] != inner[:-1] + 1)
    a, last = np.nonzero(head)[0], np.append(np.nonzero(head)[0][1:] - 1, len(owner) - 1)
    packed, of = (inner[a] << 32) + inner[last], owner[a]
    cuts = np.nonzero(of[1:] != of[:-1])[0] + 1
    which = of[np.concatenate([[0], cuts])]
    yield pd.DataFrame({"g": [shard[w][0] for w in which], "rid": [shard[w][1] for w in which], "s": np.split(packed, cuts)})


def _earlier_starts(held: DataFrame, size: int) -> DataFrame:
    """(g, rid, s): of contents dealt by anchor, at their own first places, the windows that start earlier elsewhere."""

    def solve(shards: list[list[Row]]) -> Iterator[pd.DataFrame]:
        """Shards of whole anchors stand alone; those that one anchor spans are merged."""
        built = [_classes(s, size) for s in shards]
        merged = _merged(built) if len(built) > 1 else None
        for s, b in zip(shards, built, strict=True):
            yield from _earlier(s, b, merged.find(b[3]) if merged else b[4])

    def resolve(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard: list[Row] = []
        group: list[Row] = []
        held = 0

        def close() -> Iterator[pd.DataFrame]:
            """The group of one anchor ends: it joins the open shard, or is solved alone if it is larger than one."""
            nonlocal shard, held
            amount = sum(len(r[4]) for r in group)
            if amount > SHARD_BYTES:
                yield from solve(_shards(group))
                return
            if held + amount > SHARD_BYTES and shard:
                yield from solve([shard])
                shard, held = [], 0
            shard = shard + group if not shard else (shard.extend(group) or shard)
            held += amount

        for row in (r for batch in batches for r in _rows(batch)):
            if group and group[0][0] != row[0]:
                yield from close()
                group = []
            group.append(row)
        if group:
            yield from close()
        if shard:
            yield from solve([shard])

    dealt = held.select(*ROW).repartition(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g").sortWithinPartitions("g")
    return dealt.mapInPandas(resolve, STARTS)


def _earlier_starts_in_parts(held: DataFrame, anchors: DataFrame, size: int) -> DataFrame:
    """_earlier_starts() of anchors (g, parts) with more contents than one task should hold; saved."""
    CLASSES = "g bigint, part bigint, parts bigint, string binary, id bigint, start bigint"
    COLUMNS = ["g", "part", "parts", "string", "id", "start"]
    dealt = saved(held.select(*ROW).join(small(anchors, 16), "g").withColumn("part", F.pmod("rid", "parts")))

    def classes(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        merged = _merged(_classes(s, size) for s in _shards(_rows(part)))
        ids, starts = zip(*merged.places, strict=True)
        return pd.DataFrame(dict(zip(COLUMNS, (key[0], key[1], part["parts"].iloc[0], merged.strings, ids, starts), strict=True)))

    def elsewhere(bucket: pd.DataFrame) -> pd.DataFrame:
        """Strings of a part whose first place lies in another part, with that place."""
        lists = [one.sort_values("string") for _, one in bucket.groupby("part")]
        merged = Merge()
        for one in lists:
            merged.add(one["string"].tolist(), list(zip(one["id"].tolist(), one["start"].tolist(), strict=True)))
        out = []
        for one in lists:
            found = pd.DataFrame(merged.find(one["string"].tolist()), columns=["id", "start"], index=one.index)
            differs = (found["id"] != one["id"]) | (found["start"] != one["start"])
            out.append(one.assign(id=found["id"], start=found["start"])[differs])
        return pd.concat(out)[COLUMNS]

    def settle(part: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        shards = _shards(_rows(part))
        built = [_classes(s, size) for s in shards]
        merged = _merged(built)
        others = others.sort_values("string")
        merged.add(others["string"].tolist(), list(zip(others["id"].tolist(), others["start"].tolist(), strict=True)))
        found = [x for s, b in zip(shards, built, strict=True) for x in _earlier(s, b, merged.find(b[3]))]
        return pd.concat(found) if found else pd.DataFrame({"g": pd.Series(dtype="int64"), "rid": pd.Series(dtype="int64"), "s": pd.Series(dtype=object)})

    lists = dealt.groupBy("g", "part").applyInPandas(classes, CLASSES)
    moved = lists.groupBy("g", F.pmod(F.xxhash64("string"), "parts").alias("bucket")).applyInPandas(elsewhere, CLASSES)
    starts = saved(dealt.groupBy("g", "part").cogroup(moved.groupBy("g", "part")).applyInPandas(settle, STARTS))
    discard(dealt)
    return starts


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per input row: id, kept (binary), n_bytes, n_removed, n_spans (maximal removed runs).

    Texts are UTF-8 bytes, null as empty; windows never cross documents; a text shorter than `size` keeps all.
    "Earlier" is a smaller id, or the same id and a smaller start; rows that repeat an id count as one document,
    so equal starts in them do not remove each other. A row with a null id keeps all and removes none elsewhere;
    an empty table gives no rows; other columns are not read. What is kept may cut a character in two.
    """
    texts = keyed(docs, id_col, text_col)
    of = _cut(size)
    rows, names = survivors(mark(texts.where("id is not null"), byte_hashes, size, gram, of), F.count(F.lit(1)) > 1)
    found = distinct(rows)
    earlier = lambda first_id, first, i, start: (first_id < i) | ((first_id == i) & (first < start))
    starts = _earlier_starts(contents(texts, names, found.where((F.col("m") > 1) & (F.col("m") <= MERGED)), byte_hashes, of, "binary"), size)
    large = found.where(F.col("m") > MERGED)
    anchors = saved(large.select("g", F.ceil(F.col("m") / MERGED).alias("parts")).distinct())
    if anchors.take(1):
        starts = starts.unionByName(_earlier_starts_in_parts(contents(texts, names, large, byte_hashes, of, "binary"), anchors, size))
    discard(anchors)
    spans = flagged(rows, names, found, saved(starts), earlier)

    @F.pandas_udf("kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")
    def keep(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in series:
            out = []
            for text, starts in zip(texts, spans, strict=True):
                gone = covered(len(text), starts, size)
                n = int(gone.sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if n else text
                out.append((kept, len(text), n, int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())))
            yield pd.DataFrame(out, columns=["kept", "n_bytes", "n_removed", "n_spans"])

    return texts.join(spans, KEYS, "left").select("id", keep("text", "spans").alias("k")).select("id", "k.*")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the bytes that a 100-byte string with an earlier start covers."""
    found = repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
