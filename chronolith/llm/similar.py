"""Documents whose sets of five-word shingles are alike: every pair with Jaccard similarity of 0.8 or more is found.

Two sets that are 80 % alike share a shingle among the first n - ceil(0.8 n) + 1 of each, in any one order of all
shingles (prefix filter). The order puts rare shingles first; how often they occur is estimated from a sample, which
changes the cost and never the result. Sets that meet in a prefix shingle and are near in size are candidates. A sketch
of BITS bits, or of as many as a larger set has shingles, each the parity of the shingles that fall on it, differs in no
more bits than the sets differ in shingles: candidates that it shows to be too far apart go, which loses nothing; the others are compared exactly.

A shingle in the prefixes of more than LONG_LIST sets would make too many pairs. There a few hubs are compared with
all others first, each set in the longest of its lists; a pair that is linked through them already needs no comparison, so
what is left are the sets outside of the list's largest component, in blocks against all sets of other components: a task
compares two blocks, and pairs that sizes or sketches rule out never leave it (ngram_join.long_links). No link is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import discard, pieces, result, saved, scratch, small
from chronolith.llm.components import components

SHINGLE = 5
#: Similarity of 4/5, as whole numbers.
PARTS, WHOLE = 4, 5
#: Bits of a set's sketch, at least.
BITS = 1024
LONG_LIST = 24
HUBS = 8
#: Of the documents, one in so many is read for the order; that many shingles are put last.
SAMPLE = 8
FREQUENT = 65_536
FREQUENT_FROM = 4
FACTORS = np.array([int.from_bytes(xxhash.xxh64_digest(f"factor {k}"), "big") | 1 for k in range(SHINGLE)], np.uint64)
_cache: dict[bytes, int] = {}


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()  # of bytes: A-Z alone, and the six ASCII spaces alone
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64).view(np.int64)
    if len(_cache) > 100_000:
        _cache.clear()
    for w in words:
        if w not in _cache:
            _cache[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_cache.__getitem__, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    s = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        s += h[k : k + n] * FACTORS[k]
        s ^= s >> np.uint64(29)
    return np.unique(s.view(np.int64))


def text_hash(text: Column) -> Column:
    """What tells texts apart beside an id; a null text counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def prefix_size(n: int) -> int:
    return n - -(-PARTS * n // WHOLE) + 1 if n else 0


def _frequent(source: DataFrame) -> np.ndarray:
    """Shingles that stand in many documents of a sample, the most frequent last."""

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(b["text"] for b in batches):
            yield pd.DataFrame({"s": np.concatenate([np.zeros(0, np.int64), *(shingles(t) for t in batch)])})

    rows = source.where(F.pmod(F.xxhash64("doc_id", "th", F.lit("order")), F.lit(SAMPLE)) == 0).select("text").mapInPandas(cut, "s bigint")
    counts = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT_FROM)
    return np.array([r.s for r in counts.orderBy(F.desc("n"), "s").limit(FREQUENT).collect()][::-1], np.int64)


def _alike(a: Column, b: Column) -> Column:
    """Sizes that allow the similarity."""
    return F.least(a, b) * WHOLE >= F.greatest(a, b) * PARTS


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of how many shingles fall on each of so many places, as numbers of 64: BITS, doubled until there are as many as shingles.

    A sketch of twice the places, its halves taken together by XOR, is the sketch of half as many.
    """
    places = max(BITS, 1 << (len(s) - 1).bit_length()) if len(s) else BITS
    odd = np.bincount((s.view(np.uint64) % np.uint64(places)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(bool)).view("<i8")


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b), near in size, that sketches do not show to be too far apart; saved."""
    side = lambda x: nodes.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
    words = F.least(F.size("bits_a"), F.size("bits_b"))  # of sets near in size, one has twice those of the other at most
    half = lambda x: F.when(F.size(x) > words, F.zip_with(F.slice(x, F.lit(1), words), F.slice(x, words + 1, words), lambda u, v: u.bitwiseXOR(v))).otherwise(F.col(x))
    apart = F.aggregate(F.zip_with(half("bits_a"), half("bits_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    both = F.col("na") + F.col("nb")
    # what is shared is (na + nb - apart) / 2 at most, and must be PARTS / (PARTS + WHOLE) of na + nb at least
    return saved(pairs.join(side("a"), "a").join(side("b"), "b").where(_alike(F.col("na"), F.col("nb")) & ((both - apart) * (PARTS + WHOLE) >= both * (2 * PARTS))).select("a", "b"))


def _linked(near: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), which are saved, whose sets are alike, compared exactly; saved."""
    pairs = small(near)
    left, right = sets.select(F.col("key").alias("a"), F.col("s").alias("sa")), sets.select(F.col("key").alias("b"), F.col("s").alias("sb"))
    left = left.join(small(saved(near.select("a").distinct())), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return saved(right.join(pairs, "b").join(left, "a").where(both * WHOLE >= (F.size("sa") + F.size("sb") - both) * PARTS).select("a", "b"))


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of (token, a, na) and (token, b, nb) that meet and are near in size."""
    met = left.join(right, "token").where((F.col("a") != F.col("b")) & _alike(F.col("na"), F.col("nb")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _side(rows: DataFrame, name: str, *more: str) -> DataFrame:
    return rows.select("token", F.col("key").alias(name), F.col("n").alias(f"n{name}"), *(F.col(m).alias(f"{m}_{name}") for m in more))


def links(marked: DataFrame, nodes: DataFrame, source: DataFrame) -> DataFrame:
    """Edges (a, b) between keys of alike sets, complete up to components; saved."""
    from chronolith.llm.ngram_join import long_links, new_links  # which reads this module

    index = marked.join(small(nodes.select("r")), "r", "left_semi").select("key", "n", F.explode("prefix").alias("token"))
    lengths = index.groupBy("token").agg(F.count(F.lit(1)).alias("length"), F.bit_xor(F.xxhash64("key")).alias("mixed"), F.min("key").alias("least"), F.max("key").alias("most")).where("length > 1")
    lengths = saved(lengths)
    posted = saved(index.join(lengths.select("token", "length"), "token"))
    few = posted.where(F.col("length") <= LONG_LIST)
    pairs = _near(_pairs(_side(few, "a"), _side(few, "b")), nodes)
    one = lengths.where(F.col("length") > LONG_LIST).groupBy("length", "mixed", "least", "most").agg(F.min("token").alias("token")).select("token")  # of lists with the same members, one
    held = saved(posted.where(F.col("length") > LONG_LIST).groupBy("key").agg(F.count(F.lit(1)).alias("long"), F.max_by("token", F.struct("length", "token")).alias("longest")))
    long = saved(posted.join(small(saved(one)), "token").join(small(held), "key").select("token", "key", "n", "long", (F.col("token") == F.col("longest")).alias("main")))
    discard(lengths, posted)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionAll(long.select("key")).distinct()
    wanted = saved(wanted.join(nodes.select("key", "id", "th"), "key"))

    @F.pandas_udf("array<bigint>")
    def cut(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pieces(series):
            yield pd.Series([shingles(t) for t in batch])

    texts = source.select(F.coalesce("doc_id", F.lit(0)).alias("id"), "th", "text").join(small(wanted), ["id", "th"])
    sets = saved(texts.select("key", cut("text").alias("s")))
    edges = new_links(pairs, None, sets)
    discard(wanted, pairs)
    return long_links(long, edges, nodes, sets, HUBS) if long.limit(1).count() else edges


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, th (text_hash()), root (a number of its group), component_id: the smallest id that links reach, its own included.

    Texts with equal sets are one node, all texts without words are one too. Repeated rows give repeated rows; rows
    with a null id keep it and take part; the longest texts are read whole; an empty table gives no rows; no other
    column is read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_hash(F.col(text_col)).alias("th"), text.cast("binary").alias("text"))
    frequent = _frequent(source)
    order = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], order))  # FREQUENT shingles at most

    @F.pandas_udf("key bigint, n int, bits array<bigint>, prefix array<bigint>")
    def mark(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        values, places = shared.value
        for batch in pieces(series):
            keys, sizes, sketches, prefixes = [], [], [], []
            for t in batch:
                s = shingles(t)
                keys.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63))
                sizes.append(len(s))
                sketches.append(sketch(s))
                if len(values) and len(s):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    s = s[np.argsort(np.where(values[at] == s, places[at] + 1, 0), kind="stable")]
                prefixes.append(s[: prefix_size(len(s))])
            yield pd.DataFrame({"key": np.array(keys, np.int64), "n": np.array(sizes, np.int32), "bits": sketches, "prefix": prefixes})

    marked = saved(source.select("doc_id", "th", mark("text").alias("m")).select("doc_id", "th", "m.*").withColumn("r", F.monotonically_increasing_id()))
    with scratch():
        firsts = saved(marked.groupBy("key").agg(F.min("doc_id").alias("first"), F.min("r").alias("r")))
        rows = marked.select("r", F.coalesce("doc_id", F.lit(0)).alias("id"), "th", "n", "bits")
        nodes = saved(rows.join(small(firsts), "r"))
        roots = components(links(marked, nodes, source))
        placed = result(nodes.select("key", "first").join(roots, nodes["key"] == roots["node"], "left").select("key", "first", F.coalesce("root", "key").alias("root")))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.select("doc_id", "th", "key").join(placed.join(least, "root").select("key", "root", "component_id"), "key").select("doc_id", "th", "root", "component_id")
