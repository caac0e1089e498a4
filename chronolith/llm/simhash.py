"""Near-duplicates by SimHash fingerprints, linked through an index of byte positions with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most two bits differ in at
most two bytes, so they share six or more positional bytes: the guaranteed minimum of the count filter. One byte
alone has only 256 values, so lists of single bytes would hold a 256th of all fingerprints each and their pairs
would grow with the square of the corpus. A posting is therefore four positional bytes at once: POSITIONS is a
smallest family of four of the eight positions of which any six contain one. Every pair that shares six bytes
meets in a list; for every pair that meets the shared positional bytes are tallied, pairs below six are dropped,
and the rest is verified bit by bit.

A posting list longer than LONG_LIST is split further, by the bytes that its members still differ in: two values
at most two bits apart share a value at most one bit from both, so each member is posted under its own other four
bytes and their single-bit changes, and all that meet there are paired with the smallest of them alone. These
pairs are tallied and verified like the others. No link is lost, and the rows stay in proportion to the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import similar
from chronolith.llm.common import discard, saved, table
from chronolith.llm.components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
MIN_BYTES = 8 - MAX_BITS
LONG_LIST = 24
#: Any six of the eight byte positions (0 is the highest byte) contain one of these fours: two pairs out of four pairs.
POSITIONS = [a + b for a, b in combinations(((0, 1), (2, 3), (4, 5), (6, 7)), 2)]
#: The bits of each four, as a mask over the fingerprint.
MASKS = [sum(0xFF << (56 - 8 * p) for p in four) for four in POSITIONS]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned SimHash of the word shingles: a bit is 1 if it is set in over half of their XXH64 values; no words: 0."""
    words = text.lower().split()  # of bytes: A-Z alone, and the six ASCII spaces alone
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(b" ".join(words), seed)
    whole = b" ".join(words)
    starts = np.zeros(len(words), np.int64)
    np.cumsum([len(w) + 1 for w in words[:-1]], out=starts[1:])
    ends = (starts[size:] - 1).tolist() + [len(whole)]
    hashes = np.fromiter((digest(whole[a:b], seed) for a, b in zip(starts.tolist(), ends, strict=False)), np.uint64, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):
        ones += np.unpackbits(hashes[at : at + 16384].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed BIGINT. Null texts have no words. Ids never enter Python."""

    @F.pandas_udf("bigint")
    def compute(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series(np.array([_signed(fingerprint(t, size, seed)) for t in series], np.int64))

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), compute(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("fp"))


def shared_bytes(a: str, b: str) -> Column:
    """The tally: positional bytes that two fingerprints share."""
    return reduce(lambda x, y: x + y, [F.when(F.col(a).bitwiseXOR(F.col(b)).bitwiseAND(F.lit(_signed(0xFF << 8 * i))) == 0, 1).otherwise(0) for i in range(8)])


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between different fingerprints `fp` at most two bits apart, complete up to components; saved."""
    index = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in MASKS))).alias("list", "bytes"))
    lengths = index.groupBy("list", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    posted = saved(index.join(lengths, ["list", "bytes"]))
    few = posted.where(F.col("n") <= LONG_LIST).select("list", "bytes", "fp")
    pairs = few.select("list", "bytes", F.col("fp").alias("a")).join(few.select("list", "bytes", F.col("fp").alias("b")), ["list", "bytes"]).where("a < b").select("a", "b")
    flips = {i: [0] + [_signed(1 << b) for b in range(64) if not m >> b & 1] for i, m in enumerate(MASKS)}
    middle = F.element_at(F.array(*(F.array(*(F.lit(x).cast("bigint") for x in flips[i])) for i in range(len(MASKS)))), F.col("list") + 1)
    met = posted.where(F.col("n") > LONG_LIST).select("list", "fp", F.explode(F.transform(middle, lambda x: F.col("fp").bitwiseXOR(x))).alias("middle"))
    hubs = met.groupBy("list", "middle").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("list", "middle", "a")
    stars = met.join(hubs, ["list", "middle"]).where("a <> fp").select("a", F.col("fp").alias("b"))
    tallied = pairs.unionAll(stars).where(shared_bytes("a", "b") >= MIN_BYTES)
    verified = saved(tallied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).distinct())
    discard(posted)
    return verified


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, fp (signed), component_id: the smallest id that links reach, its own included.

    Documents without words (null, empty or blank text) have fingerprint 0 and are linked like any other.
    Equal fingerprints are one node, so a group of copies of any size is one row from there on. Repeated rows
    give repeated rows; rows with a null id keep it and take part; a component of null ids alone has a null
    component_id; texts of any length are read whole; an empty table gives no rows; no other column is read.
    """
    marked = saved(fingerprints(docs, id_col, text_col, size, seed))
    nodes = _nodes(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = nodes.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def _nodes(distinct: DataFrame) -> DataFrame:
    """Different fingerprints `fp` with their columns and `root`, a number of their component; saved."""
    edges = links(distinct.select("fp"))
    roots = components(edges)
    discard(edges)
    return saved(distinct.join(roots, distinct["fp"] == roots["node"], "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with its own columns.

    Texts are linked by their fingerprints, as op8 links them (two bits), and by five-word shingles at similarity 0.8 or more,
    where fingerprints lie further apart; what either link reaches is one group.
    The row with the smallest id stays; a null id comes after all others; of rows that share an id, that of the
    smaller text; of rows that agree in both, the first by all columns (those that hold maps by their JSON text). Rows of one id whose texts are not alike are
    groups of their own and all stay. Texts without words (null, empty, blank) are one group; the longest texts are
    read whole; an empty table gives no rows.
    """
    found = _with_fingerprints(docs, similar.groups(docs, id_col, text_col), text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("x")
    firsts = found.groupBy("root").agg(first).select(F.coalesce("x.doc_id", F.lit(0)).alias("id"), F.col("x.no_id").alias("no_id"), F.col("x.th").alias("th"))
    own = F.col(id_col).cast("bigint")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(own, F.lit(0)).alias("id"), own.isNull().alias("no_id"), similar.text_hash(F.col(text_col)).alias("th"))
    key = ["id", "no_id", "th"]  # one shuffle serves the join and the choice among repeated rows
    return rows.join(firsts, key).groupBy(*key).agg(_least(docs).alias("row")).select("row.*")


def _with_fingerprints(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """similar.groups() whose roots are merged where a component of fingerprints holds several."""
    texts = docs.select(similar.text_hash(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    marked = saved(fingerprints(texts, "th", "text").withColumnRenamed("doc_id", "th"))
    nodes = _nodes(marked.select("fp").distinct())
    found = saved(found)
    placed = found.select("th", "root").distinct().join(marked.join(nodes.withColumnRenamed("root", "bits"), "fp").select("th", "bits").distinct(), "th").select("bits", "root").distinct()
    least = placed.groupBy("bits").agg(F.min("root").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bits", "a")
    merged = components(placed.join(least, "bits").where("a <> root").select("a", F.col("root").alias("b"))).withColumnRenamed("root", "merged")
    return found.join(merged, found["root"] == merged["node"], "left").select("doc_id", "th", F.coalesce("merged", "root").alias("root"))


def _least(docs: DataFrame) -> Column:
    """The least of the structs `row`, which hold the columns of `docs`; maps have no order of their own."""
    maps = {f.name for f in docs.schema.fields if "map<" in f.dataType.simpleString()}
    if not maps:
        return F.min("row")
    return F.min_by("row", F.struct(*(F.to_json(F.struct(F.col("row")[c])) if c in maps else F.col("row")[c] for c in docs.columns)))
