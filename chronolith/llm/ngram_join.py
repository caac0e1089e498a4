"""Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by a blocked sparse matrix product.

The matrix has a row for each distinct set and a column for each shingle; the product of the matrix and its transpose
counts shared shingles. Rows list their columns rarest first (an order estimated from a sample: it changes the cost,
never the result). The product is made in two blocks of columns:

1. The leading block holds the first n - ceil(0.8 n) + 1 columns of each row; rows that are alike share one of these.
   Columns are dealt over tasks by their least member, and each task adds up the counts of its pairs before they are
   shuffled. Both sizes bound what a pair can still share: the columns beyond the leading block of the row whose leading
   block ends first. Pairs whose count and that rest stay below 4/9 of both sizes together are discarded; parities of
   all columns (a sketch that loses nothing) discard more.
2. For the pairs that are left the product is taken over all columns, exactly.

Columns with more than LONG_COLUMN members make no pairs among these. Only links that join two components matter there:
a few rows of each column are multiplied with all its others first, and then, block by block, rows outside the column's
largest component with rows of other components. Whatever the columns' lengths, no link between two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import discard, pieces, result, saved, scratch, small, table
from chronolith.llm.components import components
from chronolith.llm.similar import PARTS, WHOLE, _frequent, _linked, _near, prefix_size, shingles, sketch, text_hash

#: Members of a column that are multiplied with each other.
LONG_COLUMN = 24
#: Rows of a longer column that are multiplied with all others, in each of so many turns; turns end when they leave more
#: than a share of the rows that the turn before has left.
HUBS, TURNS, STALLED = 8, 4, 0.8
#: Rows of a long column in a block.
ROW_BLOCK = 1024
#: Columns that a task multiplies at once.
COLUMN_BLOCK = 2048


def multiply(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, shared) of every two rows a < b that meet in a column: the product of a block of columns, each a sorted array of rows."""
    lengths = np.fromiter(map(len, columns), np.int64, len(columns))
    left, right = [], []
    for m in np.unique(lengths[lengths > 1]):
        members = np.stack([columns[i] for i in np.flatnonzero(lengths == m)])
        i, j = np.triu_indices(m, 1)
        left.append(members[:, i].ravel())
        right.append(members[:, j].ravel())
    if not left:
        return (np.zeros(0, np.int64),) * 3
    a, b = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[new], b[new], np.diff(np.append(new, len(a)))


def _product(columns: DataFrame) -> DataFrame:
    """(a, b, shared): counts added up inside each block of columns (members); several blocks may hold a pair."""

    def blocks(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces((b["members"] for b in batches), COLUMN_BLOCK):
            yield pd.DataFrame(dict(zip(("a", "b", "shared"), multiply(batch.tolist()), strict=True)))

    return columns.mapInPandas(blocks, "a bigint, b bigint, shared bigint")


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.col("key").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", "width", "last", "long")))


def _near_in_size(a: Column, b: Column) -> Column:
    return F.least(a, b) * WHOLE >= F.greatest(a, b) * PARTS


def _bounded(product: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of the leading block that sizes do not rule out: shared columns so far, long columns, and what comes after the leading block."""
    summed = product.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    pairs = summed.join(_side(rows, "a"), "a").join(_side(rows, "b"), "b")
    rest = F.when(F.col("last_a") <= F.col("last_b"), F.col("n_a") - F.col("width_a")).otherwise(F.col("n_b") - F.col("width_b"))
    most = F.col("shared") + F.least("long_a", "long_b") + rest
    return pairs.where(_near_in_size(F.col("n_a"), F.col("n_b")) & (most * (PARTS + WHOLE) >= (F.col("n_a") + F.col("n_b")) * PARTS)).select("a", "b")


def _rooted(rows: DataFrame, stars: DataFrame, key: str = "key", root: str = "root") -> DataFrame:
    """`rows` with the root of each key; a key that is no end of a star is its own."""
    found = rows.join(stars.select(F.col("b").alias(key), F.col("a").alias(root)), key, "left")
    return found.withColumn(root, F.coalesce(root, key))


def _stars(edges: DataFrame) -> DataFrame:
    """(a, b): the root a of every node b of the edges that is not its own root; saved."""
    return small(saved(components(edges).where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))))


def _joined(stars: DataFrame, found: DataFrame) -> DataFrame:
    """Stars of the components that links (a, b) make of those of `stars`: the search runs over the roots that are linked alone."""
    ends = _rooted(_rooted(found, stars, "a", "x"), stars, "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    more = _stars(ends)
    moved = stars.join(more.select(F.col("b").alias("a"), F.col("a").alias("root")), "a", "left").select(F.coalesce("root", "a").alias("a"), "b")
    return small(saved(moved.unionAll(more.select("a", "b"))))


def new_links(pairs: DataFrame, stars: DataFrame | None, sets: DataFrame) -> DataFrame:
    """The links among pairs (a, b), which are saved and passed the sketches, complete up to components; saved.

    Each row is compared with the least of its partners first; then pairs are compared whose rows, or their roots in
    `stars`, these links do not lead to one row in two steps, so that a group of copies needs few of its pairs.
    """
    first = saved(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    found = _linked(first, sets)
    root = lambda x: x if stars is None else _rooted(_rooted(x, stars, "a", "x"), stars, "b", "y")
    x, y = ("a", "b") if stars is None else ("x", "y")
    step = root(found).where(F.col(x) != F.col(y)).groupBy(F.greatest(x, y).alias("b")).agg(F.min(F.least(x, y)).alias("a"))
    step = small(saved(step))
    steps = small(saved(_rooted(step, step, "a", "root").select(F.col("root").alias("a"), "b")))
    led = _rooted(_rooted(root(pairs), steps, x, "to_a"), steps, y, "to_b")
    rest = saved(led.where("to_a <> to_b").select("a", "b").join(first, ["a", "b"], "left_anti"))
    out = saved(found.unionAll(_linked(rest, sets))) if rest.limit(1).count() else found
    discard(first, rest)
    return out


def _hub_pairs(outside: DataFrame, long: DataFrame, turn: int, hubs_each: int) -> DataFrame:
    """(a, b): rows of long columns, each in its longest column alone, with so many rows of the column's outside ones, of other
    components: those in most long columns."""
    slot = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(hubs_each))
    hubs = outside.where("main").groupBy("token", slot.alias("slot")).agg(F.max_by(F.struct("key", "n", "root"), F.struct("long", "key")).alias("x"))
    hubs = small(saved(hubs.select("token", F.col("x.key").alias("hub"), F.col("x.n").alias("size"), F.col("x.root").alias("hub_root"))))
    met = long.where("main").join(hubs, "token").where((F.col("root") != F.col("hub_root")) & _near_in_size(F.col("n"), F.col("size")))
    return met.select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()


def _across(outside: DataFrame, long: DataFrame) -> DataFrame:
    """(a, b): outside rows of long columns with rows of other components there that sizes and sketches do not rule out; saved.

    Rows (token, key, n, root, bits) of a column are packed in blocks of about ROW_BLOCK, blocks of outside rows meet
    all blocks of their column, and a task compares two blocks at a time: pairs that are ruled out never leave it.
    """

    def packed(rows: DataFrame, size: int) -> DataFrame:
        counts = rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"))
        cells = rows.join(counts, "token").groupBy("token", F.pmod(F.xxhash64("key"), F.col("blocks")).alias("block"))
        return cells.agg(F.collect_list(F.struct("key", "n", "root", "bits")).alias("rows")).drop("block")  # about `size` rows

    def compare(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def columns(rows: object) -> tuple[np.ndarray, ...]:
            return tuple(np.array([r[c] for r in rows], np.int64) for c in ("key", "n", "root"))

        def sketches(rows: object) -> list[np.ndarray]:
            return [np.asarray(r["bits"], np.int64).view(np.uint64) for r in rows]

        def halved(bits: np.ndarray) -> np.ndarray:
            return bits[..., : bits.shape[-1] // 2] ^ bits[..., bits.shape[-1] // 2 :]

        for batch in batches:
            for left, right in zip(batch["outside"], batch["rows"], strict=True):
                key_a, n_a, root_a = columns(left)
                key_b, n_b, root_b = columns(right)
                all_b = sketches(right)
                words_b = np.array([len(b) for b in all_b])
                by_size = {w: (at := np.flatnonzero(words_b == w), np.stack([all_b[i] for i in at])) for w in np.unique(words_b).tolist()}
                for i, bits in enumerate(sketches(left)):
                    w = len(bits)
                    for at, own, other in ((*by_size[x], x) for x in (w // 2, w, 2 * w) if x in by_size):  # no others are near in size
                        both, meet = n_a[i] + n_b[at], (root_b[at] != root_a[i]) & (np.minimum(n_a[i], n_b[at]) * WHOLE >= np.maximum(n_a[i], n_b[at]) * PARTS)
                        at, own, both = at[meet], own[meet], both[meet]
                        apart = np.bitwise_count((halved(own) if other > w else own) ^ (halved(bits) if other < w else bits)).sum(axis=1, dtype=np.int64)
                        at = at[(both - apart) * (PARTS + WHOLE) >= both * (2 * PARTS)]
                        if len(at):
                            yield pd.DataFrame({"a": np.minimum(key_a[i], key_b[at]), "b": np.maximum(key_a[i], key_b[at])})

    tiles = packed(outside, ROW_BLOCK).withColumnRenamed("rows", "outside").join(packed(long, ROW_BLOCK), "token").repartition(F.rand(1))
    return saved(tiles.select("outside", "rows").mapInPandas(compare, "a bigint, b bigint").distinct())


def long_links(long: DataFrame, edges: DataFrame, nodes: DataFrame, sets: DataFrame, hubs_each: int) -> DataFrame:
    """(a, b): the root of every row that the edges, and what joins further components of rows in long columns (token, key, n, long, main), lead to another; saved."""
    stars, before = _stars(edges), None
    rooted = outside = saved(_rooted(long, stars))
    for turn in range(TURNS):
        near = _near(_hub_pairs(outside, rooted, turn, hubs_each), nodes)
        if near.limit(1).count():
            stars = _joined(stars, new_links(near, stars, sets))
            rooted = saved(_rooted(long, stars))
        sizes = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("size"))
        core = saved(sizes.groupBy("token").agg(F.max_by("root", F.struct("size", "root")).alias("core")))
        outside = saved(rooted.join(small(core), "token").where("root <> core").drop("core"))
        left = outside.where("main").count()
        if not left or before and left > STALLED * before:
            break
        before = left
    if not outside.limit(1).count():
        return stars
    bits = nodes.select("key", "bits")
    near = _across(outside.join(bits, "key"), rooted.join(bits, "key"))
    return _joined(stars, new_links(near, stars, sets)) if near.limit(1).count() else stars


def links(postings: DataFrame, nodes: DataFrame, source: DataFrame) -> DataFrame:
    """Edges (a, b) between keys of alike sets, complete up to components; saved. postings: (token, key, n) of the leading block."""
    lengths = saved(postings.groupBy("token").agg(F.count(F.lit(1)).alias("length")).where("length > 1"))
    posted = saved(postings.join(lengths.select("token", "length"), "token"))
    few = posted.where(F.col("length") <= LONG_COLUMN).groupBy("token").agg(F.sort_array(F.collect_list("key")).alias("members"))  # LONG_COLUMN at most
    tasks = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = saved(posted.where(F.col("length") > LONG_COLUMN).groupBy("key").agg(F.count(F.lit(1)).alias("long"), F.max_by("token", F.struct("length", "token")).alias("longest")))
    members = posted.where(F.col("length") > LONG_COLUMN).groupBy("token").agg(F.first("length").alias("length"), F.bit_xor(F.xxhash64("key")).alias("mixed"), F.sum(F.xxhash64("key", F.lit(1)).cast("decimal(38,0)")).alias("added"))
    one = members.groupBy("length", "mixed", "added").agg(F.max("token").alias("token")).select("token")  # of columns with the same members, one
    long = saved(posted.join(small(saved(one)), "token").join(small(held), "key").select("token", "key", "n", "long", (F.col("token") == F.col("longest")).alias("main")))
    sized = saved(nodes.select("key", "n", "width", "last").join(small(held.select("key", "long")), "key", "left").select("key", "n", "width", "last", F.coalesce("long", F.lit(0)).alias("long")))
    product = _product(few.select("members").repartition(tasks, F.element_at("members", 1)))
    pairs = _near(_bounded(product, sized), nodes)
    discard(lengths, posted, sized)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionAll(long.select("key")).distinct()
    wanted = saved(wanted.join(nodes.select("key", "n", "bits", "id", "th"), "key"))  # later steps read these rows of the matrix alone

    @F.pandas_udf("array<bigint>")
    def cut(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pieces(series):
            yield pd.Series([shingles(t) for t in batch])

    found = source.select(F.coalesce("doc_id", F.lit(0)).alias("id"), "th", "text").join(small(wanted.select("key", "id", "th")), ["id", "th"]).select("key", cut("text").alias("s"))
    many = source.select("doc_id", "th").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").limit(1).count()
    sets = saved(found.dropDuplicates(["key"]) if many else found)  # a row that is repeated would give its set again
    edges = new_links(pairs, None, sets)
    discard(pairs)
    return long_links(long, edges, wanted, sets, HUBS) if long.limit(1).count() else edges


def join_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its set, and the smallest id that links reach, its own included.

    A set holds the distinct five-word shingles, A-Z in lower case; a text of one to four words is one shingle. Texts
    without words, null or empty ones among them, have an empty set and are linked with nothing, not even with each
    other. Equal texts are linked. Repeated rows give repeated rows; rows with a null id keep it and take part, and
    count for no component's smallest id; the longest texts are read whole; an empty table gives no rows; no other
    column is read.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_hash(F.col(text_col)).alias("th"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    frequent = _frequent(source)
    order = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], order))  # similar.FREQUENT shingles at most

    @F.pandas_udf("digest string, n bigint, bits array<bigint>, lead array<bigint>, place bigint")
    def mark(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        values, places = shared.value
        for batch in pieces(series):
            out = []
            for t in batch:
                s = shingles(t)
                rank = np.zeros(len(s), np.int64)
                if len(values) and len(s):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    rank = np.where(values[at] == s, places[at] + 1, 0)
                ranked = np.argsort(rank, kind="stable")[: prefix_size(len(s))]
                out.append((xxhash.xxh3_128_hexdigest(s.tobytes()), len(s), sketch(s), s[ranked], int(rank[ranked[-1]]) if len(s) else 0))
            yield pd.DataFrame(out, columns=["digest", "n", "bits", "lead", "place"])

    marked = saved(source.select("doc_id", "th", mark("text").alias("m")).select("doc_id", "th", "m.*").withColumn("r", F.monotonically_increasing_id()))
    with scratch():
        full = marked.where("n > 0")
        # equal sets are one row of the matrix, by 128 bits and size
        firsts = saved(full.groupBy("digest", "n").agg(F.min("doc_id").alias("first"), F.min("r").alias("r")))
        nodes = saved(
            full.select("r", F.coalesce("doc_id", F.lit(0)).alias("id"), "th", "n", "bits", F.size("lead").alias("width"), F.struct("place", F.element_at("lead", -1).alias("token")).alias("last"), "digest", "lead")
            .join(small(firsts.select("r", "first")), "r").withColumnRenamed("r", "key")
        )
        roots = components(links(nodes.select("key", "n", F.explode("lead").alias("token")), nodes, source))
        rooted = nodes.select("digest", "n", "key", "first").join(roots, nodes["key"] == roots["node"], "left").select("digest", "n", "first", F.coalesce("root", "key").alias("root"))
        least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        placed = result(rooted.join(least, "root").select("digest", "n", "component_id"))
    joined = marked.select("doc_id", "digest", "n").join(placed, ["digest", "n"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of its set of shingles and smallest id of its component for every document."""
    return join_groups(table(spark, sf_dir, "documents"))
