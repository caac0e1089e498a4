"""Exact top-k by inner product with a vector-approximation file.

The approximation file is built once: blocks of rows in which every component is a cell, one of 2^BITS intervals
between the least and the greatest value of its column in the block. The exact vectors are a table of their own.
A search has two phases.

1. Scan. Query blocks meet the blocks of cells; two matrix products bound all inner products from below and from
   above. The first scan gives each query its floor: the k-th greatest of all lower bounds. The second names the
   vectors whose upper bound reaches the floor, which is why no other vector can be among the k best.
2. Read. Exact vectors are read in the order of their upper bounds, first READ of a query, then those whose bound
   still reaches the k-th exact score of these: until the k-th result is certain.

Scans meet in a grid of tiles, R rows of cell blocks by C columns of query blocks, chosen so that the copies that
are shuffled (cells C times, queries R times) are fewest. No vector is copied, and only those named are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm.common import discard, saved, table

K = 20
SCALE = 64
BITS = 8
VECTOR_BLOCK = 4096
QUERY_BLOCK = 512
#: So many times k exact vectors of a query are read before its k-th exact score is taken.
READ = 2
#: Components up to this size keep every product below 2^53, where float64 sums are exact; beyond it bounds are widened.
EXACT_LIMIT = 1 << 20
#: Components and scores beyond it, on either side, count as it.
LONG_MOST = (1 << 63) - 1


def whole_components(x: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as double arithmetic gives it, held between -LONG_MOST and LONG_MOST."""
    return F.transform(x, lambda e: F.greatest(F.floor(e.cast("double") * scale).cast("bigint"), F.lit(-LONG_MOST)))


def takes_part(x: Column) -> Column:
    """Neither null nor with a component that is null or not finite."""
    return x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))


def is_wide(v: Column) -> Column:
    """Holds a component whose products may leave the range in which BIGINT and float64 sums are exact."""
    return F.exists(v, lambda e: F.abs(e) >= EXACT_LIMIT)


def exact_score(a: Iterable[int], b: Iterable[int]) -> int:
    """The inner product of any whole numbers, held between -LONG_MOST and LONG_MOST."""
    return max(-LONG_MOST, min(LONG_MOST, sum(int(x) * int(y) for x, y in zip(a, b, strict=False))))


def _stacked(vectors: list) -> np.ndarray:
    """Rows of one width, zeros beyond a vector's end."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def approximate(values: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, step, cells): value lies in low + cell * step .. low + (cell + 1) * step - 1, and not above high."""
    values = values.astype(np.float64)  # exact for components below 2^53; for larger ones bounds() leaves room
    low, high = values.min(axis=0), values.max(axis=0)
    step = np.maximum(1, np.ceil((high - low + 1) / (1 << bits)))
    return low, high, step, np.minimum((values - low) // step, (1 << bits) - 1).astype(np.uint8)


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray, step: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper): bounds of every inner product, a row for each query."""
    width = max(q.shape[1], cells.shape[1])
    q, cells = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, cells))
    low, high, step = (np.pad(x, (0, width - len(x)), constant_values=c) for x, c in ((low, 0), (high, 0), (step, 1)))
    q, floor = q.astype(np.float64), low + cells * step
    ceiling = np.minimum(floor + step - 1, high)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    lower, upper = up @ floor.T + down @ ceiling.T, up @ ceiling.T + down @ floor.T
    most = np.maximum(np.abs(low), np.abs(high))
    if max(np.abs(q).max(initial=0), most.max(initial=0)) >= EXACT_LIMIT:
        slack = (np.abs(q) @ most * 1e-12 + 1)[:, None]
        lower, upper = np.clip(lower - slack, -float(LONG_MOST), LONG_MOST), np.clip(upper + slack, -float(LONG_MOST), LONG_MOST)
    return lower, upper


def _cell_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, key, v) as blocks of cells. No shuffle."""

    def pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, keys, vectors in _runs(batches, size):
            low, high, step, cells = approximate(_stacked(vectors))
            parts = [x.astype("<i8").tobytes() for x in (np.array(ids), np.array(keys))] + [x.astype("<f8").tobytes() for x in (low, high, step)]
            yield pd.DataFrame([(*parts, cells.tobytes())], columns=["ids", "keys", "low", "high", "step", "cells"])

    return rows.mapInPandas(pack, "ids binary, keys binary, low binary, high binary, step binary, cells binary")


def _query_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, key, v, floor) as blocks; without a floor yet, minus infinity."""

    def pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, keys, vectors, floors in _runs(batches, size):
            values = _stacked(vectors)
            yield pd.DataFrame(
                [(np.array(ids, "<i8").tobytes(), np.array(keys, "<i8").tobytes(), values.shape[1], values.astype("<i8").tobytes(), np.array(floors, "<f8").tobytes())],
                columns=["q_ids", "q_keys", "q_width", "q_vecs", "floors"],
            )

    return rows.mapInPandas(pack, "q_ids binary, q_keys binary, q_width int, q_vecs binary, floors binary")


def _runs(batches: Iterable[pd.DataFrame], size: int) -> Iterator[list[list]]:
    """The columns of `size` rows at a time, whatever the batches are."""
    held: list[list] = []
    for batch in batches:
        columns = [batch[c].tolist() for c in batch.columns]
        held = [a + b for a, b in zip(held, columns, strict=True)] if held else columns
        while held and len(held[0]) >= size:
            yield [c[:size] for c in held]
            held = [c[size:] for c in held]
    if held and held[0]:
        yield held


def _tiles(cells: DataFrame, queries: DataFrame) -> DataFrame:
    """Every block of cells beside every query block, each pair in one tile."""
    n_cells, n_queries = cells.count(), queries.count()  # one for every VECTOR_BLOCK vectors, QUERY_BLOCK queries
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = max(1, min(n_cells, round((tasks * n_cells / max(1, n_queries)) ** 0.5)))
    columns = max(1, min(n_queries, -(-tasks // rows)))
    number = F.monotonically_increasing_id()
    c = cells.withColumn("tile_row", F.pmod(F.xxhash64(number, "keys"), F.lit(rows))).withColumn("tile_column", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(columns - 1).cast("bigint"))))
    q = queries.withColumn("tile_column", F.pmod(F.xxhash64(number, "q_keys"), F.lit(columns))).withColumn("tile_row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(rows - 1).cast("bigint"))))
    return c.join(q, ["tile_row", "tile_column"])


def _unpacked(r: tuple) -> tuple[np.ndarray, ...]:
    """(query keys, floors, ids, keys, lower, upper) of a pair of blocks; bounds of a query's own id are minus infinity."""
    q_ids, q_keys, floors = np.frombuffer(r.q_ids, "<i8"), np.frombuffer(r.q_keys, "<i8"), np.frombuffer(r.floors, "<f8")
    ids, keys = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.keys, "<i8")
    q = np.frombuffer(r.q_vecs, "<i8").reshape(len(q_ids), r.q_width)
    low, high, step = (np.frombuffer(x, "<f8") for x in (r.low, r.high, r.step))
    lower, upper = bounds(q, low, high, step, np.frombuffer(r.cells, np.uint8).reshape(len(ids), len(low)))
    own = np.nonzero(q_ids[:, None] == ids[None, :]) if len(np.intersect1d(q_ids, ids)) else ()
    if own:
        lower[own], upper[own] = -np.inf, -np.inf
    return q_keys, floors, ids, keys, lower, upper


def _floors(met: DataFrame, k: int) -> DataFrame:
    """(key, floor): the k-th greatest lower bound of a query, if it has so many. Only each pair's k greatest leave a tile."""

    def search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q_keys, _, _, _, lower, _ = _unpacked(r)
                best = -np.partition(-lower, min(k, lower.shape[1]) - 1, axis=1)[:, :k]
                found = pd.DataFrame({"key": np.repeat(q_keys, best.shape[1]), "lower": best.ravel()})
                yield found[found["lower"] > -np.inf]

    found = met.mapInPandas(search, "key bigint, lower double")
    order = Window.partitionBy("key").orderBy(F.desc("lower"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("key", F.col("lower").alias("floor"))


def _reaching(floors: np.ndarray, ids: np.ndarray, lower: np.ndarray, upper: np.ndarray, k: int) -> np.ndarray:
    """Which vectors can be among a query's k best: those whose upper bound reaches its floor. Of those that score the floor
    for certain, the k with the smallest ids: others come after them."""
    floors = floors[:, None]
    reach = (upper >= floors) & (upper > -np.inf)
    tied = reach & (lower == upper) & (upper == floors)
    if tied.any():
        order = np.argsort(ids, kind="stable")
        late = np.zeros_like(tied)
        late[:, order] = np.cumsum(tied[:, order], axis=1) > k
        reach &= ~(tied & late)
    return reach


def _named(met: DataFrame, k: int) -> DataFrame:
    """(q_key, c_key, upper): the vectors that a query's exact scores are wanted of."""

    def search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q_keys, floors, ids, keys, lower, upper = _unpacked(r)
                i, j = np.nonzero(_reaching(floors, ids, lower, upper, k))
                yield pd.DataFrame({"q_key": q_keys[i], "c_key": keys[j], "upper": upper[i, j]})

    return met.mapInPandas(search, "q_key bigint, c_key bigint, upper double")


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of every query, against all other rows.

    Components x become floor(scale * x). Vectors that are null, or hold a null or non-finite component, take no
    part, nor do rows without an id. Components and scores beyond the range of BIGINT count as its ends (LONG_MOST);
    all others are exact, whatever the components' size. Shorter vectors count as zero beyond their end; an empty vector scores 0.
    A query leaves out every row with its own id. Repeated ids are rows of their own and rank one after the
    other; ties go to the smaller vec_id. With fewer than k rows all are returned; empty tables give no rows; other
    columns are not read.
    """
    x = F.col(vec_col)

    def whole(df: DataFrame) -> DataFrame:
        rows = df.where(takes_part(x) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), whole_components(x, scale).alias("v"))
        return saved(rows.select("id", F.monotonically_increasing_id().alias("key"), "v"))

    exact, asked = whole(vectors), whole(queries)
    cells = saved(_cell_blocks(exact, VECTOR_BLOCK))
    blocks = saved(_query_blocks(asked.withColumn("floor", F.lit(float("-inf"))), QUERY_BLOCK))
    floors = saved(_floors(_tiles(cells, blocks), k))
    discard(blocks)
    floored = asked.join(floors, "key", "left").select("id", "key", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    blocks = saved(_query_blocks(floored, QUERY_BLOCK))
    by_bound = Window.partitionBy("q_key").orderBy(F.desc("upper"), "c_key")
    named = saved(_named(_tiles(cells, blocks), k).withColumn("place", F.row_number().over(by_bound)))
    discard(cells, blocks, floors)
    q, c = asked.select(F.col("key").alias("q_key"), F.col("id").alias("query_id"), F.col("v").alias("qv")), exact.select(F.col("key").alias("c_key"), F.col("id").alias("vec_id"), F.col("v").alias("cv"))
    product = F.aggregate(F.zip_with("qv", "cv", lambda a, b: F.coalesce(a, F.lit(0)) * F.coalesce(b, F.lit(0))), F.lit(0).cast("bigint"), lambda a, b: a + b)
    some_wide = exact.unionAll(asked).where(is_wide(F.col("v"))).limit(1).count()

    @F.pandas_udf("bigint")
    def wide_product(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([exact_score(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")

    def read(which: DataFrame) -> DataFrame:
        met = which.join(c, "c_key").join(q, "q_key")
        scored = lambda rows, score: rows.select("q_key", "query_id", "vec_id", score.alias("score"))
        if not some_wide:
            return scored(met, product)
        wide = is_wide(F.col("qv")) | is_wide(F.col("cv"))
        return scored(met.where(~wide), product).unionAll(scored(met.where(wide), wide_product("qv", "cv")))

    first = saved(read(named.where(F.col("place") <= READ * k)))
    kth = first.withColumn("rank", F.row_number().over(Window.partitionBy("q_key").orderBy(F.desc("score")))).where(F.col("rank") == k).select("q_key", F.col("score").alias("kth"))
    rest = named.where(F.col("place") > READ * k).join(kth, "q_key").where(F.col("upper") >= F.col("kth"))
    order = Window.partitionBy("q_key").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(read(rest)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best matches of every twentieth vector among all other vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
