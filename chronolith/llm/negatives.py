"""Hard-negative mining by inner product in an orthogonally rotated space.

The rotation is the eigenvectors of the second moments of all vectors, summed in Spark; it leaves inner products as they
are and puts most of a vector's length into its leading components. Blocks of anchors meet blocks of rows in a grid of
tiles. In a pair of blocks the products of leading components are added up group by group; what the other components can
add is bounded by the product of both residual norms, and rounding by a slack, so each score lies between two bounds.
Rows that no anchor of the block can want any more are dropped between the groups, single pairs after the last one.
Survivors are scored by products of the unrotated whole numbers; only exact scores leave a tile.

Two such searches make the result: an anchor's positives, then for each of its positives the greatest scores of other
labels inside the window that the positive's score opens.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm.common import discard, saved, table
from chronolith.llm.vafile import EXACT_LIMIT, LONG_MOST, exact_score, is_wide, takes_part, whole_components

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative scores between so many hundredths of the positive's score.
FROM_PERCENT, TO_PERCENT = 30, 90
#: Shares of the summed squares at which a group of leading components ends; the last group holds the rest.
ENERGY = (0.5, 0.8, 0.95)
ROW_BLOCK, ANCHOR_BLOCK = 2048, 256
#: Rotated blocks that a task holds.
KEPT = 8
#: Vectors are rotated from float64 and kept in float32: the relative error of both sides of a product, and of its sum.
ROUNDING = 2.0**-21


def moments(rows: DataFrame) -> np.ndarray:
    """Sums of products of every two components over all rows (v) but those whose components are huge (is_wide()): d x d
    numbers, whatever the number of rows; d is the width of the longest."""

    def partial(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((0, 0))
        for batch in batches:
            for at in range(0, len(batch), ROW_BLOCK):
                x = padded(batch["v"].iloc[at : at + ROW_BLOCK].tolist()).astype(np.float64)
                if x.shape[1] > len(total):
                    total = np.pad(total, (0, x.shape[1] - len(total)))
                total[: x.shape[1], : x.shape[1]] += x.T @ x
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    out = np.zeros((width, width))
    for r in rows.where(~is_wide(F.col("v"))).select("v").mapInPandas(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r.i, r.j] = r.s
    return out


def rotation(second: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Eigenvectors as columns, the longest direction first, and where each group of components ends."""
    width = len(second)
    if not width:
        return np.zeros((0, 0)), [0]
    values, vectors = np.linalg.eigh((second + second.T) / 2)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    held = np.cumsum(values) / max(values.sum(), np.finfo(float).tiny)
    return vectors, sorted({*(int(np.searchsorted(held, e)) + 1 for e in ENERGY if held[-1] > 0), width} & set(range(1, width + 1)))


def padded(vectors: list, width: int | None = None) -> np.ndarray:
    """Rows of one width, zeros beyond a vector's end."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0) if width is None else width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Block:
    """Vectors of a block: whole, rotated, and for each group's end the norm of what comes after it."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray, cuts: list[int]) -> None:
        self.vectors = vectors
        turned = vectors.astype(np.float64) @ turn
        self.turned = turned.astype(np.float32)
        self.norms = np.linalg.norm(vectors.astype(np.float64), axis=1)
        self.rest = np.stack([np.linalg.norm(turned[:, c:], axis=1) for c in cuts])
        self.wide = np.abs(vectors).max(initial=0) >= EXACT_LIMIT


def bounded(a: Block, b: Block, cuts: list[int], wanted: object) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, low, high): places of b's rows that an anchor of `a` may want, and bounds of the scores of all these pairs.

    `wanted(at, low, high)` marks the pairs that are still possible; it is asked after each group of components.
    """
    at, partial, before = np.arange(len(b.vectors)), np.zeros((len(a.vectors), len(b.vectors))), 0
    low = high = partial
    for g, c in enumerate(cuts):
        partial = partial + a.turned[:, before:c].astype(np.float64) @ b.turned[at, before:c].astype(np.float64).T
        room = np.outer(a.rest[g], b.rest[g, at]) + np.outer(a.norms, b.norms[at]) * ROUNDING + 1e-3
        low, high = partial - room, partial + room
        if a.wide or b.wide:
            low, high = (np.clip(x, -float(LONG_MOST), LONG_MOST) for x in (low, high))
        alive = wanted(at, low, high).any(axis=0)
        at, partial, low, high, before = at[alive], partial[:, alive], low[:, alive], high[:, alive], c
    return at, low, high


def scores(a: Block, i: int, b: Block, at: np.ndarray) -> np.ndarray:
    """Exact inner products of one anchor and some rows."""
    if a.wide or b.wide:
        return np.array([exact_score(a.vectors[i], b.vectors[j]) for j in at], np.int64)
    return (b.vectors[at].astype(np.float64) @ a.vectors[i].astype(np.float64)).astype(np.int64)  # whole numbers below 2^53


def kth(values: np.ndarray, which: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of the values marked in each row; minus infinity in rows with fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return -np.partition(np.where(which, -values, np.inf), k - 1, axis=1)[:, k - 1]


def best(found: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest, ties to the smaller id."""
    return np.lexsort((ids, -found))[:k]


def joined(parts: list[tuple[np.ndarray, ...]], names: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """The rows of a pair of blocks in one batch: a batch for each anchor costs more than its scores."""
    if parts:
        yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*parts, strict=True)), strict=True)))


def _packed(rows: DataFrame, size: int, extra: list[str]) -> DataFrame:
    """Rows (id, key, label, v, extra...) as blocks of `size`, each column's values in one binary. No shuffle."""
    fields = ["id", "key", "label", *extra]

    def pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        many = 0

        def block(part: pd.DataFrame) -> pd.DataFrame:
            v = padded(part["v"].tolist())
            flat = {c: part[c].to_numpy(np.int64).tobytes() for c in ("id", "key", "label")} | {c: padded(part[c].tolist(), POSITIVES).tobytes() for c in extra}
            counts = {"many": len(part), "width": v.shape[1]}
            return pd.DataFrame([{**flat, **counts, "v": v.tobytes()} | ({"held": part[extra[0]].map(len).to_numpy(np.int64).tobytes()} if extra else {})])

        for batch in batches:
            held.append(batch)
            many += len(batch)
            while many >= size:
                whole = pd.concat(held, ignore_index=True)
                yield block(whole.iloc[:size])
                held, many = [whole.iloc[size:]], many - size
        if many:
            yield block(pd.concat(held, ignore_index=True))

    schema = ", ".join([f"{c} binary" for c in fields] + ["many int", "width int", "v binary"] + ["held binary"] * bool(extra))
    return rows.select(*fields, "v").mapInPandas(pack, schema)


def _tiles(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every block of rows beside every block of anchors, each pair in one tile of a grid that copies as few bytes as it can."""
    n_rows, n_anchors = rows.count(), anchors.count()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    down = max(1, min(n_rows, round((tasks * n_rows / max(1, n_anchors)) ** 0.5)))
    across = max(1, min(n_anchors, -(-tasks // down)))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = F.monotonically_increasing_id()
    r = rows.withColumn("down", F.pmod(F.xxhash64(number, "key"), F.lit(down)).cast("int")).withColumn("across", upto(across))
    a = anchors.select(*(F.col(c).alias(f"a_{c}") for c in anchors.columns)).withColumn("across", F.pmod(F.xxhash64(number, "a_key"), F.lit(across)).cast("int")).withColumn("down", upto(down))
    return r.join(a, ["down", "across"])


class Pair:
    """A block of anchors and one of rows, unpacked. `kept` holds the blocks that this task has rotated last."""

    def __init__(self, r: object, turn: np.ndarray, cuts: list[int], kept: dict) -> None:
        whole = lambda x: np.frombuffer(x, np.int64)
        self.ids, self.keys, self.labels = whole(r.id), whole(r.key), whole(r.label)
        self.a_ids, self.a_keys, self.a_labels = whole(r.a_id), whole(r.a_key), whole(r.a_label)

        def block(name: tuple, v: bytes, many: int, width: int) -> Block:
            if name not in kept:
                while len(kept) >= KEPT:
                    kept.pop(next(iter(kept)))
                kept[name] = Block(np.pad(whole(v).reshape(many, width), ((0, 0), (0, len(turn) - width))), turn, cuts)
            return kept[name]

        self.rows, self.anchors = block(("r", r.key), r.v, r.many, r.width), block(("a", r.a_key), r.a_v, r.a_many, r.a_width)


def _positives(met: DataFrame, turn: np.ndarray, cuts: list[int], k: int) -> DataFrame:
    """(a_key, anchor_id, p_key, positive_id, score): of every pair of blocks, each anchor's k best of its label."""

    def search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                x = Pair(r, turn, cuts, kept)
                same = (x.a_labels[:, None] == x.labels) & (x.a_ids[:, None] != x.ids)

                def wanted(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                    return same[:, at] & (high >= kth(low, same[:, at], k)[:, None])

                at, low, high = bounded(x.anchors, x.rows, cuts, wanted)
                still, out = wanted(at, low, high), []
                for i in np.flatnonzero(still.any(axis=1)):
                    js = at[still[i]]
                    found = scores(x.anchors, i, x.rows, js)
                    top = best(found, x.ids[js], k)
                    out.append((np.full(len(top), x.a_keys[i]), np.full(len(top), x.a_ids[i]), x.keys[js[top]], x.ids[js[top]], found[top]))
                yield from joined(out, ("a_key", "anchor_id", "p_key", "positive_id", "score"))

    return met.mapInPandas(search, "a_key bigint, anchor_id bigint, p_key bigint, positive_id bigint, score bigint")


def _negatives(met: DataFrame, turn: np.ndarray, cuts: list[int], k: int, from_percent: int, to_percent: int) -> DataFrame:
    """(a_key, anchor_id, p_key, positive_id, positive_score, negative_id, score): of every pair of blocks, each positive's k best of other labels in its window."""

    def search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                x = Pair(r, turn, cuts, kept)
                held = np.frombuffer(r.a_held, np.int64)
                p_keys, p_ids, p_scores = (np.frombuffer(y, np.int64).reshape(-1, POSITIVES) for y in (r.a_p_keys, r.a_p_ids, r.a_p_scores))
                least = np.array([[-(-int(s) * from_percent // 100) for s in row] for row in p_scores], object)
                most = np.array([[int(s) * to_percent // 100 for s in row] for row in p_scores], object)
                open_ = (np.arange(POSITIVES) < held[:, None]) & (least <= most)
                floors, ceilings = least.astype(np.float64), most.astype(np.float64)
                other = x.a_labels[:, None] != x.labels

                lowest, highest = np.where(open_, floors, np.inf).min(axis=1)[:, None], np.where(open_, ceilings, -np.inf).max(axis=1)[:, None]

                def in_reach(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                    return other[:, at] & (low <= highest) & (high >= lowest)  # of any window; cheap, for each group of components

                def wanted(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                    out = np.zeros(low.shape, bool)
                    for p in range(POSITIVES):
                        floor, ceiling = floors[:, p, None], ceilings[:, p, None]
                        sure = other[:, at] & (low >= floor) & (high <= ceiling)
                        out |= open_[:, p, None] & other[:, at] & (low <= ceiling) & (high >= np.maximum(floor, kth(low, sure, k)[:, None]))
                    return out

                at, low, high = bounded(x.anchors, x.rows, cuts, in_reach)
                still, out = wanted(at, low, high), []
                for i in np.flatnonzero(still.any(axis=1)):
                    js = at[still[i]]
                    found = scores(x.anchors, i, x.rows, js)
                    for p in np.flatnonzero(open_[i]):
                        inside = np.flatnonzero((found >= int(least[i, p])) & (found <= int(most[i, p])))
                        top = inside[best(found[inside], x.ids[js[inside]], k)]
                        out.append((np.full(len(top), x.a_keys[i]), np.full(len(top), x.a_ids[i]), np.full(len(top), p_keys[i, p]), np.full(len(top), p_ids[i, p]), np.full(len(top), p_scores[i, p]), x.ids[js[top]], found[top]))
                yield from joined(out, ("a_key", "anchor_id", "p_key", "positive_id", "positive_score", "negative_id", "score"))

    return met.mapInPandas(search, "a_key bigint, anchor_id bigint, p_key bigint, positive_id bigint, positive_score bigint, negative_id bigint, score bigint")


def mine(
    vectors: DataFrame, anchors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, from_percent: int = FROM_PERCENT, to_percent: int = TO_PERCENT, scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every anchor and each of its `positives`
    (POSITIVES at most) best rows of its label, the `negatives` best rows of other labels that score between from_percent and to_percent of the positive.

    Components x become floor(scale * x); scores are integer inner products, ties go to the smaller id. Rows without
    an id or a label, with a null vector or a null or non-finite component take no part. Components and scores beyond
    the range of BIGINT count as its ends; all others are exact. Shorter vectors count as zero beyond their end. An
    anchor leaves out every row with its own id; repeated ids are rows of their own. Anchors without positives, and
    positives with an empty window (scores below zero) give no rows, nor do empty tables; other columns are not read.
    """
    if positives > POSITIVES:
        raise ValueError(f"at most {POSITIVES} positives")
    x = F.col(vec_col)

    def whole(df: DataFrame) -> DataFrame:
        rows = df.where(takes_part(x) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        return saved(rows.select(F.col(id_col).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("key"), F.col(label_col).cast("bigint").alias("label"), whole_components(x, scale).alias("v")))

    rows, asked = whole(vectors), whole(anchors)
    turn, cuts = rotation(moments(rows.unionAll(asked)))
    blocks, first = saved(_packed(rows, ROW_BLOCK, [])), saved(_packed(asked, ANCHOR_BLOCK, []))
    by_score = Window.partitionBy("a_key").orderBy(F.desc("score"), "positive_id", "p_key")
    near = saved(_positives(_tiles(blocks, first), turn, cuts, positives).withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= positives))
    lists = near.groupBy("a_key").agg(F.array_sort(F.collect_list(F.struct("n", "p_key", "positive_id", "score"))).alias("p"))  # POSITIVES at most
    opened = asked.join(lists, asked["key"] == lists["a_key"]).select("id", "key", "label", "v", F.col("p.p_key").alias("p_keys"), F.col("p.positive_id").alias("p_ids"), F.col("p.score").alias("p_scores"))
    second = saved(_packed(opened, ANCHOR_BLOCK, ["p_keys", "p_ids", "p_scores"]))
    found = _negatives(_tiles(blocks, second), turn, cuts, negatives, from_percent, to_percent)
    order = Window.partitionBy("a_key", "p_key").orderBy(F.desc("score"), "negative_id")
    out = saved(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives))
    discard(rows, asked, blocks, first, near, second)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh vector's label is moved on by one first."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mine(vectors, vectors.where("vec_id % 100 = 0"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
