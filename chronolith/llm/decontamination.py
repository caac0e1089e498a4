r"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts are lower-cased words of letters and digits; in scripts without spaces every letter is a word. A mask samples
words of a span and ignores those in between, so a substituted word there does not hide a match. The hashed seeds
of the benchmark meet those of all documents; a hit fixes how an item would lie on a document (the diagonal), and
the words around it are compared: an overlap is a stretch of WINDOW aligned words with at least 80 % equal, or the
whole item with at least 80 % equal. Items of fewer than MIN_WORDS words must lie on a document word by word.

Every way of substituting words that these rules accept leaves a seed of SEEDS whole (a test goes through them all).
OP9_SQL states the same rules without seeds: it lays every item on every document wherever one word agrees.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import saved, small, table

#: Items with fewer words cannot be told from chance if words are substituted; only exact copies of them count.
MIN_WORDS = 8
WINDOW = 13
SIMILARITY = 0.8
#: Masks of the operator: sampled positions, and the least and most words of the items that need them.
SEEDS = (((0, 1, 2, 3, 4), MIN_WORDS, None), ((0, 1, 2, 4, 5), MIN_WORDS, None), ((0, 1, 2, 3), 10, 11), *((tuple(range(n)), n, n) for n in range(1, MIN_WORDS)))
#: Letters of scripts that put no spaces between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"


def word_hashes(text: Column) -> Column:
    """Hashes of the text's words; null: none."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    spaced = F.when(F.length(lower) == F.octet_length(lower), lower).otherwise(F.regexp_replace(lower, f"({UNSPACED})", " $1 "))
    words = F.split(spaced, r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(texts: DataFrame, keep: list[str], masks: list[int]) -> DataFrame:
    """(kept columns, at, mask, seed) for every place and each of `masks`; `h` holds the word hashes. Spans that leave the text have no seed."""
    h = F.col("h")

    def at(i: Column) -> Column:
        return F.named_struct(F.lit("at"), i, *(x for m in masks for x in (F.lit(f"s{m}"), F.when(i + SEEDS[m][0][-1] < F.size(h), F.xxhash64(*(F.get(h, i + o) for o in SEEDS[m][0]))))))

    shortest = min(SEEDS[m][0][-1] for m in masks) + 1
    places = F.when(F.size(h) >= shortest, F.sequence(F.lit(0), F.size(h) - shortest))
    each = texts.select(*keep, F.inline(F.transform(places, at)))
    return each.select(*keep, "at", F.stack(F.lit(len(masks)), *(x for m in masks for x in (F.lit(m), F.col(f"s{m}")))).alias("mask", "seed")).where("seed IS NOT NULL")


def _needs(m: int, n: Column) -> Column:
    """True for items of `n` words that need the mask."""
    return n.between(SEEDS[m][1], SEEDS[m][2] if SEEDS[m][2] is not None else (1 << 31) - 1)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, overlaps, similarity): documents that hold benchmark items or parts of them.

    `overlaps` counts the diagonals that were verified, `similarity` is the best share of an item's words that
    lie equal on one of them. At other windows and similarities than the given ones seeds may miss some. Null and empty texts have no words and no match; a repeated document or item row
    counts once; rows without an id take part under a null id; empty tables give no rows; long documents are read
    whole; other columns are not read. Frequent seeds are rows of their own, never gathered.
    """
    found = _verified(docs, benchmark, id_col, text_col, item_col, item_text, window, similarity)
    return found.groupBy("doc_id", "item_id").agg(F.count_distinct("diagonal").alias("overlaps"), F.max("similarity").alias("similarity"))


def _verified(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, th, item_id, diagonal, similarity) of the diagonals on which an item lies on a text; th: hash of the text."""
    items = saved(benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), word_hashes(F.col(item_text)).alias("ih")).where(F.size("ih") > 0).distinct())
    size = F.size("ih")
    needed = items.agg(*(F.max(_needs(m, size)).alias(f"m{m}") for m in range(len(SEEDS)))).first()  # one row
    masks = [m for m in range(len(SEEDS)) if needed[f"m{m}"]] or [0]
    wanted = seeds(items.withColumnRenamed("ih", "h").withColumn("n", F.size("h")), ["item_id", "n"], masks)
    fits = reduce(lambda x, y: x | y, [(F.col("mask") == m) & _needs(m, F.col("n")) for m in masks])
    wanted = saved(wanted.where(fits).select("mask", "seed", "item_id", F.col("at").alias("item_at")).distinct())
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    hashed = texts.select("doc_id", "th", word_hashes(F.col("text")).alias("h"))
    found = seeds(hashed, ["doc_id", "th"], masks).join(small(wanted), ["mask", "seed"])
    hits = saved(found.select("doc_id", "th", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct())
    placed = texts.withColumnRenamed("doc_id", "id").join(small(hits), F.col("id").eqNullSafe(F.col("doc_id")) & (texts["th"] == hits["th"])).select("doc_id", hits["th"], "item_id", "diagonal", word_hashes(F.col("text")).alias("h"))
    aligned = placed.join(small(items, 8 * F.size("ih") + 64), placed["item_id"].eqNullSafe(items["item_id"])).select(
        "doc_id", "th", placed["item_id"], "diagonal",
        F.transform("ih", lambda x, k: F.when(F.get(F.col("h"), F.col("diagonal") + k) == x, 1).otherwise(0)).alias("equal"),
    )
    n = F.size("equal")
    length = F.least(n, F.lit(window))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    enough = F.exists(F.sequence(F.lit(1), n - length + 1), lambda s: total(F.slice(F.col("equal"), s, length)) >= F.ceil(F.lit(similarity) * length))
    whole = total(F.col("equal")) >= F.when(n < MIN_WORDS, n).otherwise(F.ceil(F.lit(similarity) * n))
    return aligned.where(whole | ((n >= MIN_WORDS) & enough)).select("doc_id", "th", "item_id", "diagonal", (total(F.col("equal")) / n).alias("similarity"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without an overlap, with their own columns.

    Null and empty texts stay; of rows that share an id, or have none, only those whose own text overlaps go; repeated
    rows stay or go together; texts of any length are read whole; an empty table gives no rows, an empty benchmark
    keeps all; an item whose word sequence is empty matches nothing.
    """
    leaked = _verified(docs, benchmark, id_col, text_col).select(F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__none"), F.col("th").alias("__th")).distinct()
    own = docs[id_col].cast("bigint")
    same = (F.coalesce(own, F.lit(0)) == leaked["__id"]) & (own.isNull() == leaked["__none"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == leaked["__th"])
    return docs.join(leaked, same, "left_anti")


def _sql_words(text: str) -> str:
    lower = f"lower(coalesce({text}, ''))"
    scripts = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]"
    spaced = f"regexp_replace({lower}, '({scripts})', ' \\1 ', 'g')"
    return f"list_filter(string_split_regex({spaced}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


OP9_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, {_sql_words('text')} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_sql_words('text')} AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM d),
bw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM b),
h AS (
  SELECT doc_id, item_id, dw.at - bw.at AS diagonal FROM dw JOIN bw USING (word)
  GROUP BY doc_id, item_id, diagonal, n HAVING count(*) >= ceil({SIMILARITY} * least(n, {WINDOW}))
),
e AS (
  SELECT h.doc_id, h.item_id, h.diagonal, len(b.w) AS n,
         list_transform(generate_series(1, len(b.w)), lambda k: CASE WHEN h.diagonal + k >= 1 AND d.w[h.diagonal + k] = b.w[k] THEN 1 ELSE 0 END) AS equal
  FROM h JOIN d ON h.doc_id = d.doc_id JOIN b ON h.item_id = b.item_id
),
v AS (
  SELECT doc_id, item_id, diagonal, CAST(list_sum(equal) AS DOUBLE) / n AS similarity FROM e
  WHERE list_sum(equal) >= CASE WHEN n < {MIN_WORDS} THEN n ELSE ceil({SIMILARITY} * n) END
     OR n >= {MIN_WORDS} AND len(list_filter(generate_series(1, n - least(n, {WINDOW}) + 1),
        lambda s: list_sum(equal[s : s + least(n, {WINDOW}) - 1]) >= ceil({SIMILARITY} * least(n, {WINDOW})))) > 0
)
SELECT doc_id, item_id, count(DISTINCT diagonal) AS overlaps, max(similarity) AS similarity FROM v GROUP BY doc_id, item_id
"""
