"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding lowers case, maps homoglyphs of other alphabets and digit or sign substitutions to one letter (i, l and
1 fall together) and turns the rest into single spaces. Lexicon entries are whole words or beginnings of words;
their weights are smoothed log-odds of the labels, learned from one half of a bounded sample of labelled rows.
Exception phrases (a given list, and pairs of words that stand in clean rows only) silence what lies inside.
A document's weights are summed, normalised by its length, and turned into a probability by a logistic curve
that is fitted on the other half of the sample.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm.common import discard, in_training, saved, small, table

THRESHOLD = 0.3
#: The learner sees so many labelled ids at most, chosen by a hash, and so many rows of each: of an id that is repeated
#: more often, the first by a hash of their texts.
FIT_ROWS = 24_000
ROWS_PER_ID = 4
MAX_ENTRIES = 4_000
MIN_TOXIC_DOCS = 4
MIN_CLEAN_DOCS = 5
MIN_WEIGHT = 1.5
PREFIXES = (4, 5, 6, 7, 8)
EXCEPTIONS = ("trash can", "clown fish", "idiot proof", "sore loser")

#: Letters that look alike, substitutions, marks without width.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏԛԝвкмнтαεικνορτυχ", "aeopcyxijsdhlqwbkmhtaeiknoptux", strict=True))
SUBSTITUTES = {"0": "o", "1": "i", "l": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
WIDTHLESS = "­​‌‍⁠﻿"

_TABLE = {ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTES).items()} | {ord(c): None for c in WIDTHLESS}
_TABLE |= {i: " " for i in range(128) if not chr(i).isalnum()}
_SIGN = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])")  # a sign counts as a letter only inside a word


def fold(text: str) -> str:
    """Folded words, one space between, before and after them."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return f" {' '.join(text.translate(_TABLE).split())} "


def _entries(folded: str) -> set[str]:
    """Candidate entries of a folded text: ' word ' and ' beginning'."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in PREFIXES if len(word) > n)
    return out


@dataclass
class Lexicon:
    """Weights by entry, exception phrases, and the logistic curve over features()."""

    weights: dict[str, float]
    exceptions: list[str]
    curve: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        self._build()

    def _build(self) -> None:
        self.machine = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            self.machine.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            self.machine.add_word(phrase, (len(phrase), 0.0))
        if len(self.machine):
            self.machine.make_automaton()

    def __getstate__(self) -> tuple:
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state: tuple) -> None:
        self.weights, self.exceptions, self.curve = state
        self._build()

    def matches(self, folded: str) -> dict[int, float]:
        """Highest weight by the place where a matched word begins."""
        if not len(self.machine):
            return {}
        best: dict[int, float] = {}
        silent = []
        for end, (size, weight) in self.machine.iter(folded):
            start = end - size + 1
            if weight == 0.0:
                silent.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        for a, b in silent:
            for start in [s for s in best if a <= s < b]:
                del best[start]
        return best

    def features(self, text: str) -> tuple[float, float, float]:
        folded = fold(text)
        found = self.matches(folded)
        total = sum(found.values())
        words = max(1, folded.count(" ") - 1)
        return math.log1p(total), math.log1p(100 * total / words), max(found.values(), default=0.0)

    def score(self, text: str) -> float:
        z = self.curve[0] + sum(c * x for c, x in zip(self.curve[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton's method; weights of the columns are held at 0 or above (more toxic matches never lower a score)."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w[1:] = np.maximum(w[1:], 0)
    return tuple(map(float, w))


def _by_label(rows: DataFrame, phrases_of: Callable[[str], Iterable[str]]) -> DataFrame:
    """(entry, toxic, clean): rows of each label that hold an entry; each batch is summed before the shuffle."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                for entry in phrases_of(fold(text)):
                    found.setdefault(entry, [0, 0])[0 if toxic == 1 else 1] += 1
            counts = np.array(list(found.values()), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"entry": pd.Series(list(found), dtype=object), "toxic": counts[:, 0], "clean": counts[:, 1]})

    return rows.select("text", "toxic").mapInPandas(count, "entry string, toxic bigint, clean bigint").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _weighted(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """(entry, weight): smoothed log-odds, less a margin for rare entries."""
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    weight = F.round(odds - 1 / F.sqrt("toxic"), 9)  # rounded, so that ties are ties wherever it is computed
    return counts.where(F.col("toxic") >= MIN_TOXIC_DOCS).select("entry", weight.alias("weight")).where(F.col("weight") >= MIN_WEIGHT)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS, max_entries: int = MAX_ENTRIES) -> Lexicon:
    """Learns from labelled rows that in_training() admits: `fit_rows` ids at most, ROWS_PER_ID rows of each. Without any, every score is the curve's low end.

    Null labels and labels of absent documents are not used; an id that is labelled twice has its greater label; null
    and empty texts count as rows without entries; the longest texts are read whole; a document that is repeated
    counts as often, up to ROWS_PER_ID times. The lexicon keeps the `max_entries` entries of greatest weight (ties by their letters), and as
    many exception phrases, most frequent first.
    """
    chosen = labels.where(F.col("toxic").isNotNull() & in_training(F.col(id_col))).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    chosen = saved(chosen.orderBy(F.xxhash64(F.col(id_col), F.lit("fit")), id_col).limit(fit_rows))
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(small(chosen), id_col)
    of_id = Window.partitionBy(id_col).orderBy(F.xxhash64("text"), "text")
    rows = rows.withColumn("n", F.row_number().over(of_id)).where(F.col("n") <= ROWS_PER_ID)
    rows = saved(rows.select("text", F.col("toxic").cast("int").alias("toxic"), (F.pmod(F.xxhash64(F.col(id_col), F.lit("half")), F.lit(2)) == 0).alias("first")))
    discard(chosen)
    first = rows.where("first")
    n_toxic, n_clean = first.where("toxic = 1").count(), first.where("toxic <> 1").count()
    best = _weighted(_by_label(first, _entries), n_toxic, n_clean).orderBy(F.desc("weight"), "entry").limit(max_entries)
    lexicon = Lexicon({r["entry"]: r["weight"] for r in best.collect()}, [fold(p) for p in exceptions])
    words = frozenset(e.strip() for e in lexicon.weights if e.endswith(" "))
    if words:

        def pairs(folded: str) -> set[str]:
            w = folded.split()
            return {f" {a} {b} " for a, b in zip(w, w[1:], strict=False) if a in words or b in words}

        harmless = _by_label(first, pairs).where((F.col("clean") >= MIN_CLEAN_DOCS) & (F.col("toxic") == 0)).orderBy(F.desc("clean"), "entry").limit(max_entries)
        lexicon = Lexicon(lexicon.weights, lexicon.exceptions + sorted(r["entry"] for r in harmless.collect()))
    learned = Lexicon(lexicon.weights, lexicon.exceptions, (0.0, 0.0, 0.0, 0.0))

    def measure(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([learned.features(t) for t in batch["text"]]).reshape(-1, 3)
            yield pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "toxic": batch["toxic"].to_numpy()})

    second = np.array([tuple(r) for r in rows.where("not first").select("text", "toxic").mapInPandas(measure, "a double, b double, c double, toxic int").collect()]).reshape(-1, 4)
    discard(rows)
    lexicon.curve = _logistic(second[:, :3], second[:, 3]) if len(second) else (-5.0, 0.0, 0.0, 0.0)
    return lexicon


def score_documents(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows and columns of `docs` with `score_col` (double, 0 to 1).

    Null and empty texts have no match and get the curve's low end; texts of any length are read whole;
    repeated rows get equal scores; an empty table gives no rows.
    """
    return docs.withColumn(score_col, _scorer(docs.sparkSession, lexicon)(F.col(text_col)))


def _scorer(spark: SparkSession, lexicon: Lexicon) -> Callable[[Column], Column]:
    shared = spark.sparkContext.broadcast(lexicon)  # at most MAX_ENTRIES entries and phrases

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = shared.value
        for series in texts:
            yield pd.Series([machine.score(t or "") for t in series], dtype="float64")

    return score


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from the labels outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score below the threshold, with their own columns, whatever their names.

    Null and empty texts score at the curve's low end and so stay; repeated rows stay or go together; texts of any
    length are scored whole; an empty table gives no rows.
    """
    scored = docs.select(F.struct(*docs.columns).alias("row"), _scorer(docs.sparkSession, lexicon)(F.col(text_col)).alias("score"))
    return scored.where(F.col("score") < threshold).select("row.*")
