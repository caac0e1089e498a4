"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of lower-cased letters (all else is one space), hashed into a fixed number of
columns, weighted by 1+log(tf) and inverse document frequency, and scaled to length 1. The model is trained
with follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties) on a bounded sample of labelled
rows, then calibrated with one temperature on rows of that sample that training did not see.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm.common import in_training, saved, small, table

#: The learner sees about so many ids of each language, chosen by a hash, and so many rows of each: of an id that is repeated
#: more often, the first by a hash of their texts.
ROWS_PER_LANGUAGE = 700
ROWS_PER_ID = 4
COLUMNS = 1 << 14
ORDERS = (1, 2, 3)
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-3, 1e-3
UNKNOWN = "und"
#: Texts are read whole, in blocks of so many characters.
BLOCK = 1 << 20


def _lower(code: int) -> int:
    """The lower-cased letter of a code point, or a space for all that is no letter."""
    c = chr(code)
    low = c.lower()
    return (ord(low) if len(low) == 1 else code) if c.isalpha() else 32


_LETTERS: list[np.ndarray] = []


def _folded(text: str) -> np.ndarray:
    """Lower-cased letters and spaces, as code points; the basic plane by a table, what lies beyond by its few different values."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter(map(_lower, range(1 << 16)), np.uint32, 1 << 16))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _LETTERS[0][np.minimum(codes, 0xFFFF)]
    beyond = codes > 0xFFFF
    if beyond.any():
        values, which = np.unique(codes[beyond], return_inverse=True)
        out[beyond] = np.fromiter(map(_lower, values.tolist()), np.uint32, len(values))[which]
    return out


def counts(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """(columns, counts) of the text's n-grams, and whether it holds a letter. Blocks carry their last letters over, so they leave no trace."""
    total = np.zeros(COLUMNS, np.int64)
    lettered = False
    carried = np.zeros(0, np.uint64)
    for at in range(0, len(text) + 1, BLOCK):
        part = _folded(text[at : at + BLOCK])
        lettered |= bool((part != 32).any())
        edge = np.full(1, 32, np.uint32)
        codes = np.concatenate([carried, edge[: at == 0], part, edge[: at + BLOCK > len(text)]]).astype(np.uint64)
        skip = np.ones(len(codes), bool)
        skip[1:] = (codes[1:] != 32) | (codes[:-1] != 32)  # runs of what is no letter are one space
        codes = codes[skip]
        h = np.zeros(len(codes), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if len(codes) < n:
                break
            h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
            if n in ORDERS:
                mixed = h[max(0, len(carried) - n + 1) :] * np.uint64(0xD6E8FEB86659FD93)  # those that end in this block
                total += np.bincount((mixed >> np.uint64(50)).astype(np.int64), minlength=COLUMNS)
        carried = codes[-(max(ORDERS) - 1) :]
    used = np.nonzero(total)[0]
    return used, total[used], lettered


@dataclass
class Model:
    """Languages, idf by column, weights by column and language, and a temperature."""

    languages: list[str]
    idf: np.ndarray = field(default_factory=lambda: np.ones(COLUMNS))
    weights: np.ndarray | None = None
    temperature: float = 1.0

    def vector(self, columns: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = (1 + np.log(tf)) * self.idf[columns]
        return x / max(1e-12, float(np.sqrt(x @ x)))

    def logits(self, columns: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[columns] + self.weights[COLUMNS]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability); UNKNOWN and 0 without a letter or without a learned language."""
        columns, tf, lettered = counts(text or "")
        if not lettered or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(columns, self.vector(columns, tf)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], languages: list[str], seed: int = 7) -> Model:
    """train_counts() of texts, with their own document frequencies."""
    rows = [counts(t)[:2] for t in texts]
    df = np.zeros(COLUMNS)
    for columns, _ in rows:
        df[columns] += 1
    return train_counts(rows, languages, df, len(rows), seed)


def train_counts(rows: list[tuple[np.ndarray, np.ndarray]], languages: list[str], df: np.ndarray, documents: int, seed: int = 7) -> Model:
    """FTRL-proximal on four fifths of the rows (columns, counts), temperature on the rest. df: documents by column, of so many."""
    model = Model(sorted(set(languages)))
    k = len(model.languages)
    model.idf = np.log((1 + documents) / (1 + df)) + 1
    xs = [(np.append(c, COLUMNS), np.append(model.vector(c, tf), 1.0)) for c, tf in rows]
    ys = [model.languages.index(x) for x in languages]
    order = np.random.default_rng(seed).permutation(len(rows))
    held = order[: len(order) // 5] if len(order) >= 10 else order
    seen = order[len(order) // 5 :] if len(order) >= 10 else order
    z, n = np.zeros((COLUMNS + 1, k)), np.zeros((COLUMNS + 1, k))

    def leader(zc: np.ndarray, nc: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zc) * np.maximum(np.abs(zc) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(nc)) / ALPHA + L2)

    for _ in range(EPOCHS):
        for i in seen:
            c, x = xs[i]
            zc, nc = z[c], n[c]
            w = leader(zc, nc)
            p = _softmax(x @ w)
            p[ys[i]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(nc + g * g) - np.sqrt(nc)) / ALPHA
            z[c] = zc + g - sigma * w
            n[c] = nc + g * g
    model.weights = leader(z, n)
    logits = np.array([x @ model.weights[c] for c, x in (xs[i] for i in held)])
    truth = np.array([ys[i] for i in held])
    grid = np.exp(np.linspace(np.log(0.05), np.log(10), 80))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents by column over all rows of (text), and how many there are; each task sums its own before the shuffle."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(COLUMNS + 1, np.int64)
        for batch in batches:
            for text in batch["text"]:
                df[counts(text)[0]] += 1
                df[COLUMNS] += 1
        used = np.nonzero(df)[0]
        yield pd.DataFrame({"column": used.astype(np.int32), "n": df[used]})

    df = np.zeros(COLUMNS + 1)
    for r in texts.mapInPandas(count, "column int, n bigint").groupBy("column").agg(F.sum("n").alias("n")).collect():  # COLUMNS + 1 rows at most
        df[r["column"]] = r["n"]
    return df[:COLUMNS], int(df[COLUMNS])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learns from the rows that in_training() admits: about `rows_per_language` ids of each language at most, ROWS_PER_ID rows of each.

    Document frequencies are counted over all admitted rows. Of the sample the driver gets counts, COLUMNS a row at
    most, so the length of texts plays no part; it holds every language that has a row. Rows with a null text or
    language are not used; empty texts count as rows without letters; repeated rows count as often, up to ROWS_PER_ID times
    of an id (null ids are one); ties between languages go to the first by name; without admitted rows the model knows
    no language.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & in_training(F.col(id_col)))
    labelled = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    ids = F.least(F.count(F.lit(1)), F.approx_count_distinct(F.coalesce("id", F.lit(0))))  # rows, or fewer where ids are repeated
    share = labelled.groupBy("lang").agg((F.lit(float(1 << 30)) * F.least(F.lit(1.0), rows_per_language / ids)).cast("bigint").alias("share"))

    @F.pandas_udf("columns array<int>, counts array<int>")
    def counted(series: pd.Series) -> pd.DataFrame:
        found = [counts(t) for t in series]
        return pd.DataFrame({"columns": [c.astype(np.int32) for c, _, _ in found], "counts": [np.minimum(n, (1 << 31) - 1).astype(np.int32) for _, n, _ in found]})

    chosen = labelled.join(small(saved(share)), "lang").where(F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30)) < F.col("share"))
    of_id = Window.partitionBy("lang", "id").orderBy(F.xxhash64("text"), "text")
    bounded = chosen.withColumn("n", F.row_number().over(of_id)).where(F.col("n") <= ROWS_PER_ID)  # each task keeps no more before the shuffle
    sample = bounded.select("id", "lang", F.xxhash64("text").alias("th"), counted("text").alias("c")).collect()
    if not sample:
        return Model([])
    sample.sort(key=lambda r: (r["id"] is None, r["id"], r["th"]))
    rows = [(np.array(r["c"]["columns"], np.int64), np.array(r["c"]["counts"], np.int64)) for r in sample]
    return train_counts(rows, [r["lang"] for r in sample], *_document_frequencies(labelled.select("text")))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows and columns of `docs`, whatever their names, with lang_pred and score (which replace columns of those names).

    Null texts and texts without a letter are `und` with score 0; texts of any length are read whole; repeated
    rows get equal predictions; with no labelled row to learn from, every text is `und`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # COLUMNS x languages

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            found = [shared.value.predict(t) for t in series]
            yield pd.DataFrame({"lang_pred": pd.Series([x for x, _ in found], dtype=object), "score": pd.Series([x for _, x in found], dtype="float64")})

    found = docs.select(F.struct(*docs.columns).alias("row"), predict(F.col(text_col)).alias("p"))
    return found.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score")), "p.lang_pred", "p.score")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
