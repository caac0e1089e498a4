"""Substring dedup: windows of fifty words that an earlier document has too, by counted Rabin-Karp hashes.

Every window is hashed by Rabin-Karp over its words' hashes. Those whose anchor is shared between documents
(see repeats) are counted in Spark by hash; a window that also starts in a document with a smaller id is
flagged, and flagged windows merge into maximal removal intervals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import discard, saved, table
from chronolith.llm.repeats import KEYS, by_windows, contents, covered, distinct, flagged, keyed, mark, mix, rolled, survivors

WINDOW = 50
GRAM = 8
#: A fixed random value for each byte, and a base for the places inside a word.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    codes = np.frombuffer(b"".join(words), np.uint8)
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    longest = int(sizes.max())
    powers = np.cumprod(np.full(longest, _BASE, np.uint64)) if longest > len(_POWERS) else _POWERS
    return mix(np.add.reduceat(_BYTES[codes] * powers[place], starts) + sizes.astype(np.uint64))


_POWERS = np.cumprod(np.full(256, _BASE, np.uint64))


def _windows(size: int) -> Callable:
    def of(_: bytes, hashes: np.ndarray) -> Callable[[int, int], np.ndarray]:
        w = mix(rolled(hashes, size)).view(np.int64)
        return lambda a, b: w[a : b + 1]

    return of


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per input row: id, kept (binary: kept words joined by one space), n_words, n_removed.

    Words are runs of bytes other than the six ASCII spaces. A null text has no words; a text of fewer than
    `size` words keeps all of them; rows that repeat an id are judged against smaller ids only, so they do not
    remove each other; a row with a null id keeps all its words and
    removes none elsewhere; an empty table gives no rows; other columns
    are not read.
    """
    texts = keyed(docs, id_col, text_col)
    of = _windows(size)
    rows, names = survivors(mark(texts.where("id is not null"), word_hashes, size, gram, of), F.min("id") < F.max("id"))
    found = distinct(rows)
    held = saved(contents(texts, names, found.where("m > 1"), word_hashes, of, "array<bigint>"))
    earlier = lambda first_id, _first, i, _start: first_id < i
    starts = saved(by_windows(held, F.col("content"), earlier))
    discard(held)
    spans = flagged(rows, names, found, starts, earlier)

    @F.pandas_udf("kept binary, n_words bigint, n_removed bigint")
    def keep(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in series:
            out = []
            for text, starts in zip(texts, spans, strict=True):
                words = text.split()
                gone = covered(len(words), starts, size)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
                out.append((b" ".join(kept), len(words), len(words) - len(kept)))
            yield pd.DataFrame(out, columns=["kept", "n_words", "n_removed"])

    return texts.join(spans, KEYS, "left").select("id", keep("text", "spans").alias("k")).select("id", "k.*")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without its repeated windows of fifty words."""
    found = repeated_words(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
