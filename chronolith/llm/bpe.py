"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A slice of the corpus (one Arrow batch of documents) is split into words by the tokenizer's pattern. Its
distinct words are laid end to end as byte tokens in one doubly linked list. An inverted index maps the rank
of every adjacent pair to the positions where it stands; merges are replayed in rank order over all words at
once, and each merge re-indexes only the two pairs that touch it. Words that were replayed are remembered by
the worker (a bounded table; it only saves time), so common words are merged once per worker.

The ids equal those of the reference tokenizer library: within a word the lowest rank goes first, leftmost
first among equals.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Remembered words per worker; beyond it the table starts anew, and takes over what it meets of the one before. Very long
#: words are not kept.
REMEMBERED_WORDS = 250_000
REMEMBERED_LENGTH = 64
#: Pairs of ids whose rank a worker remembers.
REMEMBERED_PAIRS = 300_000
#: Characters that are encoded at a time: a worker holds lists over every byte of a slice's new words.
PIECE_CHARS = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken vocabulary file: base64 bytes and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Encodes words by replaying merges over an inverted index of pairs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.byte_pairs = np.array([ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)], np.int64).reshape(256, 256)
        self.pattern = regex.compile(pattern)
        self.pair_ids: dict[int, int] = {}  # pair of ids, as one number -> rank of their concatenation, -1 if none
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before the table last started anew

    def _pair(self, a: int, b: int) -> int:
        key = a << 32 | b
        rank = self.pair_ids.get(key)
        if rank is None:
            rank = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
            if len(self.pair_ids) >= REMEMBERED_PAIRS:
                self.pair_ids.clear()
            self.pair_ids[key] = rank
        return rank

    def replay(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word, as unsigned 32-bit integers."""
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        held = np.unique(ends[ends > 0])  # where words end that are not empty
        follows, leads = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        follows[held - 1] = -1
        leads[:1] = -1
        leads[held[:-1]] = -1
        at = np.flatnonzero(follows >= 0)
        ranks = self.byte_pairs[data[at], data[at + 1]]
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        pending, cuts = np.unique(ranks[order], return_index=True)
        pending = pending.tolist()  # in order: a heap
        index: dict[int, list[int]] = {rank: x.tolist() for rank, x in zip(pending, np.split(at[order], cuts[1:]))}
        ids: list[int] = self.byte_ids[data].tolist()
        after: list[int] = follows.tolist()  # position of the next token of the same word, -1 at its end
        before: list[int] = leads.tolist()
        known, pair, push = self.pair_ids.get, self._pair, heapq.heappush
        while pending:
            rank = heapq.heappop(pending)
            places = index.pop(rank, None)
            if not places:
                continue
            places.sort()
            for at, i in enumerate(places):
                j, left = after[i], ids[i]
                if left < 0 or j < 0:
                    continue
                found = known(left << 32 | ids[j])
                if (pair(left, ids[j]) if found is None else found) != rank:
                    continue  # a neighbour's merge took this pair
                ids[i], ids[j] = rank, -1
                after[i] = k = after[j]
                lowest, h = rank, before[i]
                if h >= 0:
                    new = known(ids[h] << 32 | rank)
                    if new is None:
                        new = pair(ids[h], rank)
                    if new >= 0:
                        if new in index:
                            index[new].append(h)
                        else:
                            index[new] = [h]
                            push(pending, new)
                        if new < lowest:
                            lowest = new
                if k >= 0:
                    before[k] = i
                    new = known(rank << 32 | ids[k])
                    if new is None:
                        new = pair(rank, ids[k])
                    if new >= 0:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            push(pending, new)
                        if new < lowest:
                            lowest = new
                if lowest < rank:  # a vocabulary whose parts rank above their whole: that pair goes first
                    index.setdefault(rank, []).extend(places[at + 1 :])
                    push(pending, rank)
                    break
        tokens = np.array(ids, np.int64)
        left = np.flatnonzero(tokens >= 0)
        return np.split(tokens[left].astype("<u4"), np.searchsorted(left, ends[:-1])) if words else []

    def encode_batch(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(text) for text in texts]
        known = self.known
        unknown = {word for words in split for word in words if word not in known}
        for word in unknown & self.older.keys() if self.older else ():
            known[word] = self.older.pop(word)
            unknown.discard(word)
        if new := sorted(unknown):
            ids = self.replay([word.encode("utf-8", "surrogatepass") for word in new])
            known.update(zip(new, (x.tobytes() for x in ids), strict=True))
        encoded = [b"".join(map(known.__getitem__, words)) for words in split]
        for word in new:
            if len(word) > REMEMBERED_LENGTH:
                del known[word]
        if len(known) > REMEMBERED_WORDS:
            self.known, self.older = {}, known
        return encoded

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: The encoder of the query that this worker served last, for its next task.
_last: dict[str, MergeReplay] = {}


def _kept(query: str, ranks: dict[bytes, int], pattern: str) -> MergeReplay:
    """The worker's encoder of this query, with the words that its earlier tasks met."""
    if query not in _last:
        _last.clear()
        _last[query] = MergeReplay(ranks, pattern)
    return _last[query]


def _pieces(texts: list[str], chars: int = PIECE_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about so many characters; a longer text is a run of its own."""
    run, held = [], 0
    for text in texts:
        if run and held + len(text) > chars:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (binary), n_tokens, decoded (binary: the bytes that the ids stand for).

    A null text counts as empty; an empty text has no ids. Repeated rows give repeated rows, texts of any
    length are encoded whole, a null id stays null, an empty table gives no rows, and no other column is read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((load_ranks(vocabulary), pattern))  # bounded by the vocabulary
    query = uuid.uuid4().hex

    @F.pandas_udf("ids binary, n_tokens bigint, decoded binary")
    def encode(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        replay = _kept(query, *shared.value)
        for batch in series:
            for run in _pieces(batch.tolist()):
                ids = replay.encode_batch(run)
                yield pd.DataFrame({"ids": ids, "n_tokens": np.array([len(x) // 4 for x in ids], np.int64), "decoded": [replay.decode(x) for x in ids]})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), encode(F.coalesce(F.col(text_col), F.lit(""))).alias("e"))
    return rows.select("doc_id", "e.*")


def default_vocabulary() -> tuple[str, str]:
    """Path and pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and what they decode to, as digests."""
    encoded = encode_documents(table(spark, sf_dir, "documents"), *default_vocabulary())
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
