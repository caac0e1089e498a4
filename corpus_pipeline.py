"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, documents that hold
benchmark passages go, personal data is replaced, and what is left becomes token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each works on all rows that the one before it
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import bpe, decontamination, pii, simhash, toxicity
from chronolith.llm.common import discard, result, scratch, table

#: Learned lexicons and merges by rank have no SQL form; tests hold run() against plain Python on a made-up corpus.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the lexicon is learned from the labels of these documents.

    Null and empty texts have no match and stay; rows that are repeated stay or go together; texts are read whole;
    without labels nothing goes; an empty table stays empty; other columns are kept as they are.
    """
    return toxicity.keep_civil(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: SimHash fingerprints two bits apart at most, or
    five-word shingles alike at 0.8 or more.

    Null, empty and blank texts are one group; a row that is repeated stays once; a null id comes after all others;
    rows of one id whose texts are not alike all stay; texts are read whole; an empty table stays empty.
    """
    return simhash.keep_first(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item.

    Null and empty texts stay; every row is judged by its own text, whatever its id; an empty table stays empty.
    """
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and revealing terms replaced in their texts; n_chars follows the text.

    Null texts stay null and keep their n_chars; texts without spans stay as they are; repeated rows stay apart.
    """
    cleaned = pii.sanitise(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): token ids of every document, and the digest of what they decode to.

    Null texts count as empty and have no ids; repeated rows give repeated rows; an empty table gives no rows.
    """
    encoded = bpe.encode_documents(docs, *bpe.default_vocabulary())
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaked),
    ("pii", replace_personal_data),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over all of ``documents``; each result is written before the next reads it.

    What a stage wrote on its way goes when the stage ends, and its input with it.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with scratch():
            docs = result(stage(spark, docs, sf_dir))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
