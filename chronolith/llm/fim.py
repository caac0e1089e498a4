"""Fill-in-the-middle: texts cut at token borders into prefix, middle and suffix, and put in a new order.

A token is a word with the white space before it; white space at a text's end is a token of its own. The kernel works
on the UTF-8 buffer of a whole slice of texts: a table gives each byte its class, a mask of adjacent bytes marks where
tokens end, running sums that start anew in each text count them, and one binary search for all rows finds the cuts.
Pieces are then three slices of the same buffer for every row; no text is split or decoded by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of a hundred texts so many are cut, and of these so many have their suffix first.
CUT_SHARE, SUFFIX_FIRST_SHARE = 50, 80
FORMS = ("plain", "psm", "spm")
#: For each form, which piece (0 prefix, 1 middle, 2 suffix) comes first, second and third, and what stands before it.
ORDER = np.array([(0, 1, 2), (0, 2, 1), (2, 0, 1)])
MARKS = (("", "", ""), (PREFIX, SUFFIX, MIDDLE), (SUFFIX, PREFIX, MIDDLE))
#: Bytes of text that the kernel takes at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def cut(data: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n, first, second, prefix_chars, middle_chars) of each text: tokens, byte places of both cuts, code points.

    `data` holds the texts' bytes, text i from offsets[i] to offsets[i + 1], offsets[0] being 0. The cuts come after
    the smaller and the greater of a % (n + 1) and b % (n + 1) tokens.
    """
    starts, stops = offsets[:-1], offsets[1:]
    space = SPACE[data]
    ends = np.zeros(len(data), bool)
    np.logical_and(~space[:-1], space[1:], out=ends[:-1])
    ends[stops[stops > starts] - 1] = True
    counted = np.concatenate(([0], np.cumsum(ends)))
    before = counted[starts]
    n = counted[stops] - before
    a, b = a % (n + 1), b % (n + 1)

    def place(c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, np.searchsorted(counted, before + c), starts)

    first, second = place(np.minimum(a, b)), place(np.maximum(a, b))
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return n, first, second, chars[first] - chars[starts], chars[second] - chars[first]


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts without nulls, and where each starts and ends."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with SLICE_BYTES of text or one row, with their bytes and offsets."""
    data, offsets = _bytes(batch.column("text"))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, text, form, a, b), form as a number, to (id, n, form, prefix_chars, middle_chars, output)."""
    marks = [pa.array([m[k] for m in MARKS]) for k in range(3)]
    for batch in batches:
        for rows, data, offsets in _slices(batch):
            numbers = {c: rows.column(c).to_numpy() for c in ("form", "a", "b")}
            n, first, second, prefix, middle = cut(data, offsets, numbers["a"], numbers["b"])
            places = np.column_stack((offsets[:-1], first, second)).ravel()
            pieces = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(np.append(places, offsets[-1])), pa.py_buffer(data))
            form, row = pa.array(numbers["form"]), 3 * np.arange(rows.num_rows)
            parts = [x for k in range(3) for x in (marks[k].take(form).cast(pa.large_string()), pieces.take(pa.array(row + ORDER[numbers["form"], k])))]
            output = pc.binary_join_element_wise(*parts, pa.scalar("", pa.large_string())).cast(pa.string())
            whole = pa.array(numbers["form"] == 0)
            chars = [pc.if_else(whole, pa.scalar(None, pa.int64()), pa.array(x)) for x in (prefix, middle)]
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(n), pa.array(list(FORMS)).take(form), *chars, output], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits, from the digest of the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, cut_share: int = CUT_SHARE, suffix_first_share: int = SUFFIX_FIRST_SHARE) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row, `id` under its own name.

    form: `plain` (the text as it is), `psm` (prefix, suffix, middle) or `spm` (suffix, prefix, middle). What is drawn
    depends on seed and id alone, so rows with equal ids and texts have equal results, and null ids draw as one. Null
    texts count as empty; empty texts, and texts that hold a mark already, stay plain. Long texts are read whole.
    An empty table gives no rows; other columns are not read. No shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    a, b, c, d = _draws(F.col(id_col), seed)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (c % 100 >= cut_share), 0).when(d % 100 < suffix_first_share, 2).otherwise(1)
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), form.alias("form"), a.alias("a"), b.alias("b"))
    return rows.mapInArrow(_arrange, f"id {key}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string").withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Marks stand once each, since texts that hold one stay plain."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)

    def parts(second: str) -> tuple[Column, Column]:
        return F.substr(F.substring_index(head, second, 1), F.lit(len(second) + 1)), F.substring_index(head, second, -1)

    prefix, suffix = parts(SUFFIX)
    last, start = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(start, middle, last)).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, form, cuts and digests of the output and of what is restored from it, for every document."""
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), x AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), f AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j FROM x
), p AS (
  SELECT *, array_to_string(u[1:i], '') AS a, array_to_string(u[i + 1:j], '') AS b, array_to_string(u[j + 1:], '') AS c FROM f
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b WHEN 'spm' THEN '<S>' || c || '<P>' || a || '<M>' || b ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
