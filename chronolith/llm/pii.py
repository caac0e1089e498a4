"""Personal data: pattern spans, and terms that give protected values away.

Base spans (email, ip, card, phone) come from fixed patterns. Beyond them, corpus co-occurrence estimates how
strongly a term reveals a protected value e: with n(e,t) windows where t stands near e, n(t) occurrences of t
in the whole corpus, n(e) occurrences of e and N words in all,

    disclosure(t, e) = log2(n(e,t) * N / (n(t) * n(e))) / log2(N / n(e))

is the share of e's information content that t discloses (1: t occurs beside e only). Terms at or above a
threshold, with enough support, are spans too: at full disclosure the term is removed, else it is generalised.
Every count is taken over all documents. A window is CONTEXT words on either side of a base span. Support counts
windows with different words, so copies of a text are one; within WINDOW words every occurrence counts. MIN_SUPPORT
occurrences within WINDOW words are enough; so are LEAST_WINDOWS windows if chance would not explain them: the bound on
the probability that n(e,t) of n(t) places fall into the windows of e, exp(-n(t) KL(n(e,t)/n(t), share of all words in
those windows)), times the number of pairs tried is at most CHANCE. A term is a span wherever it stands, in documents
without the value too.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import discard, saved, small, table

KINDS = ("email", "ip", "card", "phone")
TERM_KIND = "term"
TERMS = "array<struct<start:int,stop:int,share:double>>"
WINDOW = 4
CONTEXT = 64
MIN_SUPPORT = 5
LEAST_WINDOWS = 2
CHANCE = 0.05
DISCLOSURE = 0.97
REMOVAL = 0.999
#: Fixed: a word of the corpus is a run free of these six bytes, stripped of this punctuation, A-Z lowered.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
PUNCTUATION = ".,;:!?()[]\"'*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(UPPER + LOWER + "0123456789._%+-")
# a match cannot start inside a run of digits that it fails at the head of, so only heads are tried
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0d]+")
_FOLD = str.maketrans(UPPER, LOWER)


def _is_octet(digits: str) -> bool:
    """At most 255, however many zeros lead (a run of thousands of digits is never turned into a number)."""
    rest = digits.lstrip("0")
    return len(rest) < 3 or (len(rest) == 3 and rest <= "255")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @ so that long runs cost no more than their length."""
    free = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind, then start."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(_is_octet(p) for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _near(text: str, spans: list[tuple[int, int, int]], window: int, context: int) -> list[tuple[int, str, bool, int]]:
    """(value's hash, term, whether within `window`, hash of all words within `context`) of the words around each
    span that no span touches, each place once for a value; term '' marks the value itself."""
    out = {}
    taken = _taken(spans)
    for kind, a, b in spans:
        value = _hash(f"{kind}:{text[a:b]}")
        left = []
        end = a
        while len(left) < context and end > 0:  # words before, one at a time from the right
            stop = end
            while stop > 0 and text[stop - 1] in SPACES:
                stop -= 1
            head = stop
            while head > 0 and text[head - 1] not in SPACES:
                head -= 1
            if head == stop:
                break
            left.append((head, stop))
            end = head
        right = []
        for m in _WORD.finditer(text, b):
            right.append(m.span())
            if len(right) == context:
                break
        words = [(x, y, k < window) for side in (left, right) for k, (x, y) in enumerate(side)]
        around = _hash(" ".join(text[x:y] for x, y, _ in words))
        out[value, a, ""] = (value, "", True, around)
        for x, y, close in words:
            word = text[x:y]
            body = word.strip(PUNCTUATION)
            if body:
                x += word.index(body)
                if _free(x, x + len(body), taken) and (close or (value, x, body) not in out):
                    out[value, x, body] = (value, body.translate(_FOLD), close, around)
    return list(out.values())


def _taken(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, greatest end so far) by start."""
    out = []
    for a, b in sorted((a, b) for _, a, b in spans):
        out.append((a, b, max(b, out[-1][2] if out else b)))
    return out


def _free(a: int, b: int, taken: list[tuple[int, int, int]]) -> bool:
    """True if no span of `taken`, which is sorted, touches a..b."""
    k = bisect_left(taken, (b,))
    while k > 0:  # spans of different kinds may overlap
        k -= 1
        if taken[k][1] > a:
            return False
        if taken[k][2] <= a:
            return True
    return True


def _places(text: str, terms: dict[str, float]) -> list[dict]:
    """Every place of the terms in the text that no base span touches."""
    taken = _taken(base_spans(text))
    out = []
    for m in _WORD.finditer(text):
        body = m[0].strip(PUNCTUATION)
        share = terms.get(body.translate(_FOLD)) if body else None
        if share is not None:
            x = m.start() + m[0].index(body)
            if _free(x, x + len(body), taken):
                out.append({"start": x, "stop": x + len(body), "share": share})
    return out


def _scan(docs: DataFrame, id_col: str, text_col: str, window: int, context: int, keep: list[str]) -> DataFrame:
    """One row per document: __id, __th (hash of the text), row (the kept columns, none: absent), __base (spans), __near. Only the text enters Python."""

    @F.pandas_udf("base array<struct<kind:int,start:int,stop:int>>, near array<struct<value:bigint,term:string,close:boolean,around:bigint>>")
    def scan(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            base = [base_spans(t) for t in texts]
            near = [_near(t, s, window, context) if s else [] for t, s in zip(texts, base, strict=True)]
            yield pd.DataFrame({
                "base": [[dict(zip(("kind", "start", "stop"), x, strict=True)) for x in s] for s in base],
                "near": [[dict(zip(("value", "term", "close", "around"), x, strict=True)) for x in s] for s in near],
            })

    text = F.coalesce(F.col(text_col), F.lit(""))
    row = [F.struct(*keep).alias("row")] if keep else []
    source = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__th"), *row, scan(text).alias("s"))
    return saved(source.select("__id", "__th", *(["row"] if keep else []), F.col("s.base").alias("__base"), F.col("s.near").alias("__near")))


def _words(docs: DataFrame, text_col: str) -> DataFrame:
    """(__th, term): every word of every document, with the hash of its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.xxhash64(text).alias("__th"), F.explode(F.split(text, r"[\x20\x09-\x0D]+")).alias("word"))
    return words.select("__th", F.translate(F.btrim("word", F.lit(PUNCTUATION)), UPPER, LOWER).alias("term")).where("term <> ''")


def _revealing(docs: DataFrame, scanned: DataFrame, text_col: str, support: int, disclosure: float, context: int) -> DataFrame:
    """(value, term, share) of the terms that disclose a value."""
    near = scanned.select(F.explode("__near").alias("x")).select("x.*")
    pairs = near.groupBy("value", "term", "around").agg(F.count(F.lit(1)).alias("n"), F.count_if("close").alias("close"))
    pairs = saved(pairs.groupBy("value", "term").agg(F.sum("n").alias("n_et"), F.sum("close").alias("n_close"), F.count(F.lit(1)).alias("windows")))
    values = pairs.where("term = ''").select("value", F.col("n_et").alias("n_e"))
    pairs = pairs.where((F.col("term") != "") & ((F.col("n_close") >= support) | (F.col("windows") >= LEAST_WINDOWS)))
    tried = pairs.count()
    pairs = pairs.join(values, "value")
    counts = _words(docs, text_col).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    counts = saved(counts)
    total = counts.agg(F.sum("n_t").alias("n"))  # one row
    n = (total.first()["n"] or 0) + 1
    joined = pairs.join(counts, "term")
    content = F.log2(F.lit(float(n)) / F.col("n_e"))
    share = F.log2(F.col("n_et") * F.lit(float(n)) / (F.greatest("n_t", "n_et") * F.col("n_e"))) / content
    part = F.col("n_et") / F.greatest("n_t", "n_et")
    chance = F.least(F.lit(0.999999), F.col("n_e") * (2 * context / n))
    outside = F.when(part < 1, (1 - part) * F.ln((1 - part) / (1 - chance))).otherwise(0.0)
    bound = F.ln(F.lit(float(max(tried, 1)))) - F.greatest("n_t", "n_et") * (part * F.ln(part / chance) + outside)
    supported = (F.col("n_close") >= support) | ((part > chance) & (bound <= F.ln(F.lit(CHANCE))))
    return joined.withColumn("share", share).where((content > 0) & (F.col("share") >= disclosure) & supported).select("value", "term", "share")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, window: int = WINDOW, support: int = MIN_SUPPORT, disclosure: float = DISCLOSURE, context: int = CONTEXT) -> DataFrame:
    """One row per input row: __id, row (a struct of the columns in `keep`, if there are any), __base and __terms (arrays of spans, by kind and start).

    A null text counts as empty and has no spans; repeated rows and repeated ids are kept apart; the longest
    texts are scanned whole; an empty table gives no rows; columns that are not kept are not read, and kept ones may
    have any name. Terms never touch a base span.
    """
    scanned = _scan(docs, id_col, text_col, window, context, keep or [])
    flagged = _revealing(docs, scanned, text_col, support, disclosure, context)
    flagged = saved(flagged.groupBy("term").agg(F.max("share").alias("share")))
    if not flagged.limit(1).count():
        return scanned.withColumn("__terms", F.lit(None).cast(TERMS)).drop("__near", "__th")
    terms_bytes = F.octet_length("term") + 48
    hits = _words(docs, text_col).join(small(flagged, terms_bytes), "term").distinct()
    hits = saved(hits.groupBy("__th").agg(F.collect_list(F.struct("term", "share")).alias("hit")))  # a document's own

    def place(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_places(t, {x["term"]: x["share"] for x in hit}) for t, hit in zip(batch["text"], batch["hit"], strict=True)]
            yield pd.DataFrame({"__th": batch["__th"], "__terms": found})

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("__th", F.xxhash64("text"))
    texts = texts.join(small(hits, 64 * F.size("hit") + 64), "__th").groupBy("__th").agg(F.first("text").alias("text"), F.first("hit").alias("hit"))
    terms = saved(texts.mapInPandas(place, f"__th bigint, __terms {TERMS}").where("size(__terms) > 0"))
    discard(hits, flagged)
    return scanned.join(small(terms, 32 * F.size("__terms") + 64), "__th", "left").drop("__near", "__th")


def _joined(spans: str, kind: str) -> str:
    return f"transform({spans}, x -> concat({kind}, ':', x.start, ':', x.stop))"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    kinds = "element_at(array('email', 'ip', 'card', 'phone'), x.kind + 1)"
    base = f"array_join({_joined('__base', kinds)}, ',')"
    return found.select(
        F.col("__id").alias("doc_id"),
        *(F.expr(f"cast(size(filter(__base, x -> x.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.expr(f"sha2({base}, 256)").alias("base_sha256"),
        F.expr(f"array_join(concat({_joined('__base', kinds)}, coalesce({_joined('__terms', repr(TERM_KIND))}, array())), ',')").alias("spans"),
        F.expr("cast(coalesce(size(__terms), 0) as bigint)").alias("n_term"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span of the text replaced: values by [KIND], revealing terms removed or generalised.

    A generalised term becomes [number] if it holds a digit, else [word]. Where values overlap, the first stands for
    both. Null texts stay null, empty ones empty; the longest are cleaned whole; repeated rows and ids stay apart;
    an empty table gives no rows. Only texts with spans enter Python; the other columns never do.
    """
    found = find_personal_data(docs, id_col, text_col, keep=docs.columns)

    @F.pandas_udf("string")
    def clean(series: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, bases, marks in series:
            out = []
            for text, base, terms in zip(texts, bases, marks, strict=True):
                if text is None:
                    out.append(None)
                    continue
                spans = [(x["start"], x["stop"], f"[{KINDS[x['kind']].upper()}]") for x in base]
                for x in terms if terms is not None else ():
                    body = text[x["start"] : x["stop"]]
                    spans.append((x["start"], x["stop"], "" if x["share"] >= REMOVAL else "[number]" if any(c.isdigit() for c in body) else "[word]"))
                at, parts = 0, []
                for a, b, new in sorted(spans):
                    if a >= at:
                        parts += [text[at:a], new]
                    at = max(at, b)
                out.append("".join(parts) + text[at:])
            yield pd.Series(out, dtype=object)

    text = F.col("row")[text_col]
    dirty = F.when((F.size("__base") > 0) | F.col("__terms").isNotNull(), text)
    cleaned = found.withColumn("__clean", F.coalesce(clean(dirty, "__base", "__terms"), text))
    return cleaned.select(*(F.col("__clean").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
