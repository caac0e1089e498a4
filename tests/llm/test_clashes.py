"""Columns of any name or type are kept, and a repeated id does not exceed the learners' bounds."""

from pyspark.sql import functions as F

from chronolith.llm import language, simhash, toxicity
from chronolith.llm.common import in_training

NAMES = ("__score", "__p", "__id", "__th", "row", "p", "n", "score", "lang_pred", "doc_id_")


def clashing(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    return rows.select("*", *(F.concat(F.lit(f"{c}:"), F.col("doc_id")).alias(c) for c in NAMES))


def test_keep_civil_keeps_every_column(spark):
    docs = clashing(spark, ["good day", None, "", "you awful xx"])
    lexicon = toxicity.Lexicon({toxicity.fold("awful"): 5.0}, [], (-3.0, 2.0, 0.0, 0.0))
    kept = toxicity.keep_civil(docs, lexicon)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.where("doc_id < 3").collect()))


def test_identify_keeps_every_column(spark):
    docs = clashing(spark, ["the cat", None, "12"])
    model = language.train(["the cat sat", "le chat noir"] * 10, ["en", "fr"] * 10)
    found = language.identify(docs, model)
    own = [c for c in docs.columns if c not in ("score", "lang_pred")]
    assert found.columns == [*own, "lang_pred", "score"] and sorted(map(tuple, found.select(own).collect())) == sorted(map(tuple, docs.select(own).collect()))
    assert {r.doc_id: r.lang_pred for r in found.collect()} == {0: "en", 1: "und", 2: "und"}


def test_keep_first_takes_map_columns(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, {"b": 2}, [{"x": 1}]), (1, text, {"a": 1}, [{"x": 1}]), (2, text, None, None), (3, "other words that are not alike at all here", {}, [])], "doc_id bigint, text string, tags map<string,int>, deep array<map<string,int>>")
    kept = {r.doc_id: r for r in simhash.keep_first(docs).collect()}
    assert set(kept) == {1, 3} and kept[1].tags == {"a": 1} and kept[1].deep == [{"x": 1}] and simhash.keep_first(docs).columns == docs.columns


def repeated(spark, n=20_000):
    """An id that may be learned from in n rows, and a hundred others."""
    ids = spark.range(1, 400).where(in_training(F.col("id"))).limit(101)
    hot = ids.agg(F.min_by("id", F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30)))).first()[0]  # the first that is chosen
    rows = ids.withColumn("times", F.expr(f"IF(id = {hot}, {n}, 1)")).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(1), "times")).alias("i"))
    return rows.select("doc_id", F.expr("concat('some text ', IF(doc_id % 2 = 0, 'awful', 'kind'), ' ', doc_id)").alias("text"), F.lit("en").alias("lang"))


def test_a_repeated_id_stays_within_the_language_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "train_counts", lambda rows, *a, **k: seen.append(len(rows)))
    for n, most in ((20_000, 50), (1, 50), (20_000, 1 << 20)):
        language.fit(repeated(spark, n), rows_per_language=most)
    assert len(seen) == 3 and 20 <= seen[0] <= 90 and 20 <= seen[1] <= 90 and seen[2] == 100 + language.ROWS_PER_ID


def test_a_repeated_id_stays_within_the_toxicity_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "_logistic", lambda x, y: seen.append(len(x)) or (0.0, 0.0, 0.0, 0.0))
    docs = repeated(spark)
    labels = docs.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))
    toxicity.fit(docs, labels)
    toxicity.fit(docs, labels, fit_rows=10)
    assert seen[0] <= 100 + toxicity.ROWS_PER_ID and seen[1] <= 10 * toxicity.ROWS_PER_ID
