"""Fits see all rows: the sampler, long texts, shared footers."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabsense.llm import common, gru_langid, line_crf, ordinal, toxic_grammar

SYLLABLES = {"aa": ["ka", "to", "mi", "ru", "no"], "bb": ["sch", "ein", "ung", "ver", "ich"]}


def words(rnd, lang, n):
    return [("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3)))) for _ in range(n)]


def long_text(rnd, lang, extra=()):
    """A text of more than 28 KB; ``extra`` words stand everywhere in it."""
    out = []
    for _ in range(700):
        line = words(rnd, lang, 9)
        if extra:
            line[rnd.randrange(9)] = rnd.choice(extra)
        out.append(" ".join(line) + rnd.choice([".", "!", ""]))
    return "\n".join(out)


@pytest.fixture(scope="module")
def long_corpus(spark):
    rnd = random.Random(31)
    rows = []
    for i in range(60):
        lang, toxic = "ab"[i % 2] * 2, int(i % 3 == 0)
        rows.append((i, long_text(rnd, lang, ["zorkel", "zorkan"] if toxic else ()), lang, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def test_every_fit_learns_from_a_corpus_of_long_texts(spark, long_corpus):
    assert long_corpus.agg(F.min(F.octet_length("text"))).first()[0] > 28_000
    net = gru_langid.fit(long_corpus)
    right = gru_langid.predict(long_corpus, net, ["doc_id", "lang"]).where("lang = lang_pred").count()
    assert right == 60
    rated = long_corpus.select("doc_id", (1 - F.col("toxic")).alias("quality"))
    assert line_crf.fit(long_corpus, rated) is not None
    grades = long_corpus.select("doc_id", F.when(F.col("toxic") == 1, 0).otherwise(2).alias("grade"))
    model = ordinal.fit(long_corpus, grades)
    e = {r["doc_id"]: r["expected_grade"] for r in ordinal.predict(
        long_corpus, model, ["doc_id"]).collect()}
    assert min(e[i] for i in e if i % 3) > max(e[i] for i in e if i % 3 == 0)
    model = toxic_grammar.fit(long_corpus, long_corpus.select("doc_id", "toxic"))
    s = {r["doc_id"]: r["score"] for r in toxic_grammar.predict(
        long_corpus, model, ["doc_id"]).collect()}
    assert min(s[i] for i in s if i % 3 == 0) > 0.5 > max(s[i] for i in s if i % 3)


def test_a_shared_footer_does_not_silence_training_texts(spark):
    rnd = random.Random(32)
    footer = " ".join(words(rnd, "bb", 15))
    rows = []
    for i in range(300):
        body = words(rnd, "aa", 40)
        if i % 2:
            for _ in range(3):
                body[rnd.randrange(40)] = rnd.choice(["zorkel", "zorkan"])
        rows.append((i, " ".join(body) + ". " + footer, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    drawn = docs.select("text", F.col("toxic").alias("label"), F.col("doc_id").alias("h")).mapInArrow(
        toxic_grammar._sketched, "text string, label int, h long, marks array<long>")
    assert drawn.where("size(marks) = 8").count() == 300
    model = toxic_grammar.fit(docs, docs.select("doc_id", "toxic"))
    out = toxic_grammar.predict(docs, model, ["doc_id", "toxic"])
    assert out.where("(score >= 0.5) = (toxic = 1)").count() == 300


@pytest.mark.parametrize("per_label", [5, 150])
def test_the_sample_is_the_lowest_hashes_of_every_label(spark, per_label):
    docs = spark.range(20_000).select("id", F.when(F.col("id") % 10 < 8, "hot").when(
        F.col("id") % 100 == 9, "rare").otherwise("other").alias("label"))
    keys = docs.union(docs.where("id < 50")).union(
        spark.createDataFrame([(None, "hot"), (7, None)], "id long, label string"))
    got = {(r["sample_label"], r["id"]) for r in common.bounded_sample(
        keys, docs, "id", per_label).collect()}
    nth = F.row_number().over(Window.partitionBy("label").orderBy("h", "id"))
    want = {(r["label"], r["id"]) for r in docs.withColumn(
        "h", F.xxhash64(F.lit("sample"), "id")).withColumn("nth", nth)
        .where(F.col("nth") <= per_label).collect()}
    assert got == want


def test_excerpts_are_whole_short_texts_or_parts_of_the_length_asked_for(spark):
    rows = [(i, t) for i, t in enumerate(["", "é" * 10, "abc" * 50, "x" * 11, None])]
    out = spark.createDataFrame(rows, "id long, text string").select(
        "text", common.excerpt(F.col("text"), F.col("id"), 10).alias("part")).collect()
    for r in out:
        if r["text"] is None:
            assert r["part"] is None
        elif len(r["text"]) <= 10:
            assert r["part"] == r["text"]
        else:
            assert len(r["part"]) == 10 and r["part"] in r["text"]
