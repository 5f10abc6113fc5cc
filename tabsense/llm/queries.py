"""The registered queries of the text operators: thin, over whole tables.

Each takes (spark, sf_dir), calls one operator with production parameters and
derives the columns of its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsense.llm import (decontaminate, gru_langid, line_crf, merkle, mixing, ordinal,
                          prob_minhash, sharding, suffix_dedup, tool_calls, toxic_grammar,
                          winnow, zone_negatives)
from tabsense.llm.common import held_out, table

SHARDS = 40


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of near-equal bytes, equal texts together."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    classes = prob_minhash.near_classes(table(spark, sf_dir, "documents"))
    return classes.select(F.col("id").alias("doc_id"), "class_id", "is_representative")


def op3_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document, learned from four folds of five.

    Grades from the labels: 0 poor quality, 1 good but toxic, 2 good.
    """
    docs = table(spark, sf_dir, "documents").withColumn(
        "held_out", held_out(F.col("doc_id"), 5, 0))
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(
        (F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    ratings = (table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
               .select("doc_id", grade.alias("grade")))
    model = ordinal.fit(docs, ratings)
    rated = ordinal.predict(docs, model, ["doc_id", "held_out"])
    return rated.select("doc_id", "held_out", "expected_grade",
                        F.get("tails", 0).alias("p_good"), F.get("tails", 1).alias("p_best"),
                        (F.get("tails", 0) >= 0.5).alias("selected"))


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and line counts of every document, its content share, and whether it is kept."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return line_crf.judge(docs, line_crf.fit(docs, labels), ["doc_id"])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated so that every source weighs the same, in random order."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "n_copies", "copy", "shuffle_key",
                        F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a ten-word window of a benchmark item."""
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).withColumnRenamed("id", "doc_id")


TOOLS = {"answer": {"prompt": ("string", True), "turn": ("integer", True),
                    "words": ("integer", False), "system": ("string", False)}}


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as calls of tools, linked with what was answered.

    Every user turn is a call; the turn after it, when an assistant's, is its
    result.  What a call depends on and what its arguments look like follows
    from its number of words: some depend on the user turn after them (which
    may depend on them in turn), some on the one before, some of these on the
    first one as well; some arguments miss a field, have one of the wrong type
    or one too many, and some calls name a tool that there is not.
    """
    turns = table(spark, sf_dir, "conversations")

    def call_id(turn):
        return F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))

    turn, words = F.col("turn"), F.size(F.split("text", " ", -1))
    kind, before = words % 6, F.when(turn >= 2, call_id(turn - 2))
    deps = F.when(kind == 0, F.array(call_id(turn + 2))).when(
        kind == 1, F.array(before, F.when(turn > 2, call_id(F.lit(0))))).when(
        kind <= 3, F.array(before)).otherwise(F.array().cast("array<string>"))

    def arguments(count):
        return F.to_json(F.struct(
            turn, F.when(words % 7 != 0, F.col("text")).alias("prompt"), count.alias("words"),
            F.when(words % 11 == 0, F.lit("long")).alias("note")))
    calls = turns.where("role = 'user'").select(
        "conv_id", "turn", call_id(turn).alias("call_id"),
        F.when(words % 13 == 0, "lookup").otherwise("answer").alias("name"),
        F.when(words % 5 == 0, arguments(words.cast("string"))).otherwise(arguments(words))
        .alias("arguments"), F.filter(deps, lambda d: d.isNotNull()).alias("depends_on"))
    results = turns.where("role = 'assistant'").select(
        "conv_id", "turn", call_id(turn - 1).alias("call_id"), F.col("text").alias("content"))
    linked = tool_calls.link(calls, results, TOOLS)
    return linked.withColumn("errors", F.array_join("errors", ","))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a network trained on two folds of three."""
    docs = table(spark, sf_dir, "documents").withColumn(
        "held_out", held_out(F.col("doc_id"), 3, 1))
    net = gru_langid.fit(docs.where("not held_out"))
    return gru_langid.predict(docs, net, ["doc_id", "held_out"])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, learned from four folds of five."""
    docs = table(spark, sf_dir, "documents").withColumn(
        "held_out", held_out(F.col("doc_id"), 5, 0))
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    model = toxic_grammar.fit(docs, labels)
    return toxic_grammar.predict(docs, model, ["doc_id", "held_out"]).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier run, and what is left of its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = winnow.deduplicate_lines(docs, out_col="kept_text")
    return left.select("doc_id", "n_lines", "n_removed",
                       F.octet_length("kept_text").cast("long").alias("kept_bytes"),
                       F.md5(F.col("kept_text").cast("binary")).alias("kept_md5"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle proof of every document, and whether its row still folds to the root.

    Rows whose crc32 is even come back with the line breaks of their text gone.
    """
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    proofs = merkle.manifest(docs, {"text": F.when(even, F.replace(
        "text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    return proofs.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root",
        merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle.folded(F.col("claimed"), F.col("path")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat 100 bytes from earlier, and a digest of the rest."""
    left = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return left.select(F.col("id").alias("doc_id"), "n_bytes", gone.alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op13_zone_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding, under each of its five nearest positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return zone_negatives.mine(table(spark, sf_dir, "embeddings"), label)


QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_prob_minhash, op3_ordinal, op4_line_crf, op5_mixing, op6_decontamination,
    op7_tool_calls, op8_language, op9_toxicity, op10_winnowing, op11_merkle,
    op12_suffix_dedup, op13_zone_negatives)}
