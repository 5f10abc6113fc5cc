"""Registered round trips through stored files, under the folder the session names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.oplog import StoredLog
from ..session import ensure_checkpoint_dir, load_table
from ..sources import files, sinks
from .guarded_sql import guarded_sql
from .registry import _LOG_SQL, _log, register


def folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tabsense-{uuid.uuid4().hex}/{name}"


@register("csv_round_trip", """
SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5, length(text) AS chars
FROM documents WHERE text IS NOT NULL AND text <> ''""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1 and SRC-1: documents, line breaks and quotes and all, to CSV and back."""
    docs = load_table(spark, sf_dir, "documents")
    path = folder(spark, "documents.csv")
    sinks.export_csv(docs, path)
    back = files.read_csv(spark, path, docs.schema, clean=False)
    return back.where("text <> ''").select(
        "doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary"))
        .alias("text_md5"), F.length("text").cast("long").alias("chars"))


@register("log_stored", f"""
SELECT id, request, sql, sql_class, source, rows, success,
       favorite OR id = 7 AS favorite
FROM {_LOG_SQL} l WHERE id <> 5
UNION ALL
SELECT max(id) + 1, 'how many', 'SELECT count(*) AS n FROM nation_log', 'read', 'editor',
       CAST(NULL AS BIGINT), true, false FROM {_LOG_SQL} l""")
def log_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOG-1, LOG-4, SQL-3: a log in a folder; one entry deleted, one marked, one run recorded."""
    log = StoredLog(spark, folder(spark, "log"))
    log.append(_log(spark, sf_dir))
    log.delete(5)
    log.favorite(7)
    load_table(spark, sf_dir, "nation").createOrReplaceTempView("nation_log")
    guarded_sql(spark, "SELECT count(*) AS n FROM nation_log", log=log, request="how many")
    return log.read().drop("model", "created_at")
