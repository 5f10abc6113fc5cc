"""Sinks (SNK-1..4): CSV export, metrics export, import into a table, report registry.

Writes go to shared storage paths given by the caller; nothing is written
to a machine-local folder.
"""

from __future__ import annotations

import datetime as _dt
import json
import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFound, TabsenseError


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK-1: header row, one part file per partition (no byte-order mark)."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .csv(path))


def export_metrics(metrics: DataFrame, path: str, fmt: str = "parquet",
                   mode: str = "errorifexists") -> None:
    """SNK-2: write the long metrics table (``plans.analyze.metrics_long``)."""
    w = metrics.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise TabsenseError("badExportFormat", format=fmt)


def import_table(spark: SparkSession, df: DataFrame, table: str, mode: str) -> DataFrame:
    """SNK-3: ``create`` (table must not exist) or ``append`` (must exist).

    Returns a one-row DataFrame with the number of rows written.
    """
    if mode not in ("create", "append"):
        raise TabsenseError("badImportMode")
    exists = spark.catalog.tableExists(table)
    if mode == "create" and exists:
        raise TabsenseError("tableExists", table=table)
    if mode == "append" and not exists:
        raise TabsenseError("tableMissingForAppend", table=table)
    seen = Observation()
    (df.observe(seen, F.count(F.lit(1)).alias("rows"))
     .write.mode("errorifexists" if mode == "create" else "append").saveAsTable(table))
    return spark.createDataFrame([(seen.get["rows"],)], "rows long")


class ReportRegistry:
    """SNK-4: report metadata and outputs stored under ``root``.

    ``root/meta`` is a parquet table partitioned by ``report_id``;
    ``root/out/<report_id>/<name>`` holds each output DataFrame.
    """

    META = ("report_id string, title string, template string, language string, "
            "source string, counters string, created_at string")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, report_id: str, meta: dict, outputs: dict[str, DataFrame]) -> None:
        self._check(report_id, *outputs)
        for name, df in outputs.items():
            df.write.mode("overwrite").parquet(f"{self.root}/out/{report_id}/{name}")
        row = (report_id, meta.get("title", ""), meta.get("template", ""),
               meta.get("language", "en"), meta.get("source", ""),
               json.dumps(meta.get("counters", {})),
               meta.get("created_at") or _dt.datetime.now(_dt.timezone.utc).isoformat())
        (self.spark.createDataFrame([row], self.META).write.mode("append")
         .partitionBy("report_id").parquet(f"{self.root}/meta"))

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def list(self) -> DataFrame:
        fs, p = self._fs(f"{self.root}/meta")
        if not fs.exists(p):
            return self.spark.createDataFrame([], self.META)
        # a given schema: ids stay text, and an empty registry has no files to infer from
        return (self.spark.read.schema(self.META).parquet(f"{self.root}/meta")
                .orderBy(F.desc("created_at")))

    @staticmethod
    def _check(*names: str) -> None:
        """Ids and output names become folder names: no separators, no parent folders."""
        for name in names:
            if not re.fullmatch(r"[\w][\w.-]*", name) or ".." in name:
                raise TabsenseError("badReportId", id=name)

    def output(self, report_id: str, name: str) -> DataFrame:
        self._check(report_id, name)
        return self.spark.read.parquet(f"{self.root}/out/{report_id}/{name}")

    def delete(self, report_id: str) -> None:
        self._check(report_id)
        fs, meta = self._fs(f"{self.root}/meta/report_id={report_id}")
        if not fs.exists(meta):
            raise NotFound("reportMissing", report_id=report_id)
        fs.delete(meta, True)
        out_fs, out = self._fs(f"{self.root}/out/{report_id}")
        if out_fs.exists(out):
            out_fs.delete(out, True)
