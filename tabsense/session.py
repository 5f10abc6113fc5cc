"""Session helpers: a local session for tests/bench, table loading, lineage cuts.

Library code never assumes session settings (ANSI on or off, time zone,
shuffle partitions): the caller owns the session.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
ALL_TABLES = STAR_TABLES + (
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "tabsense") -> SparkSession:
    """A local session configured like a small cluster (AQE on, UI off)."""
    parts = shuffle_partitions or (int(cores) if str(cores).isdigit() else 8)
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TABSENSE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # plans here are built from many small Column calls; call-site
        # capture for error context costs ~4 JVM round trips per call
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the operator and is read from
    the session; only when nothing is configured (local tests) a scratch
    folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[[^\]]*\])?", str(sc.master)):
            # executors must read each other's checkpoint files: a folder on
            # the driver's disk would break on the first executor loss
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        conf = tempfile.mkdtemp(prefix="tabsense-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there (small results)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def load_tables(spark: SparkSession, sf_dir: str,
                names: tuple[str, ...] | list[str] = ALL_TABLES) -> dict[str, DataFrame]:
    return {n: load_table(spark, sf_dir, n) for n in names}
