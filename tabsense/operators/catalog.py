"""Catalog and relationships (CAT-1..3).

Spark stores no primary or foreign keys, so keys are declared in a small
``TableSpec``/``Edge`` list; row counts and orphan checks are Spark jobs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stats import q


@dataclass(frozen=True)
class Edge:
    """A declared foreign key: ``from_table.from_cols -> to_table.to_cols``."""
    from_table: str
    from_cols: tuple[str, ...]
    to_table: str
    to_cols: tuple[str, ...]


@dataclass
class TableSpec:
    name: str
    primary_keys: list[str] = field(default_factory=list)
    foreign_keys: list[Edge] = field(default_factory=list)


# Declared edges of the driver tables (the parquet files carry none).
DRIVER_EDGES = [
    Edge("nation", ("n_regionkey",), "region", ("r_regionkey",)),
    Edge("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    Edge("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    Edge("orders", ("o_custkey",), "customer", ("c_custkey",)),
    Edge("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    Edge("lineitem", ("l_partkey",), "part", ("p_partkey",)),
    Edge("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
    Edge("labels", ("doc_id",), "documents", ("doc_id",)),
]

DRIVER_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"],
    "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"],
    "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"],
    "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}


def edges_within(edges: list[Edge], selected: list[str]) -> list[Edge]:
    """CAT-2: edges whose both ends are in the selection."""
    chosen = set(selected)
    return [e for e in edges if e.from_table in chosen and e.to_table in chosen]


def inventory(frames: dict[str, DataFrame], keys: dict[str, list[str]] | None = None
              ) -> DataFrame:
    """CAT-1: ``table, n_columns, primary_keys, row_count`` (exact counts)."""
    keys = keys or {}
    out = None
    for name, df in frames.items():
        one = df.agg(F.count(F.lit(1)).cast("long").alias("row_count")).select(
            F.lit(name).alias("table"), F.lit(len(df.columns)).alias("n_columns"),
            F.lit(",".join(keys.get(name, []))).alias("primary_keys"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def column_inventory(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """CAT-1 columns: ``table, ordinal, column, type, nullable`` (schema metadata)."""
    rows = [(t, i, f.name, f.dataType.simpleString(), f.nullable)
            for t, df in frames.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(
        rows, "table string, ordinal int, column string, type string, nullable boolean")


def edge_check(frames: dict[str, DataFrame], edges: list[Edge]) -> DataFrame:
    """CAT-2/3: per declared edge inside the selection — child rows and orphans
    (child rows whose non-null key has no parent row).

    The child is grouped by its key first (one scan; a key holding a third
    of all rows folds map-side), the parent's keys are deduplicated, and the
    two meet in one left join on the key — both sides already hash
    partitioned on it by their aggregates — then one global sum gives both
    counts.
    """
    out = None
    for e in edges_within(edges, list(frames)):
        keys = [f"k{i}" for i in range(len(e.from_cols))]
        child = (frames[e.from_table]
                 .select(*[q(c).alias(k) for k, c in zip(keys, e.from_cols)])
                 .groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
        parent = (frames[e.to_table]
                  .select(*[q(c).alias(k) for k, c in zip(keys, e.to_cols)])
                  .dropna().distinct().withColumn("hit", F.lit(True)))
        key_ok = F.lit(True)
        for k in keys:
            key_ok = key_ok & F.col(k).isNotNull()
        one = (child.join(parent, keys, "left")
               .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("child_rows"),
                    F.coalesce(F.sum(F.when(key_ok & F.col("hit").isNull(), F.col("n"))),
                               F.lit(0)).cast("long").alias("orphans"))
               .select(F.lit(e.from_table).alias("from_table"),
                       F.lit(",".join(e.from_cols)).alias("from_cols"),
                       F.lit(e.to_table).alias("to_table"),
                       F.lit(",".join(e.to_cols)).alias("to_cols"),
                       "child_rows", "orphans"))
        out = one if out is None else out.unionByName(one)
    return out
