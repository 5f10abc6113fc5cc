"""Query-log operators (LOG-1..4) over a log table, and a log stored in a folder.

Log columns: ``id, request, sql, sql_class, source, model, rows, success,
created_at, favorite``.  Retention keeps every favourite and the newest
``LOG_MAX_ENTRIES`` others; "newest N" is a distributed top-k
(``orderBy … limit``), never a window over the whole log.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NotFound
from ..functions import words as W
from ..session import cut

LOG_SCHEMA = ("id long, request string, sql string, sql_class string, source string, "
              "model string, rows long, success boolean, created_at string, favorite boolean")


def retain(log: DataFrame, keep: int = W.LOG_MAX_ENTRIES) -> DataFrame:
    """LOG-2: favourites plus the newest ``keep`` non-favourites."""
    marked = F.coalesce(F.col("favorite"), F.lit(False))       # not marked: not a favourite
    fav = log.where(marked)
    recent = log.where(~marked).orderBy(F.desc("id")).limit(keep)
    return fav.unionByName(recent)


def recent(log: DataFrame, limit: int = 50, favorites_only: bool = False) -> DataFrame:
    """LOG-3: newest first, at most ``limit`` entries."""
    src = log.where(F.col("favorite")) if favorites_only else log
    return src.orderBy(F.desc("id")).limit(limit)


def clear(log: DataFrame, keep_favorites: bool = True) -> DataFrame:
    """LOG-4: what remains after clearing (favourites only, or nothing)."""
    return log.where(F.col("favorite")) if keep_favorites else log.limit(0)


def cleared_count(log: DataFrame, keep_favorites: bool = True) -> DataFrame:
    cond = ~F.coalesce(F.col("favorite"), F.lit(False)) if keep_favorites else F.lit(True)
    return log.agg(F.sum(F.when(cond, 1).otherwise(0)).cast("long").alias("deleted"))


def _require(log: DataFrame, entry_id: int) -> None:
    if not log.where(F.col("id") == entry_id).limit(1).count():
        raise NotFound("historyEntryMissing", id=entry_id)


class StoredLog:
    """LOG-1 and LOG-4 on a log in a folder, Parquet partitioned by ranges of ids.

    Appending adds files; deleting an entry or marking it rewrites the one
    partition that holds its id (dynamic partition overwrite), whatever the
    size of the log.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, per_part: int = 1024):
        self.spark, self.path, self.per_part = spark, path.rstrip("/"), per_part
        self._schema = T._parse_datatype_string(LOG_SCHEMA)

    def _folder(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _stored(self) -> DataFrame:
        fs, p = self._folder(self.path)
        wide = T.StructType([*self._schema.fields, T.StructField("part", T.LongType())])
        if not fs.exists(p):
            return self.spark.createDataFrame([], wide)
        return self.spark.read.schema(wide).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop("part")

    def _parted(self, records: DataFrame) -> DataFrame:
        names = [f.name for f in self._schema.fields]
        return records.select(*names).withColumn(
            "part", F.floor(F.col("id") / self.per_part).cast("long"))

    def append(self, records: DataFrame) -> None:
        """Add records that bear ids (columns of ``LOG_SCHEMA``)."""
        self._parted(records).write.mode("append").partitionBy("part").parquet(self.path)

    def record(self, **values) -> int:
        """Add one record, with the next id and the time if none is given; returns the id."""
        last = self._stored().agg(F.max("id")).first()[0]
        row = {"id": 1 if last is None else last + 1, "favorite": False, "success": True,
               "created_at": _dt.datetime.now(_dt.timezone.utc).isoformat(), **values}
        self.append(self.spark.createDataFrame(
            [tuple(row.get(f.name) for f in self._schema.fields)], self._schema))
        return row["id"]

    def _rewrite(self, entry_id: int, change) -> None:
        part = entry_id // self.per_part
        own = self._stored().where(F.col("part") == part).drop("part")
        # read in full before its files are replaced
        left = cut(change(own, entry_id))
        if left.isEmpty():            # no row names a partition to be overwritten
            fs, p = self._folder(f"{self.path}/part={part}")
            fs.delete(p, True)
        else:
            (self._parted(left).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path))

    def delete(self, entry_id: int) -> None:
        """``historyEntryMissing`` when there is none."""
        self._rewrite(entry_id, delete_entry)

    def favorite(self, entry_id: int, marked: bool = True) -> None:
        self._rewrite(entry_id, lambda log, i: set_favorite(log, i, marked))


def delete_entry(log: DataFrame, entry_id: int) -> DataFrame:
    _require(log, entry_id)
    return log.where(~F.col("id").eqNullSafe(entry_id))


def set_favorite(log: DataFrame, entry_id: int, favorite: bool) -> DataFrame:
    _require(log, entry_id)
    return log.withColumn("favorite", F.when(F.col("id") == entry_id, F.lit(favorite))
                          .otherwise(F.col("favorite")))
