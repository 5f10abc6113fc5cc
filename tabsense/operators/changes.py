"""Keyed table changes as DataFrame plans (CHG-1..4).

Plain parquet tables take no UPDATE/DELETE/MERGE, so a change is applied
by producing the new snapshot: ``base`` joined once with a per-key summary
of the change batch.  The batch is folded per key with ``max_by``
aggregates (partially aggregated map-side), so a key that receives a third
of all changes never lands whole in one task; the join then sees at most
one change row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TabsenseError
from .stats import q

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def check_columns(base: DataFrame, columns: list[str]) -> None:
    """PRJ-2 style validation: non-empty and all known."""
    unknown = sorted(set(columns) - set(base.columns))
    if unknown:
        raise TabsenseError("unknownColumns", columns=", ".join(unknown))
    if not columns:
        raise TabsenseError("emptyValues")


def check_keys(keys: list[str], given: list[str]) -> None:
    if not keys:
        raise TabsenseError("noPrimaryKey")
    if set(given) != set(keys):
        raise TabsenseError("incompletePrimaryKey")


def insert_rows(base: DataFrame, rows: DataFrame) -> DataFrame:
    """CHG-1: append rows of named columns (missing columns null)."""
    check_columns(base, rows.columns)
    cast = rows.select(*[q(c).cast(base.schema[c].dataType).alias(c) for c in rows.columns])
    return base.unionByName(cast, allowMissingColumns=True)


def _is(op: str):
    return F.col("op") == op


def _sets(c: str):
    """Whether a change is an update that sets column ``c``."""
    return _is(UPDATE) & F.coalesce(F.array_contains("set_cols", F.lit(c)), F.lit(False))


def fold_changes(changes: DataFrame, keys: list[str], value_cols: list[str]) -> DataFrame:
    """One row per key summarising an ordered change batch.

    ``changes``: ``seq``, ``op`` (insert/update/delete), the key columns,
    any of ``value_cols`` and ``set_cols`` (array of column names an update
    sets; ignored for insert/delete).  Sequential semantics: the latest
    insert/delete is a reset; an update of column ``c`` counts only when it
    comes after the reset.

    Columns: the keys, ``_reset`` (``seq``, ``op`` and the row ``ins`` of an
    insert) and per column ``_upd_c`` (``seq``, ``val``); null where no change
    of the kind came.  The aggregate sorts its rows, before and after the
    shuffle, so a change is brought to these columns first: one null takes the
    place of what it does not set.
    """
    ins = [F.when(_is(INSERT), F.struct(*[q(c) for c in value_cols])).alias("ins")
           ] if value_cols else []
    reset = F.when(F.col("op").isin(INSERT, DELETE), F.struct("seq", "op", *ins))
    slim = changes.select(
        *[q(k) for k in keys], reset.alias("_reset"),
        *[F.when(_sets(c), F.struct("seq", q(c).alias("val"))).alias(f"_upd_{c}")
          for c in value_cols])
    latest = [F.max_by(q(n), q(n)["seq"]).alias(n)
              for n in ["_reset"] + [f"_upd_{c}" for c in value_cols]]
    return slim.groupBy(*[q(k) for k in keys]).agg(*latest)


def _value(c: str, changes: DataFrame):
    """Value of column ``c`` after the batch (sequential semantics)."""
    reset = F.col("_reset")
    start = F.when(reset["op"] == INSERT, reset["ins"][c] if c in changes.columns
                   else F.lit(None)).otherwise(q(c))
    if c not in changes.columns:
        return start
    upd = q(f"_upd_{c}")
    later = upd["seq"] > F.coalesce(reset["seq"], F.lit(-(2 ** 62)))
    return F.when(later, upd["val"]).otherwise(start)


def _can_meet(base: DataFrame, changes: DataFrame, keys: list[str]):
    """Whether a key of the batch can equal one of ``base``: no null, and a value of its type."""
    ok = F.lit(True)
    for k in keys:
        kind = base.schema[k].dataType
        ok = ok & (q(k).isNotNull() if changes.schema[k].dataType == kind
                   else q(k).try_cast(kind) == q(k))
    return F.coalesce(ok, F.lit(False))


def _new_keys(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that the batch inserts and ``base`` has not, one row each.

    ``base`` is the streamed side of a left-semi join against the inserted
    keys: when they are few (AQE measures them after their aggregate) this is
    a broadcast hash join and the base table is never shuffled.
    """
    ks = [q(k) for k in keys]
    inserted = (changes.where(_is(INSERT) & _can_meet(base, changes, keys))
                .select(*ks).distinct())
    touched = base.select(*ks).join(inserted, keys, "left_semi").distinct()
    return inserted.join(touched, keys, "left_anti")


def apply_changes(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """CHG-4: the snapshot after applying the batch in ``seq`` order.

    An update of a key that does not exist is a no-op; an insert of an
    existing key replaces the row; a delete of a missing key is a no-op.

    Plan: the rows of ``base`` and an empty row for every new key meet the
    folded batch (one row per key) in one left join — base streams past a
    broadcast batch when the batch is small, a shuffled join otherwise, where
    a task sorts its share of the rows and of the batch once.  No full outer
    join, so a small batch never shuffles the base table.  Inserts whose key
    no row of ``base`` can have (a null in it) need no join.
    """
    check_keys(keys, [k for k in keys if k in changes.columns])
    value_cols = [c for c in base.columns if c not in keys]
    given = [c for c in value_cols if c in changes.columns]
    kinds = {c: base.schema[c].dataType for c in base.columns}
    empty = [F.lit(None).cast(kinds[c]).alias(c) for c in value_cols]

    def after(df):
        return df.select(*[(q(c) if c in keys else _value(c, changes)).cast(kinds[c]).alias(c)
                           for c in base.columns])

    fresh = _new_keys(base, changes, keys).select(
        *[q(k).cast(kinds[k]).alias(k) for k in keys], *empty, F.lit(True).alias("_fresh"))
    reset_op = F.col("_reset")["op"]
    stays = F.when(F.col("_fresh"), reset_op == INSERT).otherwise(
        F.coalesce(reset_op != DELETE, F.lit(True)))
    met = (base.withColumn("_fresh", F.lit(False)).unionByName(fresh)
           .join(fold_changes(changes, keys, given), keys, "left").where(stays))
    apart = (fold_changes(changes.where(~_can_meet(base, changes, keys)), keys, given)
             .where(reset_op == INSERT).select("*", *empty))
    return after(met).unionByName(after(apart))


def change_counts(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Affected rows of a batch: ``inserted, updated, deleted``.

    Keys inserted are all keys that end as an insert less those of them that
    ``base`` has.  ``base`` streams past the folded keys, as in
    ``apply_changes``; strings in the aggregates make them sort by key, and
    the join and the aggregate after it go on with that order.
    """
    ks = [q(k) for k in keys]
    sets_any = F.lit(False)
    for c in base.columns:
        if c not in keys and c in changes.columns:
            sets_any = sets_any | _sets(c)
    slim = changes.select(
        *ks, F.when(F.col("op").isin(INSERT, DELETE), F.struct("seq", "op")).alias("_reset"),
        F.when(sets_any, F.col("seq")).alias("_upd"))
    folded = slim.groupBy(*ks).agg(F.max_by("_reset", F.col("_reset")["seq"]).alias("_reset"),
                                   F.max("_upd").alias("_upd"))
    reset = F.col("_reset")
    updated = F.col("_upd") > F.coalesce(reset["seq"], F.lit(-(2 ** 62)))
    folded = folded.select(*ks, F.coalesce(
        reset["op"], F.when(updated, UPDATE), F.lit("")).alias("_end"))
    found = base.select(*ks).join(folded, keys).groupBy(*ks).agg(F.max("_end").alias("_end"))
    end = F.col("_end")

    def n(cond, by=1):
        return F.when(cond, by).otherwise(0)

    parts = folded.select(n(end == INSERT).alias("i"), F.lit(0).alias("u"), F.lit(0).alias("d"))
    parts = parts.unionAll(found.select(n(end == INSERT, -1), n(end.isin(INSERT, UPDATE)),
                                        n(end == DELETE)))
    return parts.agg(F.sum("i").cast("long").alias("inserted"),
                     F.sum("u").cast("long").alias("updated"),
                     F.sum("d").cast("long").alias("deleted"))


def update_rows(base: DataFrame, keys: list[str], updates: DataFrame) -> DataFrame:
    """CHG-2: set the given columns on rows matched by the full key.

    A key given twice has no order to decide by: ``duplicateKeys``.
    """
    check_keys(keys, [k for k in updates.columns if k in keys])
    values = [c for c in updates.columns if c not in keys]
    check_columns(base, values)
    twice = updates.groupBy(*[q(k) for k in keys]).count().where("count > 1")
    if not twice.isEmpty():
        raise TabsenseError("duplicateKeys")
    batch = updates.select(F.lit(0).cast("long").alias("seq"), F.lit(UPDATE).alias("op"),
                           F.array(*[F.lit(c) for c in values]).alias("set_cols"), "*")
    return apply_changes(base, batch, keys)


def delete_rows(base: DataFrame, keys: list[str], deletes: DataFrame) -> DataFrame:
    """CHG-3: drop rows whose full key is listed."""
    check_keys(keys, [k for k in deletes.columns if k in keys])
    return base.join(deletes.select(*[q(k) for k in keys]).distinct(), keys, "left_anti")


def affected(base: DataFrame, keys: list[str], batch: DataFrame) -> DataFrame:
    """Rows of ``base`` matched by the keys of ``batch`` (one row: ``affected``)."""
    return (base.join(batch.select(*[q(k) for k in keys]).distinct(), keys, "left_semi")
            .agg(F.count(F.lit(1)).cast("long").alias("affected")))
