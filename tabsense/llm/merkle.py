"""Merkle manifest of a table: leaves per row, a tree per source, one root over the sources.

The method is a slot pivot.  The children of a parent are spread by conditional
aggregates into ``FANOUT`` columns, one a slot; the digest of the columns in
order is the parent, and the columns without a node's own are its siblings.  A
level is one partially aggregated ``groupBy``; the path from a node to the root
comes down the levels by joins on (tree, parent), so a group never holds more
than ``FANOUT`` rows and a source with a third of all rows is spread over all
tasks.

Digests are lowercase hex SHA-256 everywhere; a digest is hashed as its text.

Odd input: a null in any hashed column is written ``-``; null sources are one
source, the first; within a source null ids come first, and rows with equal ids
are ordered by their leaf.  Rows repeated in full are leaves of their own.  An
empty table gives no rows.  Other columns of the input are not read, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsense.llm.common import cut, stored

FANOUT = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<left:string,right:string>"
_PATH = f"array<{_STEP}>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other; null parts are left out."""
    return F.sha2(F.encode(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), "UTF-8"), 256)


def field(value: Column) -> Column:
    """A value as the leaf hashes it: UTF-8 byte count, colon, value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(F.encode(text, "UTF-8")).cast("string"),
                               F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.encode(F.concat(*[field(v) for v in values]), "UTF-8"), 256)


def in_order(df: DataFrame, tree: str, keys: list[str],
             about: DataFrame | None = None) -> DataFrame:
    """``df`` with ``pos``, gapless from 0 within each ``tree`` by ``keys`` (nulls first).

    ``about`` has a row of other columns for every ``tree``, which are added.

    The rows are dealt by ranges of (tree, keys), numbered where they lie and
    shifted by the counts of the ranges before: no task holds a whole tree.
    Rows equal in all of it are dealt by their place in the input, so a key
    that most rows share is cut as well.
    """
    order = [F.col(c).asc_nulls_first() for c in (tree, *keys, "_at")]
    flat = cut(df.withColumn("_at", F.monotonically_increasing_id())
               .repartitionByRange(*order).sortWithinPartitions(*order)
               .withColumn("_part", F.spark_partition_id())
               .withColumn("_row", F.monotonically_increasing_id()))
    parts = flat.groupBy(tree, "_part").agg(F.min("_row").alias("_first"),
                                            F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(tree).orderBy("_part")
                              .rowsBetween(Window.unboundedPreceding, -1))
    shift = parts.select(F.col(tree).alias("_tree"), F.col("_part").alias("_its"),
                         (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    if about is not None:
        about = about.withColumnRenamed(tree, "_its_tree")
        shift = shift.join(about, F.col("_tree").eqNullSafe(F.col("_its_tree"))).drop("_its_tree")
    # one row per (range, tree in it), so a hot tree is no hot key
    return (flat.join(shift, (F.col("_part") == F.col("_its"))
                      & F.col(tree).eqNullSafe(F.col("_tree")))
            .withColumn("pos", F.col("_row") + F.col("_shift"))
            .drop("_at", "_part", "_row", "_tree", "_its", "_shift"))


def _slots() -> list[Column]:
    return [F.col(f"c{s}") for s in range(FANOUT)]


def _parents(nodes: DataFrame) -> DataFrame:
    """The slot pivot: (tree, up, n, c0..c2) of the parents of nodes (tree, pos, n, node)."""
    slot = F.col("pos") % FANOUT
    return nodes.groupBy("tree", F.floor(F.col("pos") / FANOUT).cast("long").alias("up")).agg(
        F.ceil(F.max("n") / FANOUT).cast("long").alias("n"),
        *[F.max(F.when(slot == s, F.col("node"))).alias(f"c{s}") for s in range(FANOUT)])


def _step(pos: Column) -> Column:
    """The siblings of a node: the slot columns before its own and those after it."""
    slot = pos % FANOUT
    own = [F.when(slot == s, F.struct(
        F.concat(F.lit(""), *[F.coalesce(c, F.lit("")) for c in _slots()[:s]]).alias("left"),
        F.concat(F.lit(""), *[F.coalesce(c, F.lit("")) for c in _slots()[s + 1:]]).alias("right")))
        for s in range(FANOUT)]
    return F.coalesce(*own)


def forest(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(levels of parents from the bottom, the roots (tree, root)) of a forest.

    ``nodes`` has (tree, pos, n, node), ``n`` being the size of the tree.  A
    tree of one node is its own root.  Every level is written, a third of the
    rows of the level before.
    """
    size = nodes.agg(F.max("n")).first()[0] or 0
    levels, at = [], nodes
    roots = nodes.where("n = 1").select("tree", F.col("node").alias("root"))
    while size > 1:
        size = -(-size // FANOUT)
        level = cut(_parents(at.where("n > 1")))
        levels.append(level)
        at = level.select("tree", F.col("up").alias("pos"), "n", digest(*_slots()).alias("node"))
        roots = roots.union(at.where("n = 1").select("tree", F.col("node").alias("root")))
    return levels, roots


def with_paths(levels: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """The lowest parents with ``path`` (siblings from them up to the end of ``tops.path``).

    ``tops`` has (tree, path) and the ``carried`` columns of every tree; a
    tree's last parent starts from them, every level below joins its parent.
    """
    known = None
    for level in reversed(levels):
        begins = level.where("n = 1").join(tops, "tree")
        if known is not None:
            above = known.select("tree", F.col("up").alias("over"), *carried, "path",
                                 *[F.col(f"c{s}") for s in range(FANOUT)])
            below = level.where("n > 1").withColumn("over", F.floor(F.col("up") / FANOUT))
            mine = [F.col(f"c{s}").alias(f"d{s}") for s in range(FANOUT)]
            joined = (below.select("tree", "up", "n", "over", *mine).join(above, ["tree", "over"])
                      .withColumn("path", F.concat(F.array(_step(F.col("up"))), "path")))
            begins = begins.select("tree", "up", "n", *carried, "path",
                                   *_slots()).union(joined.select(
                                       "tree", "up", "n", *carried, "path",
                                       *[F.col(f"d{s}").alias(f"c{s}") for s in range(FANOUT)]))
        known = begins
    return known


def folded(node: Column, path: Column) -> Column:
    """The root that ``node`` and its path of siblings give."""
    return F.aggregate(path, node, lambda acc, s: F.sha2(F.encode(
        F.concat(s["left"], acc, s["right"]), "UTF-8"), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level and left to right."""
    return F.sha2(F.encode(F.array_join(F.transform(
        path, lambda s: F.concat(s["left"], s["right"])), ""), "UTF-8"), 256)


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None,
             id_col: str = "doc_id", source_col: str = "source",
             columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(id, leaf, claimed, subroot, root, path) of every row of ``docs``.

    ``path`` lists the siblings (left, right) from the leaf's level up to the
    root over all sources.  ``claimed`` is the leaf of the row with the
    columns in ``changed`` replaced by the given expressions, to be held
    against the manifest with :func:`folded`.
    """
    q = {c: F.col(f"`{c}`") for c in columns}
    leaves = stored(docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
        leaf(list(q.values())).alias("leaf"),
        leaf([(changed or {}).get(c, q[c]) for c in columns]).alias("claimed")))
    sources = leaves.groupBy("source").agg(F.count("*").alias("n"))
    placed = cut(in_order(sources.withColumn("all", F.lit(0)), "all", ["source"]).select(
        "source", "n", F.col("pos").alias("tree")))
    numbered = cut(in_order(leaves, "source", ["id", "leaf"], placed).select(
        "id", "leaf", "claimed", "tree", "n", "pos"))

    levels, roots = forest(numbered.select("tree", "pos", "n", F.col("leaf").alias("node")))
    subroots = cut(roots.withColumnRenamed("root", "subroot"))
    total = subroots.count()
    upper, top = forest(subroots.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"),
        F.lit(total).cast("long").alias("n"), F.col("subroot").alias("node")))
    found = top.first()
    root = F.lit(found["root"] if found else None).cast("string")
    bare = F.array().cast(_PATH)
    if upper:
        over = with_paths(upper, docs.sparkSession.range(1).select(
            F.col("id").alias("tree"), bare.alias("path")), [])
        tops = (subroots.join(over.drop("tree"), F.floor(F.col("tree") / FANOUT) == F.col("up"))
                .select("tree", "subroot",
                        F.concat(F.array(_step(F.col("tree"))), "path").alias("path")))
    else:
        tops = subroots.select("tree", "subroot", bare.alias("path"))
    tops = cut(tops)
    lone = numbered.where("n = 1").join(tops, "tree").select(
        "id", "leaf", "claimed", "subroot", "path")
    if levels:
        above = with_paths(levels, tops, ["subroot"]).drop("n")
        rest = (numbered.where("n > 1").withColumn("up", F.floor(F.col("pos") / FANOUT))
                .join(above, ["tree", "up"])
                .select("id", "leaf", "claimed", "subroot",
                        F.concat(F.array(_step(F.col("pos"))), "path").alias("path")))
        lone = lone.union(rest)
    return lone.withColumn("root", root)
