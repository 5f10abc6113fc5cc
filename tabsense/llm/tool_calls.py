"""Chat formatting: linking tool calls with their results, as joins only.

Calls and results are hash-joined by (conversation, call id).  Calls are put
into topological order of what they depend on, their arguments are checked
against the schema of the tool they name, and each linked call is written as
one canonical JSON record (keys sorted at every depth, no blanks).

Order: the level of a call is the length of the longest chain of calls it
depends on.  A call that only depends on calls before it (by turn, then id) can
keep its place, so the order of the log is topological unless a dependency points
forward in the log.  The round of a call is the largest number of such
backward dependencies on any path to it; sorted by (round, turn, id) every
call comes after all it depends on, which gives its position.  Levels and rounds
come from the same walk: chains of single dependencies are folded by pointer
doubling (a chain of n calls takes log n joins), and calls with several
dependencies are resolved step by step once all theirs are, with a stored
table each.  Calls on or behind a cycle get no level and no position.
Positions are gapless inside a conversation and counted in blocks of turns, so
that a conversation of any length is spread over tasks.

Rules for odd input: the first result of a call (by turn, then text) counts
and further ones are reported; a result without a call is a row of its own;
of repeated calls with one id the first (by turn, then name and arguments)
counts; dependencies on calls that do not exist are counted and otherwise
ignored.  Calls and results without conversation or id link nothing: each is a row
of its own (noResult or noCall), without position.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsense.llm.common import cut, stored
from tabsense.session import ensure_checkpoint_dir

# Variant type names that satisfy a declared JSON type.
_TYPES = {
    "string": "STRING", "boolean": "BOOLEAN", "integer": "BIGINT",
    "number": "BIGINT|DOUBLE|DECIMAL.*", "object": "OBJECT.*", "array": "ARRAY.*",
    "null": "VOID"}


def calls_of(messages: DataFrame) -> DataFrame:
    """Calls in assistant messages whose text is JSON ``{"tool_calls": [...]}``.

    A call has id, name, arguments (an object) and depends_on (call ids).
    """
    call = ("array<struct<id:string,name:string,arguments:variant,depends_on:array<string>>>")
    found = F.expr("try_variant_get(try_parse_json(text), '$.tool_calls', "
                   f"'{call}')")
    return (messages.where("role = 'assistant'")
            .select("conv_id", "turn", F.explode(found).alias("c"))
            .select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"),
                    F.to_json("c.arguments").alias("arguments"),
                    F.coalesce("c.depends_on", F.array().cast("array<string>"))
                    .alias("depends_on")))


def results_of(messages: DataFrame) -> DataFrame:
    """Results in tool messages whose text is JSON ``{"tool_call_id", "content"}``."""
    parsed = F.from_json("text", "tool_call_id string, content string")
    return (messages.where("role = 'tool'").select("conv_id", "turn", parsed.alias("r"))
            .where("r.tool_call_id is not null or r.content is not null")
            .select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"),
                    F.col("r.content").alias("content")))


def ordered(calls: DataFrame, block_turns: int = 1024) -> DataFrame:
    """(conv_id, call_id, position, dangling, level) of every call.

    ``calls`` has (conv_id, call_id, turn, depends_on).
    """
    key = ["conv_id", "call_id"]
    nodes = calls.select(*key, "turn", F.array_distinct("depends_on").alias("deps"))
    wanted = nodes.select(*key, "turn", F.explode("deps").alias("dep"))
    targets = nodes.select("conv_id", F.col("call_id").alias("dep"),
                           F.col("turn").alias("dep_turn"))
    edges = cut(wanted.join(targets, ["conv_id", "dep"], "left").select(
        *key, "dep", F.col("dep_turn").isNull().alias("dangling"),
        (F.struct("dep_turn", "dep") >= F.struct("turn", "call_id")).cast("long").alias("back")))
    missing = edges.groupBy(*key).agg(F.count_if("dangling").alias("dangling"))
    walked = _levels(nodes.select(*key), edges.where("not dangling"))
    placed = (nodes.join(walked, key, "left").join(missing, key, "left")
              .select(*key, "turn", "level", "round",
                      F.coalesce("dangling", F.lit(0)).alias("dangling")))
    placed = cut(placed.withColumn("block", F.floor(F.col("turn") / block_turns)))
    block = ["conv_id", "round", "block"]
    sizes = placed.where("round is not null").groupBy(*block).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(
        Window.partitionBy("conv_id").orderBy("round", "block")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(*block).orderBy("turn", "call_id"))
    return (placed.join(sizes.select(*block, before.alias("before")), block, "left")
            .select(*key, F.when(F.col("round").isNotNull(), F.col("before") + inside - 1)
                    .alias("position"), "dangling", "level"))


def _levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, round): the longest chain of dependencies behind a call and
    the most backward ones on any; null or left out on or behind a cycle.

    Every round is stored as a table: the planner estimates a join by the product of its
    sides and a checkpoint passes the estimate on, so that its digits would double each round.
    The joins are merged, so that no table is collected into the driver however small its files.
    """
    key = ["conv_id", "call_id"]
    long = lambda n: F.lit(n).cast("long")
    found = edges.groupBy(*key).agg(F.count("*").alias("found"), F.min("dep").alias("dep"),
                                    F.min("back").alias("back"))
    counted = stored(nodes.join(found, key, "left")
                     .select(*key, F.coalesce("found", long(0)).alias("found"), "dep", "back"))
    heads = counted.where("found <> 1").select(*key, "found")
    # doubling: after r rounds the pointers of fewer than 2**r single dependencies stand at
    # their head and are closed; on a chain all lengths occur, so a round that closes none
    # leaves only those on or behind cycles
    jump = counted.where("found = 1").select(
        *key, F.col("dep").alias("up"), long(1).alias("steps"), F.col("back").alias("backs"),
        F.lit(True).alias("open"))
    before, left = None, jump.count()
    while left and left != before:
        far = jump.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"),
                          F.col("steps").alias("more"), F.col("backs").alias("more_backs"),
                          F.col("open").alias("goes_on"))
        moved = jump.where("open").join(far.hint("merge"), ["conv_id", "up"], "left").select(
            *key, F.coalesce("next", "up").alias("up"),
            (F.col("steps") + F.coalesce("more", long(0))).alias("steps"),
            (F.col("backs") + F.coalesce("more_backs", long(0))).alias("backs"),
            F.coalesce("goes_on", F.lit(False)).alias("open"))
        jump = stored(moved.unionByName(jump.where("not open")))
        before, left = left, jump.where("open").count()
    # calls with several dependencies: resolved once all their chains' heads are
    several = heads.where("found > 1")
    ends = jump.select("conv_id", F.col("call_id").alias("dep"), "up", "steps", "backs", "open")
    chains = (edges.join(several.hint("merge"), key)
              .join(ends.hint("merge"), ["conv_id", "dep"], "left").where("open is not true")
              .select(*key, "found", F.coalesce("up", "dep").alias("up"),
                      (F.coalesce("steps", long(0)) + 1).alias("steps"),
                      (F.col("back") + F.coalesce("backs", long(0))).alias("backs")))
    waits = several.select("conv_id", F.col("call_id").alias("up"), F.lit(True).alias("waits"))
    chains = stored(chains.join(waits.hint("merge"), ["conv_id", "up"], "left"))
    waiting = chains.where("waits").drop("waits")
    met = chains.where("waits is null").select(
        *key, "found", long(1).alias("n"), F.col("steps").alias("base"),
        F.col("backs").alias("base_backs"))
    # every chain is joined once, when its head is resolved; counts of the rest are carried
    spark = nodes.sparkSession
    home = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tabsense-{uuid.uuid4().hex}"
    for step in itertools.count():
        part = met.groupBy(*key, "found").agg(
            F.sum("n").alias("n"), F.max("base").alias("base"),
            F.max("base_backs").alias("base_backs"))
        part.write.parquet(f"{home}/step={step}")
        table = spark.read.schema(part.schema)
        part = table.parquet(f"{home}/step={step}")
        fresh = part.where("n = found").select("conv_id", F.col("call_id").alias("up"),
                                               "base", "base_backs")
        if fresh.isEmpty():                      # what is never met depends on a cycle
            break
        met = part.where("n < found").union(
            waiting.join(fresh.hint("merge"), ["conv_id", "up"]).select(
                *key, "found", long(1).alias("n"), (F.col("steps") + F.col("base")).alias("base"),
                (F.col("backs") + F.col("base_backs")).alias("base_backs")))
    known = table.parquet(home).where("n = found").select(
        "conv_id", F.col("call_id").alias("up"), "base", "base_backs").union(
        heads.where("found = 0").select(*key, long(0), long(0)))
    at_head = heads.select(*key, F.col("call_id").alias("up"), long(0).alias("steps"),
                           long(0).alias("backs"))
    return (at_head.unionByName(jump.where("not open").drop("open"))
            .join(known.hint("merge"), ["conv_id", "up"], "left")
            .select(*key, (F.col("steps") + F.col("base")).alias("level"),
                    (F.col("backs") + F.col("base_backs")).alias("round")))


def argument_errors(arguments: Column, name: Column,
                    schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Sorted error codes of a call's JSON arguments against ``{tool: {field: (type, required)}}``.

    ``unknownTool``, ``notAnObject``, ``missing:f``, ``type:f``, ``unknown:f``.
    """
    parsed = F.try_parse_json(arguments)
    fields = F.transform_values(F.try_variant_get(parsed, "$", "map<string,variant>"),
                                lambda k, v: F.schema_of_variant(v))
    none = F.array().cast("array<string>")
    out = F.array(F.lit("unknownTool"))
    for tool, spec in schemas.items():
        checks = [F.when(~F.map_contains_key(fields, F.lit(f)),
                         F.lit(f"missing:{f}") if required else F.lit(None))
                  .when(~F.element_at(fields, F.lit(f)).rlike(f"^({_TYPES[kind]})$"),
                        F.lit(f"type:{f}"))
                  for f, (kind, required) in spec.items()]
        extra = F.transform(
            F.array_except(F.map_keys(fields), F.array(*[F.lit(f) for f in spec])
                           if spec else none),
            lambda k: F.concat(F.lit("unknown:"), k))
        listed = F.concat(F.filter(F.array(*checks).cast("array<string>"),
                                   lambda e: e.isNotNull()) if checks else none, extra)
        out = F.when(name == tool, F.when(fields.isNull(), F.array(F.lit("notAnObject")))
                     .otherwise(F.array_sort(listed))).otherwise(out)
    return out


def _loose_calls(loose: DataFrame, known: DataFrame) -> DataFrame:
    """Calls without conversation or id as they are, with their dangling dependencies."""
    marked = cut(loose.withColumn("uid", F.monotonically_increasing_id()))
    there = known.select("conv_id", F.col("call_id").alias("dep"), F.lit(1).alias("there"))
    missing = (marked.select("uid", "conv_id", F.explode(F.array_distinct("depends_on")).alias("dep"))
               .join(there, ["conv_id", "dep"], "left").groupBy("uid")
               .agg(F.count_if(F.col("there").isNull()).alias("dangling")))
    return (marked.join(missing, "uid", "left").drop("uid", "depends_on")
            .withColumn("called", F.lit(True)))


def link(calls: DataFrame, results: DataFrame,
         schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row per call and per result without a call, with its canonical record.

    ``status`` is linked, noResult or noCall; ``extra_results`` counts the
    results beyond the first.
    """
    key = ["conv_id", "call_id"]
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first_call = (calls.where(keyed).groupBy(*key)
                  .agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c"))
                  .select(*key, F.col("c.turn").alias("turn"), "c.name", "c.arguments",
                          "c.depends_on"))
    first_call = cut(first_call)
    first_result = (results.where(keyed).groupBy(*key)
                    .agg(F.min(F.struct("turn", "content")).alias("r"),
                         (F.count("*") - 1).alias("extra_results")))
    placed = first_call.join(ordered(first_call), key, "left").withColumn("called", F.lit(True))
    joined = (placed.join(first_result, key, "full")
              .unionByName(_loose_calls(calls.where(~keyed), first_call), True)
              .unionByName(results.where(~keyed).select(
                  *key, F.struct("turn", "content").alias("r")), True))
    errors = argument_errors(F.col("arguments"), F.col("name"), schemas)
    called = F.coalesce("called", F.lit(False))
    record = F.to_json(F.struct(
        F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"),
        "name", "position", F.col("r.content").alias("result")))
    return joined.select(
        "conv_id", "call_id", F.coalesce("turn", "r.turn").alias("turn"), "name", "position", "level",
        F.when(called, F.coalesce("dangling", F.lit(0))).alias("dangling"),
        F.when(~called, F.lit("noCall")).when(F.col("r").isNull(), F.lit("noResult"))
        .otherwise(F.lit("linked")).alias("status"),
        F.coalesce("extra_results", F.lit(0)).cast("long").alias("extra_results"),
        F.when(called, errors).alias("errors"),
        F.when(called, record).alias("record"))
