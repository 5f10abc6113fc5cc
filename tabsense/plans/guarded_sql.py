"""Guarded SQL on Spark (SQL-1..3).

Statements are classified by walking the *unresolved* logical plan that
Spark's own parser returns — nothing is executed to classify, and a write
hidden inside a CTE is still seen.  The default is to deny: a statement is a
read only if every node of its plan is a known query node and every expression
of a known kind, none of them a call by reflection or of a function whose name
is computed (``IDENTIFIER``); whatever is not known is ``ddl``.  A read that
reaches reflection only once views are resolved is stopped before it runs.
Writes and DDL run only with ``confirm_write=True``.

Results are whole unless the caller asks for ``row_limit``: then a plain
SELECT without its own ``LIMIT`` gets the cap as a plan node, so that
``ORDER BY … LIMIT`` becomes a distributed top-k.  Set operations are left
whole.

Uses ``spark._jsparkSession`` (classic mode, not Spark Connect).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..errors import TabsenseError, WriteBlocked
from ..functions import words as W
from ..operators.oplog import StoredLog

READ, WRITE, DDL = "read", "write", "ddl"

# Unresolved-plan node classes that change table contents or files.
WRITE_NODES = {"InsertIntoStatement", "InsertIntoDir", "UpdateTable", "DeleteFromTable",
               "MergeIntoTable", "AppendData", "OverwriteByExpression",
               "OverwritePartitionsDynamic", "ReplaceData", "WriteDelta"}
# All that a query may consist of; any other node makes a statement ddl.
QUERY_NODES = {"Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset",
               "Tail", "Distinct", "Union", "Intersect", "Except", "Join", "LateralJoin",
               "SubqueryAlias", "UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving",
               "UnresolvedInlineTable", "UnresolvedSubqueryColumnAliases", "OneRowRelation",
               "Generate", "Pivot", "Unpivot", "Window", "WithWindowDefinition", "Sample",
               "UnresolvedHint", "Repartition", "RepartitionByExpression", "LocalRelation",
               "RelationTimeTravel", "UnresolvedTableValuedFunction", "PipeOperator",
               "UnresolvedTVFAliases", "UnresolvedTableValuedFunctionAliases"}
# What the parser leaves to be resolved in the expressions of a query; any other
# kind makes a statement ddl.
QUERY_NAMES = {"UnresolvedAttribute", "UnresolvedAlias", "UnresolvedFunction", "UnresolvedStar",
               "UnresolvedStarExceptOrReplace", "UnresolvedStarWithColumns", "UnresolvedRegex",
               "UnresolvedExtractValue", "UnresolvedGenerator", "UnresolvedOrdinal",
               "UnresolvedSubqueryColumnAliases", "UnresolvedWindowExpression",
               "PosParameter", "NamedParameter"}
_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
_SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"}
# Functions that call arbitrary code, and what they are once resolved.
REFLECTIVE = {"java_method", "reflect", "try_reflect"}
REFLECTION_NODES = {"CallMethodViaReflection", "TryReflect"}
# Commands that only read (listing, describing, explaining).
READ_COMMAND_PREFIXES = ("Show", "Describe", "Explain")
LIMIT_ROOTS = {"GlobalLimit", "LocalLimit", "Tail"}
SET_ROOTS = {"Union", "Intersect", "Except"}
_COMMAND = "org.apache.spark.sql.catalyst.plans.logical.Command"


def split_statements(sql: str) -> list[str]:
    """Split on top-level ``;`` (outside quotes and comments); drop empties."""
    out, cur, i, n = [], [], 0, len(sql)
    quote = None
    while i < n:
        ch = sql[i]
        if quote:
            cur.append(ch)
            if ch == "\\" and quote != "`" and i + 1 < n:
                cur.append(sql[i + 1])
                i += 2
                continue
            if ch == quote:
                quote = None
        elif ch in ("'", '"', "`"):
            quote = ch
            cur.append(ch)
        elif sql.startswith("--", i):
            j = sql.find("\n", i)
            i = n if j < 0 else j
            continue
        elif sql.startswith("/*", i):
            j = sql.find("*/", i + 2)
            i = n if j < 0 else j + 2
            continue
        elif ch == ";":
            out.append("".join(cur))
            cur = []
        else:
            cur.append(ch)
        i += 1
    out.append("".join(cur))
    return [s for s in out if s.strip()]


def _parse(spark: SparkSession, sql: str):
    parts = split_statements(sql)
    if len(parts) != 1:
        if not parts:
            raise TabsenseError("sqlParseFailed", detail="empty statement")
        raise TabsenseError("singleStatementOnly")
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(parts[0])
    except Exception as e:  # py4j error carrying ParseException
        raise TabsenseError("sqlParseFailed", detail=str(e).splitlines()[0][:200]) from e


def _children(node) -> list:
    out = []
    for seq in (node.children(), node.innerChildren()):
        it = seq.iterator()
        while it.hasNext():
            child = it.next()
            # inner children may be CTE definitions wrapping a plan
            if hasattr(child, "children"):
                out.append(child)
            else:
                try:
                    out.append(child._2())
                except Exception:  # noqa: BLE001
                    pass
    return out


def _node_class(node) -> str:
    return node.getClass().getSimpleName()


def _items(seq) -> list:
    it, out = seq.iterator(), []
    while it.hasNext():
        out.append(it.next())
    return out


def _function_name(e) -> str | None:
    name = _node_class(e)
    if name == "UnresolvedFunction":
        return str(_items(e.nameParts())[-1]).lower()
    return str(e.name().funcName()).lower() if name == "UnresolvedGenerator" else None


def _only_known(node) -> bool:
    """Whether every expression of a parsed node is of a kind that queries are made of."""
    stack = _items(node.expressions())
    while stack:
        e = stack.pop()
        known = e.getClass().getName().startswith(_EXPRESSIONS) or _node_class(e) in QUERY_NAMES
        if not known or _function_name(e) in REFLECTIVE:
            return False
        stack.extend(_items(e.children()))
    return True


def _reaches_reflection(plan) -> bool:
    """Whether a resolved plan, views and subqueries included, calls by reflection."""
    stack = [plan]
    while stack:
        node = stack.pop()
        exprs = _items(node.expressions())
        while exprs:
            e = exprs.pop()
            name = _node_class(e)
            if name in REFLECTION_NODES:
                return True
            if name in _SUBQUERIES:
                stack.append(e.plan())
            exprs.extend(_items(e.children()))
        stack.extend(_children(node))
    return False


def classify_plan(spark: SparkSession, plan) -> str:
    cmd = spark._jvm.java.lang.Class.forName(_COMMAND)
    stack, worst = [plan], READ
    while stack:
        node = stack.pop()
        name = _node_class(node)
        if name in WRITE_NODES:
            worst = WRITE
        elif cmd.isInstance(node):
            if not name.startswith(READ_COMMAND_PREFIXES):
                return DDL
            if not name.startswith("Explain"):
                continue                       # names of tables and namespaces below
        elif name not in QUERY_NODES and not (name.startswith("Unresolved")
                                              and worst != READ):
            return DDL
        if name not in WRITE_NODES and not _only_known(node):
            return DDL
        stack.extend(_children(node))
    return worst


def classify(spark: SparkSession, sql: str) -> str:
    """SQL-1: ``read`` / ``write`` / ``ddl`` for exactly one statement."""
    return classify_plan(spark, _parse(spark, sql))


def needs_limit(spark: SparkSession, sql: str) -> bool:
    """SQL-2: a read whose root (through ``WITH``) is a SELECT without a limit."""
    plan = _parse(spark, sql)
    if classify_plan(spark, plan) != READ:
        return False
    node = plan
    while _node_class(node) == "UnresolvedWith":
        node = node.child()
    name = _node_class(node)
    if name.startswith(READ_COMMAND_PREFIXES) or name in LIMIT_ROOTS:
        return False
    while _node_class(node) in ("Sort", "Distinct"):
        node = node.child()
    return _node_class(node) not in SET_ROOTS


@dataclass
class GuardedResult:
    sql_class: str
    limited: bool
    df: DataFrame | None
    affected: int | None = None


def _affected(df: DataFrame) -> int | None:
    """Rows a write changed, from the finished command's metrics (None if it reports none)."""
    try:
        metrics = df._jdf.queryExecution().executedPlan().commandPhysicalPlan().metrics()
        found = metrics.get("numOutputRows")
        return int(found.get().value()) if found.isDefined() else None
    except Exception:  # noqa: BLE001  a command without a physical plan has no metrics
        return None


def guarded_sql(spark: SparkSession, sql: str, confirm_write: bool = False,
                row_limit: int | None = None, log: StoredLog | None = None,
                request: str = "", source: str = "editor") -> GuardedResult:
    """SQL-3: classify, block unconfirmed writes, cap a SELECT where asked, keep a record.

    A blocked statement raises ``WriteBlocked``, is not executed and leaves no
    record in ``log``; a statement that fails leaves one that says so.
    """
    sql_class = classify(spark, sql)
    if sql_class != READ and not confirm_write:
        raise WriteBlocked(sql_class, sql)
    text = split_statements(sql)[0]
    entry = {"request": request, "sql": text, "sql_class": sql_class, "source": source}
    try:
        df = spark.sql(text)
    except Exception:
        if log is not None:
            log.record(**entry, success=False)
        raise
    if sql_class != READ:
        out = GuardedResult(sql_class, False, df, _affected(df))
    else:
        if not confirm_write and _reaches_reflection(df._jdf.queryExecution().analyzed()):
            raise WriteBlocked(DDL, sql)
        limited = row_limit is not None and needs_limit(spark, sql)
        out = GuardedResult(READ, limited, df.limit(row_limit) if limited else df)
    if log is not None:
        log.record(**entry, rows=out.affected)
    return out
