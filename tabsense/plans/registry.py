"""Registered queries: name -> (spark callable, oracle SQL).

Each Spark callable takes ``(spark, sf_dir)``, reads the driver tables and
returns a lazy DataFrame.  The matching DuckDB SQL (``oracle.py``) restates
the same semantics independently; column names match one-to-one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import business as B
from ..operators import semantics as S
from ..session import load_table
from . import oracle as O
from .analyze import analyze, metrics_long

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _chosen(spark, sf_dir, table, overrides=None):
    df = load_table(spark, sf_dir, table)
    return df, S.choose(S.semantics(df), overrides)


# ------------------------------------------------------------------ KPIs
@register("kpis_orders", O.kpis("orders", "o_totalprice"))
def kpis_orders(spark, sf_dir):
    df, c = _chosen(spark, sf_dir, "orders")
    return B.kpis(df, c.measure)


@register("kpis_lineitem", O.kpis("lineitem", "l_quantity"))
def kpis_lineitem(spark, sf_dir):
    df, c = _chosen(spark, sf_dir, "lineitem")
    return B.kpis(df, c.measure)


@register("kpis_no_measure", O.kpis("labels", None))
def kpis_no_measure(spark, sf_dir):
    df, c = _chosen(spark, sf_dir, "labels")
    return B.kpis(df, c.measure)


# ----------------------------------------------------------------- trend
@register("trend_orders", O.trend("orders", "o_orderdate", "o_totalprice"))
def trend_orders(spark, sf_dir):
    df, c = _chosen(spark, sf_dir, "orders")
    return B.trend(df, c.date, c.measure)


@register("trend_counts", O.trend("lineitem", "l_shipdate", None))
def trend_counts(spark, sf_dir):
    df = load_table(spark, sf_dir, "lineitem")
    return B.trend(df, "l_shipdate", None)


@register("trend_events_daily", O.trend("events", "ts", "value"))
def trend_events_daily(spark, sf_dir):
    df, c = _chosen(spark, sf_dir, "events")
    return B.trend(df, c.date, c.measure)


@register("trend_trimmed",
          "SELECT idx, label, granularity, value, records, kept FROM ("
          + O.trend_bins("lineitem", "l_shipdate", "l_quantity") + ")")
def trend_trimmed(spark, sf_dir):
    df = load_table(spark, sf_dir, "lineitem")
    return B.trend_bins(df, "l_shipdate", "l_quantity").select(
        F.col("idx").cast("long").alias("idx"), "label", "granularity", "value",
        "records", "kept")


@register("trend_summary", O.trend_summary("orders", "o_orderdate", "o_totalprice"))
def trend_summary(spark, sf_dir):
    df, c = _chosen(spark, sf_dir, "orders")
    return B.trend_summary(df, c.date, c.measure)


# ------------------------------------------------------------ breakdowns
@register("breakdown_sum", O.breakdowns("lineitem", ["l_linestatus", "l_returnflag"],
                                        "l_quantity"))
def breakdown_sum(spark, sf_dir):
    df, c = _chosen(spark, sf_dir, "lineitem")
    return B.breakdowns(df, c.dimensions, c.measure)


@register("breakdown_avg", O.breakdowns("orders", ["o_orderstatus", "o_orderpriority"],
                                        "o_totalprice"))
def breakdown_avg(spark, sf_dir):
    df, c = _chosen(spark, sf_dir, "orders")
    return B.breakdowns(df, c.dimensions, c.measure)


@register("breakdown_count", O.breakdowns("documents", ["lang", "source"], None))
def breakdown_count(spark, sf_dir):
    df = load_table(spark, sf_dir, "documents")
    return B.breakdowns(df, ["lang", "source"], None)


@register("breakdown_others", O.breakdowns("documents", ["source"], "n_chars"))
def breakdown_others(spark, sf_dir):
    df = load_table(spark, sf_dir, "documents")
    return B.breakdown(df, "source", "n_chars")


@register("breakdown_shares",
          "SELECT label, value, value_pct, total FROM ("
          + O.breakdowns("events", ["event_type"], "value") + ")")
def breakdown_shares(spark, sf_dir):
    df, c = _chosen(spark, sf_dir, "events")
    return B.breakdowns(df, c.dimensions, c.measure).select(
        "label", "value", "value_pct", "total")


@register("breakdown_leader", O.breakdown_summary("documents", ["lang", "source"],
                                                  "n_chars"))
def breakdown_leader(spark, sf_dir):
    df = load_table(spark, sf_dir, "documents")
    return B.breakdown_summary(B.breakdowns(df, ["lang", "source"], "n_chars"))


_EVENTS_NO_ERROR = ("(SELECT event_id, ts, user_id, nullif(event_type, 'error') AS event_type,"
                    " value, props FROM events)")


@register("breakdown_coverage", O.breakdown_summary(_EVENTS_NO_ERROR, ["event_type"], "value"))
def breakdown_coverage(spark, sf_dir):
    df = load_table(spark, sf_dir, "events").withColumn(
        "event_type", F.nullif(F.col("event_type"), F.lit("error")))
    return B.breakdown_summary(B.breakdowns(df, ["event_type"], "value"))


_LINEITEM_TWIN = "(SELECT *, l_returnflag AS flag_copy FROM lineitem)"


@register("breakdown_dedup", O.breakdowns(_LINEITEM_TWIN,
                                          ["l_returnflag", "flag_copy", "l_linestatus"],
                                          "l_extendedprice"))
def breakdown_dedup(spark, sf_dir):
    df = load_table(spark, sf_dir, "lineitem").withColumn("flag_copy", F.col("l_returnflag"))
    return B.breakdowns(df, ["l_returnflag", "flag_copy", "l_linestatus"], "l_extendedprice")


@register("breakdown_override", O.breakdowns("orders", ["o_orderpriority"], "o_custkey"))
def breakdown_override(spark, sf_dir):
    df, c = _chosen(spark, sf_dir, "orders",
                    {"measure": "o_custkey", "dimensions": ["o_orderpriority"]})
    return B.breakdowns(df, c.dimensions, c.measure)


# ------------------------------------------------------------ full analysis
def _metrics_sql(source, measure, date_col, dims) -> str:
    bd_label = ("CASE WHEN value_pct IS NULL THEN label "
                "ELSE label || ' (' || CAST(value_pct AS VARCHAR) || '%)' END")
    return f"""
SELECT 0 AS block, seq, key AS metric, coalesce("column", '') AS "column", value,
       '' AS label FROM ({O.kpis(source, measure)})
UNION ALL
SELECT 1, position, 'trend', {O.lit(measure or '')}, value, label
FROM ({O.trend(source, date_col, measure)})
UNION ALL
SELECT 2 + dim_order, rank, "column", coalesce(measure, ''), value, {bd_label}
FROM ({O.breakdowns(source, dims, measure)})"""


@register("analyze_orders", _metrics_sql("orders", "o_totalprice", "o_orderdate",
                                         ["o_orderstatus", "o_orderpriority"]))
def analyze_orders(spark, sf_dir):
    return metrics_long(analyze(load_table(spark, sf_dir, "orders")))


@register("metrics_long", _metrics_sql("lineitem", "l_quantity", "l_shipdate",
                                       ["l_linestatus", "l_returnflag"]))
def metrics_long_lineitem(spark, sf_dir):
    return metrics_long(analyze(load_table(spark, sf_dir, "lineitem")))


# ---------------------------------------------------------------- profile
from ..operators import profile as P  # noqa: E402
from ..operators import stats as ST  # noqa: E402

_DOCS_LABELED = ("(SELECT d.text, d.lang, l.quality, l.toxic FROM documents d "
                 "LEFT JOIN labels l ON d.doc_id = l.doc_id)")


def _docs_labeled(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents")
    lab = load_table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select("text", "lang", "quality", "toxic")


@register("profile_overview", O.overview(_DOCS_LABELED, ["text", "lang", "quality", "toxic"]))
def profile_overview(spark, sf_dir):
    return P.overview(_docs_labeled(spark, sf_dir))


@register("profile_columns", O.profile_columns("orders"))
def profile_columns(spark, sf_dir):
    return P.columns(ST.column_stats(load_table(spark, sf_dir, "orders")))


@register("profile_columns_lineitem", O.profile_columns("lineitem"))
def profile_columns_lineitem(spark, sf_dir):
    return P.columns(ST.column_stats(load_table(spark, sf_dir, "lineitem")))


@register("profile_numeric", O.profile_numeric("lineitem"))
def profile_numeric(spark, sf_dir):
    return P.numeric(load_table(spark, sf_dir, "lineitem"))


@register("profile_outliers", "SELECT \"column\", q1, q3, outliers FROM ("
          + O.profile_numeric("events") + ")")
def profile_outliers(spark, sf_dir):
    return P.numeric(load_table(spark, sf_dir, "events")).select("column", "q1", "q3",
                                                                   "outliers")


@register("profile_outliers_documents", "SELECT \"column\", q1, q3, outliers FROM ("
          + O.profile_numeric("documents") + ")")
def profile_outliers_documents(spark, sf_dir):
    return P.numeric(load_table(spark, sf_dir, "documents")).select("column", "q1", "q3",
                                                                      "outliers")


@register("profile_datetime", O.profile_datetime("orders"))
def profile_datetime(spark, sf_dir):
    return P.datetimes(ST.column_stats(load_table(spark, sf_dir, "orders"), distinct_for=[]))


@register("profile_columns_documents", O.profile_columns("documents"))
def profile_columns_documents(spark, sf_dir):
    return P.columns(ST.column_stats(load_table(spark, sf_dir, "documents")))


@register("profile_top_values_documents", O.top_values("documents"))
def profile_top_values_documents(spark, sf_dir):
    return P.top_values(load_table(spark, sf_dir, "documents"))


@register("profile_top_values", O.top_values("part"))
def profile_top_values(spark, sf_dir):
    return P.top_values(load_table(spark, sf_dir, "part"))


@register("profile_bars", O.top_values("events", bars_only=True))
def profile_bars(spark, sf_dir):
    return P.bars(load_table(spark, sf_dir, "events"))


@register("profile_identifiers", O.profile_identifiers("supplier"))
def profile_identifiers(spark, sf_dir):
    df = load_table(spark, sf_dir, "supplier")
    return P.identifiers(ST.column_stats(df, distinct_for=P.numeric_names(df)))


_LINEITEM_NUMS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax", "price2"]


@register("profile_correlations", O.correlations(
    "(SELECT *, l_extendedprice * 2 + 1 AS price2 FROM lineitem)", _LINEITEM_NUMS))
def profile_correlations(spark, sf_dir):
    df = load_table(spark, sf_dir, "lineitem").withColumn(
        "price2", F.col("l_extendedprice") * 2 + 1)
    return P.correlations(df)


@register("profile_correlations_part", O.correlations(
    "part", ["p_partkey", "p_size", "p_retailprice"]))
def profile_correlations_part(spark, sf_dir):
    return P.correlations(load_table(spark, sf_dir, "part"))


@register("profile_series", O.series("events", "ts", "value"))
def profile_series(spark, sf_dir):
    df = load_table(spark, sf_dir, "events")
    return P.series_auto(df, ST.column_stats(df, distinct_for=P.numeric_names(df)))


@register("profile_series_orders", O.series("orders", "o_orderdate", "o_custkey"))
def profile_series_orders(spark, sf_dir):
    df = load_table(spark, sf_dir, "orders")
    return P.series_auto(df, ST.column_stats(df, distinct_for=P.numeric_names(df)))


@register("profile_histogram", O.histogram("orders", "o_totalprice"))
def profile_histogram(spark, sf_dir):
    return P.histogram(load_table(spark, sf_dir, "orders"), "o_totalprice")


@register("profile_histogram_events", O.histogram("events", "value"))
def profile_histogram_events(spark, sf_dir):
    return P.histogram(load_table(spark, sf_dir, "events"), "value")


_STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


@register("multi_overview", O.multi_overview(_STAR, 7))
def multi_overview(spark, sf_dir):
    from ..operators.catalog import DRIVER_EDGES, edges_within
    frames = {t: load_table(spark, sf_dir, t) for t in _STAR}
    return P.multi_overview(frames, len(edges_within(DRIVER_EDGES, list(frames))))


# --------------------------------------------------------------- semantics
_ROLE_COLS = ["ordinal", "column", "role", "score", "is_identifier", "is_flag", "is_rate",
              "role_rank"]


def _roles(spark, sf_dir, table):
    return S.semantics(load_table(spark, sf_dir, table)).select(
        *_ROLE_COLS[:3], F.col("score").cast("int").alias("score"), *_ROLE_COLS[4:7],
        F.col("role_rank").cast("int").alias("role_rank"))


@register("semantics_measures",
          f"SELECT * FROM ({O.semantics('lineitem')}) WHERE role = 'measure'")
def semantics_measures(spark, sf_dir):
    return _roles(spark, sf_dir, "lineitem").where(F.col("role") == "measure")


@register("semantics_dimensions",
          f"SELECT * FROM ({O.semantics('part')}) WHERE role = 'dimension'")
def semantics_dimensions(spark, sf_dir):
    return _roles(spark, sf_dir, "part").where(F.col("role") == "dimension")


for _t in ("orders", "customer", "supplier", "events", "documents", "labels",
           "conversations", "embeddings"):
    def _make(t):
        return lambda spark, sf_dir: _roles(spark, sf_dir, t)
    register(f"semantics_{_t}", O.semantics(_t))(_make(_t))


# ------------------------------------------------------------- guarded SQL
from . import guarded_sql as G  # noqa: E402
from ..functions import text as T  # noqa: E402
from ..session import ALL_TABLES  # noqa: E402


def register_views(spark, sf_dir):
    for t in ALL_TABLES:
        load_table(spark, sf_dir, t).createOrReplaceTempView(t)


def _pass_through(name: str, spark_sql: str, duck_sql: str | None = None,
                  oracle_limit: bool = False):
    sql = duck_sql or spark_sql
    if oracle_limit:
        sql = f"{sql} LIMIT 500"

    def run(spark, sf_dir):
        register_views(spark, sf_dir)
        return G.guarded_sql(spark, spark_sql, row_limit=500 if oracle_limit else None).df
    register(name, sql)(run)


_pass_through("sql_auto_limit",
              "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey",
              oracle_limit=True)
_pass_through("sql_cte_read", """
WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
SELECT c.c_mktsegment, count(*) AS customers, round(sum(s.total), 2) AS spend
FROM spend s JOIN customer c ON s.o_custkey = c.c_custkey
GROUP BY c.c_mktsegment""")
_pass_through("sql_join_star", """
SELECT r.r_name, count(*) AS lines,
       round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY r.r_name""")
_pass_through("sql_semi_anti", """
SELECT (SELECT count(*) FROM customer c
        WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)) AS with_orders,
       (SELECT count(*) FROM customer c
        WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey))
         AS without_orders,
       (SELECT count(*) FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS unlabeled""")
_pass_through("sql_rollup", """
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
_pass_through("sql_window_rank", """
SELECT * FROM (
  SELECT c_nationkey, c_custkey, c_acctbal,
         CAST(row_number() OVER (PARTITION BY c_nationkey
                                 ORDER BY c_acctbal DESC, c_custkey) AS INT) AS rk
  FROM customer) t
WHERE rk <= 3""")
_pass_through("sql_set_ops", """
(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
EXCEPT (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)""")
_pass_through("sql_set_ops_whole", """
SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer
UNION SELECT l_partkey FROM lineitem""")
_pass_through("sql_top_k", """
SELECT p_partkey, p_name, p_retailprice FROM part
ORDER BY p_retailprice DESC, p_partkey LIMIT 5""")
_pass_through("sql_scalar_mix", """
SELECT event_type, count(*) AS n, CAST(min(year(ts)) AS INT) AS first_year,
       upper(substr(event_type, 1, 3)) AS code, round(avg(length(props)), 2) AS avg_props_len,
       round(max(abs(value)), 2) AS max_abs,
       CAST(sum(CAST(get_json_object(props, '$.k') AS INT)) AS BIGINT) AS k_sum,
       min(date_format(ts, 'yyyy-MM-dd')) AS first_day
FROM events GROUP BY event_type""", """
SELECT event_type, count(*) AS n, CAST(min(year(ts)) AS INT) AS first_year,
       upper(substr(event_type, 1, 3)) AS code, round(avg(length(props)), 2) AS avg_props_len,
       round(max(abs(value)), 2) AS max_abs,
       CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS k_sum,
       min(strftime(ts, '%Y-%m-%d')) AS first_day
FROM events GROUP BY event_type""")


# ------------------------------------------------------------ text queries
_SQL_REPLY = ("concat('Here is the query:\\n```sql\\nSELECT count(*) FROM documents "
              "WHERE lang = ''', role, ''';\\n-- generated\\n\\n```\\n', text)")


def _sql_replies(spark, sf_dir):
    conv = load_table(spark, sf_dir, "conversations")
    return conv.select("conv_id", "turn", F.when(
        F.col("role") == "assistant", F.expr(_SQL_REPLY)).otherwise(F.col("text")).alias("reply"))


_DUCK_WS = "'^\\s+|\\s+$'"
_DUCK_LB = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]'"


def _duck_nl(spark_expr: str) -> str:
    """Spark SQL literals read ``\\n`` as a newline; DuckDB needs ``chr(10)``."""
    return spark_expr.replace("\\n", "' || chr(10) || '")


def _duck_strip(x: str) -> str:
    return f"regexp_replace({x}, {_DUCK_WS}, '', 'g')"


@register("extract_sql", f"""
WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN {_duck_nl(_SQL_REPLY)}
                ELSE text END AS reply FROM conversations),
b AS (SELECT conv_id, turn, reply,
             regexp_extract(reply, '(?is)```(?:sql)?\\s*(.+?)```', 1) AS fenced FROM r)
SELECT conv_id, turn,
       regexp_replace({_duck_strip("array_to_string(list_filter(string_split_regex("
                                   "CASE WHEN fenced = '' THEN reply ELSE fenced END, "
                                   + _DUCK_LB + "), lambda l: " + _duck_strip('l')
                                   + " <> '' AND NOT starts_with(" + _duck_strip('l')
                                   + ", '--')), chr(10))")}, ';+$', '') AS sql
FROM b""")
def extract_sql_query(spark, sf_dir):
    return _sql_replies(spark, sf_dir).select("conv_id", "turn",
                                              T.extract_sql(F.col("reply")).alias("sql"))


_REPORT_REPLY = ("concat('## SUMMARY\\n', text, '\\n## FINDINGS\\n- ', "
                 "replace(text, '\\n', '\\n- '), '\\n## RECOMMENDATIONS\\n- Review [', role, "
                 "'] **now**\\n* check ', CAST(turn AS STRING))")


def _duck_humanize(x: str) -> str:
    return _duck_strip(f"replace(regexp_replace({x}, '\\[([^\\[\\]]{{1,60}})\\]', '\\1', 'g'), "
                       f"'**', '')")


def _duck_section(x: str, name: str) -> str:
    return _duck_strip(f"regexp_extract({x}, '(?is)##\\s*{name}\\s*\\n(.*?)(?:\\n##\\s|$)', 1)")


def _duck_bullets(block: str) -> str:
    trimmed = f"list_transform(string_split_regex({block}, {_DUCK_LB}), lambda l: {_duck_strip('l')})"
    marked = f"list_filter({trimmed}, lambda l: regexp_matches(l, '^[-*•]'))"
    cleaned = (f"list_transform({marked}, lambda l: regexp_replace("
               f"{_duck_strip(chr(114) + 'egexp_replace(l, ' + chr(39) + '^[-*• ]+' + chr(39) + ', ' + chr(39) + chr(39) + ')')}"
               f", '^\\*+|\\*+$', '', 'g'))")
    return f"list_filter({cleaned}, lambda l: l <> '')"


@register("parse_sections", f"""
WITH r AS (SELECT conv_id, turn, {_duck_nl(_REPORT_REPLY).replace('AS STRING', 'AS VARCHAR')} AS reply
           FROM conversations),
p AS (SELECT conv_id, turn, reply,
             {_duck_humanize(_duck_section('reply', 'SUMMARY'))} AS summary,
             list_transform({_duck_bullets(_duck_section('reply', 'FINDINGS'))},
                            lambda f: {_duck_humanize('f')}) AS findings,
             list_transform({_duck_bullets(_duck_section('reply', 'RECOMMENDATIONS'))},
                            lambda f: {_duck_humanize('f')}) AS recs
      FROM r)
SELECT conv_id, turn,
       CASE WHEN summary = '' AND len(findings) = 0 THEN {_duck_humanize('reply')}
            ELSE summary END AS summary,
       CAST(len(findings) AS INTEGER) AS n_findings,
       array_to_string(findings, ' | ') AS findings,
       array_to_string(recs, ' | ') AS recommendations
FROM p""")
def parse_sections_query(spark, sf_dir):
    conv = load_table(spark, sf_dir, "conversations")
    p = T.parse_sections(F.expr(_REPORT_REPLY))
    return conv.select("conv_id", "turn", p.alias("p")).select(
        "conv_id", "turn", F.col("p.summary").alias("summary"),
        F.size("p.findings").alias("n_findings"),
        F.array_join("p.findings", " | ").alias("findings"),
        F.array_join("p.recommendations", " | ").alias("recommendations"))


@register("detect_language", """
SELECT doc_id, lang,
       CAST(length(regexp_replace(text, '[^\\x{0600}-\\x{06FF}]', '', 'g')) AS INTEGER) AS arabic,
       CAST(length(array_to_string(regexp_extract_all(text, '[A-Za-z]{3,}'), '')) AS INTEGER)
         AS latin,
       CASE WHEN length(regexp_replace(text, '[^\\x{0600}-\\x{06FF}]', '', 'g'))
                 > length(array_to_string(regexp_extract_all(text, '[A-Za-z]{3,}'), ''))
            THEN 'ar' ELSE 'en' END AS detected
FROM documents""")
def detect_language_query(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", T.arabic_letters(F.col("text")).alias("arabic"),
                    T.latin_letters(F.col("text")).alias("latin"),
                    T.detect_language(F.col("text")).alias("detected"))


@register("extract_numbers", """
SELECT doc_id, num FROM (
  SELECT doc_id, unnest(list_distinct(list_filter(list_transform(
           regexp_extract_all(text, '[0-9][0-9,]*\\.?[0-9]*'),
           lambda x: regexp_replace(replace(x, ',', ''), '\\.$', '')), lambda x: x <> '')))
         AS num
  FROM documents)""")
def extract_numbers_query(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(T.numbers(F.col("text"))).alias("num"))


# ------------------------------------------------------- ranking tables
from ..operators import ranking as R  # noqa: E402


@register("rank_table", f"""
WITH bd AS ({O.breakdowns('documents', ['source'], 'n_chars')}),
shown AS (SELECT dim_order, count(*) AS shown FROM bd GROUP BY dim_order)
SELECT dim_order, "column", rank, label, value, value_pct AS pct FROM bd
UNION ALL
SELECT bd.dim_order, "column", CAST(NULL AS INTEGER),
       printf('Others (%d %s)', categories - shown,
              CASE WHEN categories - shown = 1 THEN 'category' ELSE 'categories' END),
       others, CASE WHEN total <> 0 THEN round(100 * others / total, 1) END
FROM bd JOIN shown ON bd.dim_order = shown.dim_order
WHERE rank = 1 AND others IS NOT NULL""")
def rank_table(spark, sf_dir):
    df = load_table(spark, sf_dir, "documents")
    return R.rank_table(B.breakdown(df, "source", "n_chars"))


@register("leader_gap", f"""
WITH bd AS ({O.breakdowns('documents', ['lang', 'source'], 'n_chars')}),
two AS (SELECT *, count(*) OVER (PARTITION BY dim_order) AS shown FROM bd)
SELECT dim_order, "column", max(CASE WHEN rank = 1 THEN label END) AS leader,
       max(CASE WHEN rank = 2 THEN label END) AS runner_up,
       round(max(CASE WHEN rank = 1 THEN value END) - max(CASE WHEN rank = 2 THEN value END), 2)
         AS gap,
       max(leader_share_pct) AS share
FROM two WHERE shown >= 2 GROUP BY dim_order, "column\"""")
def leader_gap(spark, sf_dir):
    df = load_table(spark, sf_dir, "documents")
    return R.leader_gap(B.breakdowns(df, ["lang", "source"], "n_chars"))


@register("concentration", f"""
WITH bd AS ({O.breakdowns('documents', ['source', 'lang'], 'n_chars')})
SELECT "column", leader, leader_share_pct AS pct,
       printf('''%s'' holds %s%% of %s', leader, {O.fmt_number('leader_share_pct')},
              {O.humanize('coalesce(measure, "column")')}) AS text,
       coverage_pct < 95 AS partial
FROM bd WHERE rank = 1 AND leader_share_pct >= 50
ORDER BY leader_share_pct DESC, dim_order LIMIT 1""")
def concentration(spark, sf_dir):
    df = load_table(spark, sf_dir, "documents")
    return R.concentration(B.breakdowns(df, ["source", "lang"], "n_chars"))


# --------------------------------------------------------------- catalog
from ..operators import catalog as C  # noqa: E402


@register("table_inventory", "\nUNION ALL\n".join(
    f"SELECT {O.lit(t)} AS \"table\", {len(O.SCHEMA[t])} AS n_columns, "
    f"{O.lit(','.join(C.DRIVER_KEYS[t]))} AS primary_keys, count(*) AS row_count FROM {t}"
    for t in ALL_TABLES))
def table_inventory(spark, sf_dir):
    frames = {t: load_table(spark, sf_dir, t) for t in ALL_TABLES}
    return C.inventory(frames, C.DRIVER_KEYS)


def _edge_sql(edges, selected):
    parts = []
    for e in C.edges_within(edges, selected):
        on = " AND ".join(f"c.{O.ident(a)} = p.{O.ident(b)}"
                          for a, b in zip(e.from_cols, e.to_cols))
        nn = " AND ".join(f"c.{O.ident(a)} IS NOT NULL" for a in e.from_cols)
        parts.append(
            f"SELECT {O.lit(e.from_table)} AS from_table, {O.lit(','.join(e.from_cols))} "
            f"AS from_cols, {O.lit(e.to_table)} AS to_table, {O.lit(','.join(e.to_cols))} "
            f"AS to_cols, (SELECT count(*) FROM {e.from_table}) AS child_rows, "
            f"(SELECT count(*) FROM {e.from_table} c WHERE {nn} AND NOT EXISTS "
            f"(SELECT 1 FROM {e.to_table} p WHERE {on})) AS orphans")
    return "\nUNION ALL\n".join(parts)


_REL_TABLES = list(_STAR) + ["labels", "documents"]


@register("relationships", _edge_sql(C.DRIVER_EDGES, _REL_TABLES))
def relationships(spark, sf_dir):
    frames = {t: load_table(spark, sf_dir, t) for t in _REL_TABLES}
    return C.edge_check(frames, C.DRIVER_EDGES)


_REVERSE = [C.Edge("documents", ("doc_id",), "labels", ("doc_id",)),
            C.Edge("orders", ("o_orderkey",), "lineitem", ("l_orderkey",))]


@register("fk_orphans", _edge_sql(_REVERSE, ["documents", "labels", "orders", "lineitem"]))
def fk_orphans(spark, sf_dir):
    frames = {t: load_table(spark, sf_dir, t) for t in ["documents", "labels", "orders",
                                                         "lineitem"]}
    return C.edge_check(frames, _REVERSE)


# --------------------------------------------------------------- changes
from ..operators import changes as CH  # noqa: E402

_ORDER_COLS = [c for c, _, _ in O.SCHEMA["orders"]]


def _batch(spark, sf_dir):
    """A change batch derived from the tables (attribute rules, no sampling).

    seq 1: urgent orders get status 'F'; seq 2: delete status 'P';
    seq 3: high-priority prices doubled; seq 4: one new order per AUTOMOBILE
    customer (negative keys never collide); seq 5: new orders of nation 0
    customers deleted again (insert then delete).
    """
    o = load_table(spark, sf_dir, "orders")
    c = load_table(spark, sf_dir, "customer")
    nul = {n: F.lit(None).cast(o.schema[n].dataType) for n in _ORDER_COLS}

    def rows(df, seq, op, set_cols, **vals):
        cols = [vals.get(n, F.col(n) if n in df.columns else nul[n]).alias(n)
                for n in _ORDER_COLS]
        return df.select(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"),
                         F.array(*[F.lit(s) for s in set_cols]).cast("array<string>")
                         .alias("set_cols"), *cols)
    new = c.where(F.col("c_mktsegment") == "AUTOMOBILE")
    new_cols = dict(o_orderkey=-(F.col("c_custkey") + 1), o_custkey=F.col("c_custkey"),
                    o_orderstatus=F.lit("O"), o_totalprice=F.col("c_acctbal"),
                    o_orderdate=F.lit("2001-08-01").cast("timestamp_ntz"),
                    o_orderpriority=F.lit("3-MEDIUM"))
    return (rows(o.where(F.col("o_orderpriority") == "1-URGENT"), 1, "update",
                 ["o_orderstatus"], o_orderstatus=F.lit("F"))
            .unionByName(rows(o.where(F.col("o_orderstatus") == "P"), 2, "delete", []))
            .unionByName(rows(o.where(F.col("o_orderpriority") == "2-HIGH"), 3, "update",
                              ["o_totalprice"], o_totalprice=F.col("o_totalprice") * 2))
            .unionByName(rows(new, 4, "insert", [], **new_cols))
            .unionByName(rows(new.where(F.col("c_nationkey") == 0), 5, "delete", [],
                              o_orderkey=-(F.col("c_custkey") + 1))))


_APPLY_SQL = """
WITH base AS (SELECT * FROM orders),
upd AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'),
del AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'),
dbl AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH'),
kept AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderkey IN (SELECT o_orderkey FROM upd) THEN 'F' ELSE o_orderstatus END
           AS o_orderstatus,
         CASE WHEN o_orderkey IN (SELECT o_orderkey FROM dbl) THEN o_totalprice * 2
              ELSE o_totalprice END AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM base WHERE o_orderkey NOT IN (SELECT o_orderkey FROM del)),
ins AS (
  SELECT -(c_custkey + 1) AS o_orderkey, c_custkey AS o_custkey, 'O' AS o_orderstatus,
         c_acctbal AS o_totalprice, TIMESTAMP '2001-08-01 00:00:00' AS o_orderdate,
         '3-MEDIUM' AS o_orderpriority
  FROM customer WHERE c_mktsegment = 'AUTOMOBILE' AND c_nationkey <> 0)
SELECT * FROM kept UNION ALL SELECT * FROM ins"""


@register("apply_changes", _APPLY_SQL)
def apply_changes(spark, sf_dir):
    return CH.apply_changes(load_table(spark, sf_dir, "orders"), _batch(spark, sf_dir),
                            ["o_orderkey"])


@register("apply_change_counts", """
SELECT CAST((SELECT count(*) FROM customer WHERE c_mktsegment = 'AUTOMOBILE'
             AND c_nationkey <> 0) AS BIGINT) AS inserted,
       CAST((SELECT count(*) FROM orders WHERE o_orderstatus <> 'P'
             AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS BIGINT) AS updated,
       CAST((SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS BIGINT) AS deleted""")
def apply_change_counts(spark, sf_dir):
    return CH.change_counts(load_table(spark, sf_dir, "orders"), _batch(spark, sf_dir),
                            ["o_orderkey"])


@register("apply_inserts", """
SELECT * FROM orders UNION ALL
SELECT -(c_custkey + 1), c_custkey, 'O', c_acctbal, CAST(NULL AS TIMESTAMP), '3-MEDIUM'
FROM customer WHERE c_mktsegment = 'AUTOMOBILE'""")
def apply_inserts(spark, sf_dir):
    c = load_table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "AUTOMOBILE")
    rows = c.select((-(F.col("c_custkey") + 1)).alias("o_orderkey"),
                    F.col("c_custkey").alias("o_custkey"), F.lit("O").alias("o_orderstatus"),
                    F.col("c_acctbal").alias("o_totalprice"),
                    F.lit("3-MEDIUM").alias("o_orderpriority"))
    return CH.insert_rows(load_table(spark, sf_dir, "orders"), rows)


@register("apply_updates", """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 100
            ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority
FROM orders""")
def apply_updates(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders")
    upd = o.where(F.col("o_orderpriority") == "1-URGENT").select(
        "o_orderkey", F.lit("F").alias("o_orderstatus"),
        (F.col("o_totalprice") + 100).alias("o_totalprice"))
    return CH.update_rows(o, ["o_orderkey"], upd)


@register("apply_deletes", """
SELECT * FROM orders o WHERE NOT EXISTS (
  SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING')""")
def apply_deletes(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders")
    c = load_table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    gone = o.join(c.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    return CH.delete_rows(o, ["o_orderkey"], gone.select("o_orderkey"))


@register("apply_affected", """
SELECT CAST(count(*) AS BIGINT) AS affected FROM orders WHERE o_orderpriority = '1-URGENT'""")
def apply_affected(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders")
    return CH.affected(o, ["o_orderkey"], o.where(F.col("o_orderpriority") == "1-URGENT"))


# ------------------------------------------------------------- query log
from ..operators import oplog as LG  # noqa: E402

_LOG_SQL = """(SELECT event_id AS id, event_type AS request, props AS sql,
  'read' AS sql_class, 'editor' AS source, CAST(NULL AS VARCHAR) AS model,
  user_id AS rows, true AS success, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at,
  event_type = 'purchase' AS favorite FROM events)"""


def _log(spark, sf_dir):
    e = load_table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("request"),
                    F.col("props").alias("sql"), F.lit("read").alias("sql_class"),
                    F.lit("editor").alias("source"), F.lit(None).cast("string").alias("model"),
                    F.col("user_id").alias("rows"), F.lit(True).alias("success"),
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
                    (F.col("event_type") == "purchase").alias("favorite"))


@register("log_retention", f"""
SELECT * FROM {_LOG_SQL} l WHERE favorite
UNION ALL
SELECT * FROM (SELECT * FROM {_LOG_SQL} l WHERE NOT favorite ORDER BY id DESC LIMIT 500)""")
def log_retention(spark, sf_dir):
    return LG.retain(_log(spark, sf_dir))


@register("log_recent", f"""
SELECT * FROM {_LOG_SQL} l WHERE favorite ORDER BY id DESC LIMIT 50""")
def log_recent(spark, sf_dir):
    return LG.recent(_log(spark, sf_dir), 50, favorites_only=True)


@register("log_clear", f"""
SELECT CAST(count(*) FILTER (WHERE NOT favorite) AS BIGINT) AS deleted FROM {_LOG_SQL} l""")
def log_clear(spark, sf_dir):
    return LG.cleared_count(_log(spark, sf_dir))


# ------------------------------------------------------ labels and formats
from ..functions import labels as L  # noqa: E402


def _names_sql():
    rows = []
    for t in ALL_TABLES:
        rows.append(f"SELECT {O.lit(t)} AS \"table\", -1 AS ordinal, {O.lit(t)} AS name")
        for i, (c, _, _) in enumerate(O.SCHEMA[t]):
            rows.append(f"SELECT {O.lit(t)}, {i}, {O.lit(c)}")
    extra = ["total_amount", "customer_id", "unitPrice", "order-date", "is_active",
             "shipping address", "رقم المرجع", "created_at", "first_name", "order_items_id"]
    for i, c in enumerate(extra):
        rows.append(f"SELECT 'examples', {i}, {O.lit(c)}")
    return " UNION ALL ".join(rows)


def _names(spark, sf_dir):
    """Column and table names of the driver tables (read from their schemas)
    plus naming-style examples."""
    frames = {t: load_table(spark, sf_dir, t) for t in ALL_TABLES}
    inv = C.column_inventory(spark, frames).select(
        "table", "ordinal", F.col("column").alias("name"))
    tables = spark.createDataFrame([(t, -1, t) for t in ALL_TABLES],
                                   "table string, ordinal int, name string")
    extra = ["total_amount", "customer_id", "unitPrice", "order-date", "is_active",
             "shipping address", "رقم المرجع", "created_at", "first_name", "order_items_id"]
    ex = spark.createDataFrame([("examples", i, c) for i, c in enumerate(extra)],
                               "table string, ordinal int, name string")
    return tables.unionByName(inv).unionByName(ex)


@register("column_labels", f"""
SELECT "table", ordinal, name, {O.humanize('name', 'en')} AS label_en,
       {O.humanize('name', 'ar')} AS label_ar
FROM ({_names_sql()})""")
def column_labels(spark, sf_dir):
    n = _names(spark, sf_dir)
    return n.select("table", "ordinal", "name", L.humanize(F.col("name"), "en").alias("label_en"),
                    L.humanize(F.col("name"), "ar").alias("label_ar"))


# Names as a key-value feed spells them, made of what the rows hold.
_FEED = ["event_type || '_id'", "'total_' || event_type || 'Amount'", "'user-' || event_type",
         "'customer_' || key", "'order' || upper(substr(event_type, 1, 1)) || 'Date'"]
_FEED_SQL = " UNION ALL ".join(
    f"SELECT {e} AS name, value FROM (SELECT *, json_keys(props)[1] AS key FROM events)"
    for e in _FEED)


@register("row_labels", f"""
WITH feed AS ({_FEED_SQL}),
given AS (
  SELECT event_type || '_id' AS name,
         CASE WHEN count(*) % 2 = 0 THEN ' All ' || event_type ELSE '  ' END AS label
  FROM events GROUP BY event_type),
once AS (
  SELECT f.name, count(*) AS rows, max(f.value) AS highest, nullif(trim(max(g.label)), '') AS own
  FROM feed f LEFT JOIN given g ON f.name = g.name GROUP BY f.name)
SELECT name, rows, highest, coalesce(own, {O.humanize('name', 'en')}) AS label_en,
       coalesce(own, {O.humanize('name', 'ar')}) AS label_ar, own IS NOT NULL AS overridden
FROM once""")
def row_labels(spark, sf_dir):
    """LBL-1..3 over names that the rows of a feed bear, user labels joined."""
    from ..operators.labelling import labelled
    events = load_table(spark, sf_dir, "events").withColumn(
        "key", F.get(F.json_object_keys("props"), F.lit(0)))
    feed = events.select("value", F.explode(F.array(*[F.expr(e) for e in _FEED])).alias("name"))
    given = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat("event_type", F.lit("_id")).alias("name"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit(" All "), "event_type"))
        .otherwise("  ").alias("label"))
    return labelled(feed, "name", given, others=[F.count(F.lit(1)).alias("rows"),
                                                 F.max("value").alias("highest")])


@register("format_numbers", f"""
SELECT o_orderkey, {O.fmt_number('o_totalprice')} AS plain,
       {O.fmt_compact('o_totalprice * 1000')} AS compact_k,
       {O.fmt_compact('o_totalprice * 10')} AS compact,
       {O.fmt_number('o_totalprice / 1000')} AS small
FROM orders""")
def format_numbers(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", L.fmt_number(F.col("o_totalprice")).alias("plain"),
                    L.fmt_compact(F.col("o_totalprice") * 1000).alias("compact_k"),
                    L.fmt_compact(F.col("o_totalprice") * 10).alias("compact"),
                    L.fmt_number(F.col("o_totalprice") / 1000).alias("small"))


_TITLE = "concat('- ', regexp_extract(url, '://([^./]+)', 1), ' (', CAST(length(url) AS {t}), ').CSV')"
_TITLE2 = "concat(regexp_extract(url, '://([^./]+)', 1), '.xlsx-', CAST(page_id AS {t}))"


@register("clean_titles", f"""
SELECT page_id, {O.clean_title(_TITLE.format(t='VARCHAR'))} AS title,
       {O.clean_title(_TITLE2.format(t='VARCHAR'))} AS title2,
       {O.clean_title("'  (2).json'", "'report'")} AS empty_title
FROM pages""")
def clean_titles(spark, sf_dir):
    p = load_table(spark, sf_dir, "pages")
    return p.select("page_id", L.clean_title(F.expr(_TITLE.format(t="STRING"))).alias("title"),
                    L.clean_title(F.expr(_TITLE2.format(t="STRING"))).alias("title2"),
                    L.clean_title(F.lit("  (2).json")).alias("empty_title"))


# ------------------------------------------- facts, narrative, grounding
from . import facts as FA  # noqa: E402


def _facts_sql(source, measure, date_col, dims, integral, table=None):
    prefix = f"[{table}] " if table else ""
    p = O.lit(prefix)
    kp = O.kpis(source, measure)
    int_m = "true" if integral else "false"
    val = O.py_number("value", f"(key = 'records' OR (key <> 'average' AND {int_m}))")
    name = (f"CASE WHEN key = 'records' THEN 'records' WHEN key = 'total' THEN "
            f"'total of ' || coalesce(\"column\", '') WHEN key = 'average' THEN 'average of ' "
            f"|| coalesce(\"column\", '') ELSE 'highest of ' || coalesce(\"column\", '') END")
    parts = [f"SELECT seq, {p} || {name} || ' = ' || {val} AS text FROM ({kp})"]
    int_t = "true" if (integral or measure is None) else "false"
    if date_col:
        ts = O.trend_summary(source, date_col, measure)
        parts += [
            f"SELECT 10, {p} || 'period from ' || period_start || ' to ' || period_end FROM ({ts})",
            f"SELECT 11, {p} || 'first value = ' || {O.num_text('first', int_t)} || ', last = ' "
            f"|| {O.num_text('last', int_t)} || CASE WHEN change_pct IS NOT NULL THEN "
            f"', change = ' || {O.py_number('change_pct')} || '%' ELSE '' END FROM ({ts})",
            f"SELECT 12, {p} || 'peak at ' || peak_label || ' = ' || "
            f"{O.num_text('peak_value', int_t)} FROM ({ts})"]
    if dims:
        bd = O.breakdowns(source, dims, measure)
        int_b = f"(kind = 'count' OR (kind = 'sum' AND {int_m}))"
        parts += [
            f"SELECT 20 + 2 * dim_order, {p} || 'by ' || \"column\" || ': ' || categories || "
            f"' categories, top is ''' || leader || ''' = ' || {O.num_text('leader_value', int_b)}"
            f" || CASE WHEN leader_share_pct IS NOT NULL THEN ' (' || "
            f"{O.py_number('leader_share_pct')} || '% of total)' ELSE '' END || CASE WHEN "
            f"coverage_pct >= 95 THEN '' ELSE ' (computed on the ' || "
            f"{O.py_number('coverage_pct')} || '% of rows that have a value)' END "
            f"FROM ({bd}) WHERE rank = 1",
            f"SELECT 21 + 2 * dim_order, {p} || 'top ' || \"column\" || ' values: ' || "
            f"string_agg(label || '=' || {O.num_text('value', int_b)}, ', ' ORDER BY rank) "
            f"FROM ({bd}) WHERE rank <= 5 GROUP BY dim_order, \"column\" "
            f"HAVING max(categories) > 2"]
    return (f"SELECT CAST(row_number() OVER (ORDER BY seq) AS INTEGER) AS seq, text FROM ("
            + " UNION ALL ".join(parts) + ")")


def _analysis(spark, sf_dir, table, overrides=None):
    df = load_table(spark, sf_dir, table)
    return df, analyze(df, overrides)


@register("facts_list", _facts_sql("orders", "o_totalprice", "o_orderdate",
                                   ["o_orderstatus", "o_orderpriority"], False, "orders"))
def facts_list(spark, sf_dir):
    df, a = _analysis(spark, sf_dir, "orders")
    return FA.facts(a, df.schema, table="orders")


@register("facts_documents", _facts_sql("documents", "n_chars", None, ["lang", "source"], True))
def facts_documents(spark, sf_dir):
    df, a = _analysis(spark, sf_dir, "documents")
    return FA.facts(a, df.schema)


@register("facts_lineitem", _facts_sql("lineitem", "l_quantity", "l_shipdate",
                                       ["l_linestatus", "l_returnflag"], False))
def facts_lineitem(spark, sf_dir):
    df, a = _analysis(spark, sf_dir, "lineitem")
    return FA.facts(a, df.schema)


def _told(t: str, **parts: str) -> str:
    """A sentence template as a SQL concatenation."""
    out, rest = [], t
    while "{" in rest:
        pre, tail = rest.split("{", 1)
        key, rest = tail.split("}", 1)
        out += [O.lit(pre)] * bool(pre) + [f"({parts[key]})"]
    return " || ".join(out + [O.lit(rest)] * bool(rest))


def _narrative_sql(source, measure, phrase, date_col, dims, subject, language):
    """(section, seq, text) of the narrative, from the KPI, trend and breakdown SQL."""
    t = FA.NARRATIVE_WORDS[language]
    n, kp = O.fmt_number, O.kpis(source, measure)
    k = f"""(SELECT max(value) FILTER (key = 'records') AS records,
      max(value) FILTER (key = 'total') AS total, max(value) FILTER (key = 'average') AS average,
      max(value) FILTER (key = 'highest') AS highest FROM ({kp}))"""
    m_or = O.lit(measure or t["of"])
    total = _told(t["total"], measure=O.lit(phrase), total=n("total"), average=n("average"),
                  highest=n("highest"))
    finds, recs = [], []
    bits = []
    if measure:
        finds.append(f"SELECT 0 AS o, {total} AS text FROM {k} WHERE total IS NOT NULL")
        bits.append(f"SELECT 0 AS o, {total} AS text FROM {k} WHERE total IS NOT NULL")
    if date_col:
        ts = f"({O.trend_summary(source, date_col, measure)})"
        steady = "(change_pct IS NULL OR abs(change_pct) < 1)"
        moved = {w: _told(t[w], measure=m_or, first=n("first"), last=n("last"),
                          pct=n("abs(change_pct)")) for w in ("rose", "fell")}
        finds += [f"SELECT 1, CASE WHEN {steady} THEN "
                  f"{_told(t['steady'], measure=m_or, last=n('last'))} WHEN change_pct > 0 THEN "
                  f"{moved['rose']} ELSE {moved['fell']} END FROM {ts}",
                  f"SELECT 2, {_told(t['peak'], label='peak_label', value=n('peak_value'))} "
                  f"FROM {ts}"]
        recs.append(f"SELECT 1 AS o, {_told(t['recTrend'], measure=m_or, pct=n('abs(change_pct)'))}"
                    f" AS text FROM {ts} WHERE NOT {steady}")
        bits.append(f"SELECT 1, {_told(t['period'], start='period_start', end='period_end')} "
                    f"FROM {ts}")
    if dims:
        bd = (f"(SELECT *, row_number() OVER (ORDER BY dim_order) AS pos FROM "
              f"({O.breakdowns(source, dims, measure)}) WHERE rank = 1)")
        scope = (f"CASE WHEN coverage_pct >= 95 THEN '' ELSE "
                 f"{_told(t['scopeNote'], pct=n('coverage_pct'))} END")
        lead = (f"CASE WHEN leader_share_pct IS NULL THEN "
                + _told(t["leaderNoPct"], leader="leader", dim='"column"',
                        value=n("leader_value")) + " ELSE "
                + _told(t["leader"], leader="leader", dim='"column"', value=n("leader_value"),
                        pct=n("leader_share_pct"), scope=scope) + " END")
        plural = ("CASE WHEN categories BETWEEN 3 AND 10 THEN 'فئات' ELSE 'فئة' END"
                  if language == "ar" else
                  "CASE WHEN categories = 1 THEN 'category' ELSE 'categories' END")
        finds += [f"SELECT 10 + 2 * pos, {lead} FROM {bd} WHERE pos <= 2",
                  f"SELECT 11 + 2 * pos, "
                  + _told(t["spread"], count="categories", dim='"column"', plural=plural)
                  + f" FROM {bd} WHERE pos <= 2 AND categories > 3"]
        if measure:
            recs.append("SELECT 10 + pos AS o, " + _told(
                t["recConcentration"], pct=n("leader_share_pct"), measure=O.lit(measure),
                leader="leader") + f" AS text FROM {bd} WHERE pos <= 2 AND leader_share_pct >= 50")
    covers = _told(t["covers"], records=n("records"), subject=O.lit(subject or t["of"]))
    tail = ([f"SELECT 900 AS o, {O.lit(_told_plain(t['recMonitor'], measure=measure))} AS text"]
            if measure else [])
    none = "SELECT 0 AS o, '' AS text WHERE false"
    return f"""
WITH f AS ({' UNION ALL '.join(finds) or none}),
r AS ({' UNION ALL '.join(recs) or none}),
r2 AS (SELECT * FROM r UNION ALL
       SELECT 800, {O.lit(t['recDetail'])} WHERE (SELECT count(*) FROM r) = 0
       {' UNION ALL ' + tail[0] if tail else ''}),
b AS ({' UNION ALL '.join(bits) or none})
SELECT 'summary' AS section, 1::INTEGER AS seq,
       concat_ws(' ', (SELECT {covers} FROM {k}), (SELECT string_agg(text, ' ' ORDER BY o) FROM b))
         AS text
UNION ALL SELECT 'findings', row_number() OVER (ORDER BY o)::INTEGER, text FROM f
  QUALIFY row_number() OVER (ORDER BY o) <= 8
UNION ALL SELECT 'recommendations', row_number() OVER (ORDER BY o)::INTEGER, text FROM r2
  QUALIFY row_number() OVER (ORDER BY o) <= 4"""


def _told_plain(t: str, **parts) -> str:
    return t.format(**parts)


_ORDERS_STORY = ("orders", "o_totalprice", "o_totalprice", "o_orderdate",
                 ["o_orderstatus", "o_orderpriority"], "orders", "en")


@register("narrative_findings", _narrative_sql(*_ORDERS_STORY))
def narrative_findings(spark, sf_dir):
    df, a = _analysis(spark, sf_dir, "orders")
    return FA.narrative(a, subject="orders")


@register("narrative_events", _narrative_sql("events", "value", "value", "ts", ["event_type"],
                                             "events", "ar"))
def narrative_events(spark, sf_dir):
    df, a = _analysis(spark, sf_dir, "events")
    return FA.narrative(a, subject="events", language="ar")


def _grounding_sql(kind: str) -> str:
    facts = _facts_sql("documents", "n_chars", None, ["lang", "source"], True)
    return f"""
WITH f AS (SELECT DISTINCT unnest({O.numbers('text')}) AS token FROM ({facts})),
fv AS (SELECT token, TRY_CAST(token AS DOUBLE) AS v FROM f),
said AS (SELECT doc_id, token, TRY_CAST(token AS DOUBLE) AS v
         FROM (SELECT doc_id, unnest({O.numbers('text')}) AS token FROM documents)),
bad AS (
  SELECT doc_id, token FROM said s
  WHERE v IS NOT NULL AND v > 12
    AND NOT EXISTS (SELECT 1 FROM fv WHERE fv.token = s.token)
    AND NOT EXISTS (SELECT 1 FROM fv WHERE abs(s.v - fv.v) <= greatest(1.0, abs(fv.v) * 0.01)))
""" + ("SELECT doc_id, token FROM bad" if kind == "bad" else
       "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM bad)")


@register("ungrounded_numbers", _grounding_sql("bad"))
def ungrounded_numbers(spark, sf_dir):
    df, a = _analysis(spark, sf_dir, "documents")
    return FA.ungrounded(df.select("doc_id", "text"), FA.facts(a, df.schema), ["doc_id"])


@register("grounded_claims", _grounding_sql("kept"))
def grounded_claims(spark, sf_dir):
    df, a = _analysis(spark, sf_dir, "documents")
    return FA.strip_ungrounded(df.select("doc_id", "lang", "text"), FA.facts(a, df.schema),
                               ["doc_id"]).select("doc_id", "lang")


# Replies cut from conversation turns: all sections; figures true and invented; empty
# sections; another language.
_REPLY = f"""CASE WHEN turn % 4 = 0 THEN {_REPORT_REPLY}
 WHEN turn % 4 = 1 THEN concat('## SUMMARY\\nTotal about 3758439620 over ', CAST(conv_id * 7 AS STRING),
   ' talks\\n## FINDINGS\\n- Records are 15,000\\n- Invented 987654 here\\n- ', role,
   '\\n## RECOMMENDATIONS\\n- Ask for ', CAST(conv_id * 13 AS STRING), ' more')
 WHEN turn % 4 = 2 THEN concat('## SUMMARY\\n', text, '\\n## FINDINGS\\n')
 ELSE 'مرحبا بكم في هذا التقرير الطويل عن المبيعات والعملاء' END"""


def _parsed_sql() -> str:
    """conv_id, turn, summary, findings, recommendations of every reply."""
    reply = _duck_nl(_REPLY).replace("AS STRING", "AS VARCHAR")
    return f"""
SELECT conv_id, turn, findings, recommendations,
       CASE WHEN s = '' AND len(findings) = 0 THEN {_duck_humanize('reply')} ELSE s END AS summary
FROM (SELECT conv_id, turn, reply, {_duck_humanize(_duck_section('reply', 'SUMMARY'))} AS s,
        list_transform({_duck_bullets(_duck_section('reply', 'FINDINGS'))},
                       lambda f: {_duck_humanize('f')}) AS findings,
        list_transform({_duck_bullets(_duck_section('reply', 'RECOMMENDATIONS'))},
                       lambda f: {_duck_humanize('f')}) AS recommendations
      FROM (SELECT conv_id, turn, {reply} AS reply FROM conversations))"""


def _english_sql(body: str) -> str:
    """Whether a body is English or too short to judge."""
    return (f"(length({_duck_strip(body)}) < 30 OR "
            f"length(regexp_replace({body}, '[^\\x{{0600}}-\\x{{06FF}}]', '', 'g')) <= "
            f"length(array_to_string(regexp_extract_all({body}, '[A-Za-z]{{3,}}'), '')))")


_BODY = ("concat_ws(' ', summary, array_to_string(findings, ' '), "
         "array_to_string(recommendations, ' '))")


def _reply_sql(stripped: bool) -> str:
    """The reply chain restated, with or without the grounding step."""
    facts = _facts_sql("orders", "o_totalprice", "o_orderdate",
                       ["o_orderstatus", "o_orderpriority"], False)

    def clean(c):
        return f"list_filter({c}, lambda x: NOT list_has_any({O.numbers('x')}, bad))"
    said = f"""
said AS (SELECT *, unnest({O.numbers(_BODY)}) AS n FROM p),
wrong AS (SELECT conv_id, turn, list(n) AS bad FROM said
          WHERE TRY_CAST(n AS DOUBLE) > 12 AND NOT EXISTS (
            SELECT 1 FROM fv WHERE token = n OR abs(TRY_CAST(n AS DOUBLE) - v)
                   <= greatest(1.0, abs(v) * 0.01)) GROUP BY conv_id, turn),
w AS (SELECT p.*, coalesce(bad, []) AS bad FROM p LEFT JOIN wrong USING (conv_id, turn)),
c AS (SELECT conv_id, turn,
        CASE WHEN list_has_any({O.numbers('summary')}, bad) THEN '' ELSE summary END AS summary,
        {clean('findings')} AS findings, {clean('recommendations')} AS recommendations,
        len(findings) - len({clean('findings')}) + len(recommendations)
          - len({clean('recommendations')})
          + CASE WHEN list_has_any({O.numbers('summary')}, bad) THEN 1 ELSE 0 END
          AS dropped_claims FROM w),""" if stripped else """
c AS (SELECT conv_id, turn, summary, findings, recommendations, 0 AS dropped_claims FROM p),"""
    return f"""
WITH fv AS (SELECT token, TRY_CAST(token AS DOUBLE) AS v FROM (
  SELECT DISTINCT unnest({O.numbers('text')}) AS token FROM ({facts}))),
told AS ({_narrative_sql(*_ORDERS_STORY)}),
fb AS (SELECT max(text) FILTER (section = 'summary') AS fs,
              list(text ORDER BY seq) FILTER (section = 'findings') AS ff,
              list(text ORDER BY seq) FILTER (section = 'recommendations') AS fr FROM told),
p AS ({_parsed_sql()}),{said}
e AS (SELECT *, {_english_sql(_BODY)} AS ok FROM c, fb),
o AS (SELECT conv_id, turn, dropped_claims,
        CASE WHEN NOT ok OR summary = '' THEN fs ELSE summary END AS summary,
        CASE WHEN NOT ok OR len(findings) = 0 THEN ff ELSE findings END AS findings,
        CASE WHEN NOT ok OR len(recommendations) = 0 THEN fr ELSE recommendations END
          AS recommendations,
        (NOT ok OR (summary = '' AND fs <> '') OR (len(findings) = 0 AND len(ff) > 0)
         OR (len(recommendations) = 0 AND len(fr) > 0)) AS used_fallback FROM e)
SELECT conv_id, turn, summary, array_to_string(findings, ' | ') AS findings,
       array_to_string(recommendations, ' | ') AS recommendations, used_fallback,
       {_english_sql(_BODY)} AS language_ok{', CAST(dropped_claims AS BIGINT) AS dropped_claims' if stripped else ''}
FROM o"""


def _shown(out: DataFrame, *more: str) -> DataFrame:
    return out.select("conv_id", "turn", "summary",
                      F.array_join("findings", " | ").alias("findings"),
                      F.array_join("recommendations", " | ").alias("recommendations"),
                      "used_fallback", "language_ok", *more)


def _replies(spark, sf_dir) -> DataFrame:
    conv = load_table(spark, sf_dir, "conversations")
    return conv.select("conv_id", "turn", F.expr(_REPLY).alias("text"))


@register("fallback_fill", _reply_sql(False))
def fallback_fill(spark, sf_dir):
    df, a = _analysis(spark, sf_dir, "orders")
    fb = FA.fallback_of(FA.narrative(a, subject="orders"))
    parsed = _replies(spark, sf_dir).select(
        "conv_id", "turn", T.parse_sections(F.col("text")).alias("p")).select(
        "conv_id", "turn", "p.*")
    return _shown(FA.fallback_fill(parsed, fb, "en"))


@register("reply_pipeline", _reply_sql(True))
def reply_pipeline(spark, sf_dir):
    df, a = _analysis(spark, sf_dir, "orders")
    fb = FA.fallback_of(FA.narrative(a, subject="orders"))
    return _shown(FA.reply_pipeline(_replies(spark, sf_dir), FA.facts(a, df.schema),
                                    fallback=fb), "dropped_claims")


# -------------------------------------------------------- browse and charts
from ..operators import browse as BR  # noqa: E402


@register("browse_page", """
SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey, o_custkey,
  o_orderstatus, o_orderdate, o_orderpriority LIMIT 50 OFFSET 100""")
def browse_page(spark, sf_dir):
    return BR.page(load_table(spark, sf_dir, "orders"), limit=50, offset=100,
                   order_by="o_totalprice", direction="desc")


@register("browse_total", "SELECT CAST(count(*) AS BIGINT) AS total FROM part")
def browse_total(spark, sf_dir):
    return BR.total(load_table(spark, sf_dir, "part"))


@register("sample_rows", "SELECT * FROM part ORDER BY p_partkey LIMIT 10")
def sample_rows(spark, sf_dir):
    return P.sample_rows(load_table(spark, sf_dir, "part"), ["p_partkey"])


@register("chart_series_many", """
SELECT coalesce(part, '—') AS x, CAST(lines AS DOUBLE) AS y
FROM (SELECT CAST(l_partkey AS VARCHAR) AS part, count(*) AS lines
      FROM lineitem GROUP BY l_partkey) ORDER BY part LIMIT 40""")
def chart_series_many(spark, sf_dir):
    """Far more groups than points: ordered first, then cut to the chart's 40."""
    register_views(spark, sf_dir)
    res = G.guarded_sql(spark, "SELECT CAST(l_partkey AS STRING) AS part, count(*) AS lines "
                               "FROM lineitem GROUP BY l_partkey").df
    return BR.chart_series(res, ["part"])


@register("chart_series", """
SELECT coalesce(CAST(c_mktsegment AS VARCHAR), '—') AS x, CAST(customers AS DOUBLE) AS y
FROM (SELECT c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS bal
      FROM customer GROUP BY c_mktsegment) ORDER BY c_mktsegment LIMIT 40""")
def chart_series(spark, sf_dir):
    register_views(spark, sf_dir)
    res = G.guarded_sql(spark, "SELECT c_mktsegment, count(*) AS customers, "
                               "round(sum(c_acctbal), 2) AS bal FROM customer "
                               "GROUP BY c_mktsegment").df
    return BR.chart_series(res, ["c_mktsegment"])


# ---------------------------------------------------------------- cleaning
from ..operators import clean as CL  # noqa: E402


def _dirty_orders(spark, sf_dir):
    """Orders with an empty column, an unnamed column, a messy header and
    all-null rows (one per 'P' order), as a workbook upload would have."""
    o = load_table(spark, sf_dir, "orders")
    wide = (o.withColumn("empty_col", F.lit(None).cast("string"))
            .withColumn("Unnamed: 7", F.lit(None).cast("string"))
            .withColumn("  Order \t  Total ", F.col("o_totalprice")))
    blanks = o.where(F.col("o_orderstatus") == "P").select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in wide.schema.fields])
    return wide.unionByName(blanks)


@register("clean_frame", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
       o_totalprice AS "Order Total" FROM orders""")
def clean_frame(spark, sf_dir):
    return CL.clean_frame(_dirty_orders(spark, sf_dir))


def _text_dates(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("dmy_text"),
        F.when(F.col("o_orderstatus") == "P", F.lit(""))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("ts_text"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" x")).alias("not_date"),
        "o_orderpriority")


@register("text_date_promotion", """
WITH t AS (
  SELECT strftime(o_orderdate, '%Y-%m-%d') AS day_text,
         strftime(o_orderdate, '%d/%m/%Y') AS dmy_text,
         CASE WHEN o_orderstatus = 'P' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
         END AS ts_text,
         strftime(o_orderdate, '%Y-%m-%d') || ' x' AS not_date, o_orderpriority FROM orders),
u AS (
  SELECT 'day_text' AS "column", nullif(trim(day_text), '') AS v FROM t UNION ALL
  SELECT 'dmy_text', nullif(trim(dmy_text), '') FROM t UNION ALL
  SELECT 'ts_text', nullif(trim(ts_text), '') FROM t UNION ALL
  SELECT 'not_date', nullif(trim(not_date), '') FROM t UNION ALL
  SELECT 'o_orderpriority', nullif(trim(o_orderpriority), '') FROM t)
SELECT "column", count(v) AS nonempty,
       count(coalesce(try_strptime(v, '%Y-%m-%d %H:%M:%S'), try_strptime(v, '%Y-%m-%dT%H:%M:%S'),
                      try_strptime(v, '%Y-%m-%d %H:%M'), try_strptime(v, '%Y-%m-%d'),
                      try_strptime(v, '%Y/%m/%d'), try_strptime(v, '%d/%m/%Y'))) AS parsed,
       count(v) > 0 AND count(v) = count(coalesce(
           try_strptime(v, '%Y-%m-%d %H:%M:%S'), try_strptime(v, '%Y-%m-%dT%H:%M:%S'),
           try_strptime(v, '%Y-%m-%d %H:%M'), try_strptime(v, '%Y-%m-%d'),
           try_strptime(v, '%Y/%m/%d'), try_strptime(v, '%d/%m/%Y'))) AS promoted
FROM u GROUP BY "column\"""")
def text_date_promotion(spark, sf_dir):
    return CL.date_candidates(_text_dates(spark, sf_dir))


@register("analyze_text_dates", """
SELECT strftime(period_start::DATE, '%Y-%m-%d') AS period_start,
       strftime(period_end::DATE, '%Y-%m-%d') AS period_end, bins, first, last, peak_label
FROM (""" + O.trend_summary("orders", "o_orderdate", "o_totalprice") + ")")
def analyze_text_dates(spark, sf_dir):
    """The analysis of orders with the date as text: the same trend as with timestamps."""
    o = load_table(spark, sf_dir, "orders")
    text = o.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return analyze(text).trend_summary.select("period_start", "period_end", "bins", "first",
                                              "last", "peak_label")


@register("text_date_values", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day_text_date,
       -- a slashed date is read month first wherever that gives a date
       strftime(CASE WHEN day(o_orderdate) <= 12
                     THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate))
                     ELSE CAST(o_orderdate AS DATE) END, '%Y-%m-%d') AS dmy_text_date
FROM orders""")
def text_date_values(spark, sf_dir):
    p = CL.promote_text_dates(_text_dates(spark, sf_dir))
    return p.select("o_orderkey",
                    F.date_format("day_text", "yyyy-MM-dd").alias("day_text_date"),
                    F.date_format("dmy_text", "yyyy-MM-dd").alias("dmy_text_date"))


@register("data_dictionary", f"""
WITH c AS ({O.profile_columns('orders')}),
r AS (
  SELECT 'o_orderkey' AS "column", {O.fmt_number('min(o_orderkey)')} || ' – ' ||
         {O.fmt_number('max(o_orderkey)')} AS range FROM orders UNION ALL
  SELECT 'o_custkey', {O.fmt_number('min(o_custkey)')} || ' – ' || {O.fmt_number('max(o_custkey)')}
  FROM orders UNION ALL
  SELECT 'o_totalprice', {O.fmt_number('min(o_totalprice)')} || ' – ' ||
         {O.fmt_number('max(o_totalprice)')} FROM orders UNION ALL
  SELECT 'o_orderdate', strftime(min(o_orderdate), '%Y-%m-%d') || ' – ' ||
         strftime(max(o_orderdate), '%Y-%m-%d') FROM orders)
SELECT c.ordinal, c."column" AS name, {O.humanize('c."column"')} AS label, kind,
       round(100 * nulls / (SELECT count(*) FROM orders), 1) AS nulls_pct,
       c."distinct" AS "unique", coalesce(r.range, '') AS range
FROM c LEFT JOIN r ON c."column" = r."column\"""")
def data_dictionary(spark, sf_dir):
    st = ST.column_stats(load_table(spark, sf_dir, "orders"))
    num = F.concat(L.fmt_number(F.col("min_num")), F.lit(" – "), L.fmt_number(F.col("max_num")))
    dts = F.concat(F.col("min_text"), F.lit(" – "), F.col("max_text"))
    rng = (F.when(F.col("kind") == "numeric", F.when(F.col("min_num").isNotNull(), num))
           .when(F.col("kind") == "datetime", F.when(F.col("min_text").isNotNull(), dts)))
    return st.select(
        "ordinal", F.col("column").alias("name"), L.humanize(F.col("column")).alias("label"),
        "kind", F.round(100 * (F.col("rows") - F.col("nonnull")) /
                        F.greatest(F.col("rows"), F.lit(1)), 1).alias("nulls_pct"),
        F.col("distinct").alias("unique"), F.coalesce(rng, F.lit("")).alias("range"))


from . import round_trips  # noqa: E402,F401  registers its queries
