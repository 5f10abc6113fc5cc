"""DuckDB SQL that restates each registered query independently.

These strings are the correctness oracle: the same parquet tables are
registered as views in DuckDB, and the result must equal the Spark
DataFrame (row count, column names, values).  The generators below take
table and column names and emit plain SQL text.
"""

from __future__ import annotations

from ..functions import words as W


def ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str | None) -> str:
    if s is None:
        return "CAST(NULL AS VARCHAR)"
    return "'" + s.replace("'", "''") + "'"


def _hints_sql(expr: str, hints: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {lit(h)})" for h in hints) + ")"


def is_rate(name: str) -> bool:
    low = name.lower()
    return any(h in low for h in W.RATE_HINTS)


# --------------------------------------------------------------------- KPIs
def kpis(source: str, measure: str | None) -> str:
    parts = [f"SELECT 0 AS seq, 'records' AS key, CAST(count(*) AS DOUBLE) AS value, "
             f"CAST(NULL AS VARCHAR) AS \"column\" FROM {source}"]
    if measure:
        m = f"TRY_CAST({ident(measure)} AS DOUBLE)"
        guard = f"HAVING count({m}) > 0"
        if not is_rate(measure):
            parts.append(f"SELECT 1, 'total', round(sum({m}), 2), {lit(measure)} "
                         f"FROM {source} {guard}")
        parts.append(f"SELECT 2, 'average', round(avg({m}), 2), {lit(measure)} "
                     f"FROM {source} {guard}")
        parts.append(f"SELECT 3, 'highest', round(max({m}), 2), {lit(measure)} "
                     f"FROM {source} {guard}")
    return "\nUNION ALL\n".join(parts)


# -------------------------------------------------------------------- trend
def trend_bins(source: str, date_col: str, measure: str | None) -> str:
    m = f"TRY_CAST({ident(measure)} AS DOUBLE)" if measure else "CAST(NULL AS DOUBLE)"
    value = "coalesce(s, 0.0)" if measure else "CAST(coalesce(c, 0) AS DOUBLE)"
    tail = W.MAX_TREND_POINTS - 1
    return f"""
WITH d AS (
  SELECT CAST({ident(date_col)} AS TIMESTAMP) AS ts, {m} AS m
  FROM {source} WHERE {ident(date_col)} IS NOT NULL),
bnd AS (
  SELECT min(ts) AS mn, max(ts) AS mx,
         CASE WHEN floor((epoch(max(ts)) - epoch(min(ts))) / 86400) > {W.MONTH_SPAN_DAYS}
              THEN 'month' ELSE 'day' END AS granularity
  FROM d HAVING count(*) > 0),
binned AS (
  SELECT CASE WHEN granularity = 'month' THEN last_day(CAST(ts AS DATE))
              ELSE CAST(ts AS DATE) END AS bin,
         sum(m) AS s, count(*) AS c, min(ts) AS t0, max(ts) AS t1
  FROM d, bnd GROUP BY 1),
spine AS (
  SELECT granularity,
         CASE WHEN granularity = 'month' THEN last_day(CAST(g AS DATE))
              ELSE CAST(g AS DATE) END AS bin
  FROM (SELECT granularity, unnest(CASE WHEN granularity = 'month'
          THEN generate_series(greatest(date_trunc('month', mn),
                                        date_trunc('month', mx) - INTERVAL {tail} MONTH),
                               date_trunc('month', mx), INTERVAL 1 MONTH)
          ELSE generate_series(greatest(date_trunc('day', mn),
                                        date_trunc('day', mx) - INTERVAL {tail} DAY),
                               date_trunc('day', mx), INTERVAL 1 DAY) END) AS g
        FROM bnd)),
bins AS (
  SELECT spine.bin, granularity, round({value}, 2) AS value, coalesce(c, 0) AS records,
         t0, t1, CAST(row_number() OVER (ORDER BY spine.bin) - 1 AS BIGINT) AS idx
  FROM spine LEFT JOIN binned ON spine.bin = binned.bin),
med AS (
  SELECT count(*) AS n, median(records) * {W.MIN_EDGE_SHARE} AS fl FROM bins),
okb AS (
  SELECT bins.*, n, records >= fl AS ok FROM bins, med),
lr AS (
  SELECT min(CASE WHEN ok THEN idx END) AS f, max(CASE WHEN ok THEN idx END) AS g,
         max(n) AS n FROM okb),
lr2 AS (
  SELECT CASE WHEN n <= 2 THEN 0 ELSE least(f, n - 2) END AS L, g, n FROM lr),
lr3 AS (
  SELECT L, CASE WHEN n <= 2 THEN n - 1 ELSE greatest(g, L + 1) END AS R FROM lr2)
SELECT idx, strftime(bin, '%Y-%m-%d') AS label, granularity, value,
       CAST(records AS BIGINT) AS records, t0, t1,
       (idx >= L AND idx <= R) AS kept, CAST(n AS BIGINT) AS n
FROM okb, lr3"""


def trend(source: str, date_col: str, measure: str | None) -> str:
    return f"""
SELECT CAST(row_number() OVER (ORDER BY idx) - 1 AS INTEGER) AS position, label, value,
       records, granularity
FROM ({trend_bins(source, date_col, measure)}) WHERE kept
QUALIFY count(*) OVER () >= 2"""


def trend_summary(source: str, date_col: str, measure: str | None) -> str:
    return f"""
WITH k AS (SELECT * FROM ({trend_bins(source, date_col, measure)}) WHERE kept),
s AS (
  SELECT CAST(count(*) AS BIGINT) AS bins, arg_min(value, idx) AS first,
         arg_max(value, idx) AS last,
         (SELECT label FROM k ORDER BY value DESC, idx ASC LIMIT 1) AS peak_label,
         max(value) AS peak_value, min(t0) AS p0, max(t1) AS p1, max(n) AS n,
         max(granularity) AS granularity
  FROM k)
SELECT {lit(date_col)} AS "column", {lit(measure)} AS measure, granularity, bins,
       first, last,
       CASE WHEN first <> 0 THEN round((last - first) / first * 100, 1) END AS change_pct,
       peak_label, peak_value, strftime(p0, '%Y-%m-%d') AS period_start,
       strftime(p1, '%Y-%m-%d') AS period_end, n - bins AS trimmed_periods
FROM s WHERE bins >= 2"""


# ---------------------------------------------------------------- breakdowns
def breakdowns(source: str, dims: list[str], measure: str | None,
               dedup: bool = True) -> str:
    kind = "count" if measure is None else ("avg" if is_rate(measure) else "sum")
    m = f"TRY_CAST({ident(measure)} AS DOUBLE)" if measure else "CAST(NULL AS DOUBLE)"
    stacked = "\n  UNION ALL ".join(
        f"SELECT {j} AS dim_order, {lit(d)} AS \"column\", CAST({ident(d)} AS VARCHAR) AS label,"
        f" {m} AS m FROM {source} WHERE {ident(d)} IS NOT NULL"
        for j, d in enumerate(dims))
    raw = {"sum": "coalesce(s, 0.0)", "avg": "a", "count": "CAST(c AS DOUBLE)"}[kind]
    meas = lit(measure if kind != "count" else None)
    share = ("NULL" if kind == "avg" else
             "CASE WHEN total_raw <> 0 THEN round(100 * lead_raw / total_raw, 1) END")
    body = f"""
WITH stacked AS (
  {stacked}),
grouped AS (
  SELECT dim_order, "column", label, sum(m) AS s, avg(m) AS a, count(*) AS c
  FROM stacked GROUP BY dim_order, "column", label),
cov AS (SELECT dim_order, sum(c) AS rows_dim FROM grouped GROUP BY dim_order),
allr AS (SELECT count(*) AS rows_all FROM {source}),
g AS (SELECT dim_order, "column", label, {raw} AS raw FROM grouped WHERE {raw} IS NOT NULL),
r AS (
  SELECT *, row_number() OVER (PARTITION BY dim_order ORDER BY raw DESC, label ASC) AS rank,
         count(*) OVER (PARTITION BY dim_order) AS categories,
         sum(raw) OVER (PARTITION BY dim_order) AS total_raw
  FROM g),
top AS (
  SELECT *, round(raw, 2) AS value FROM r
  WHERE rank <= CASE WHEN categories = {W.TOP_N + 1} THEN {W.TOP_N + 1} ELSE {W.TOP_N} END),
top2 AS (
  SELECT *, sum(value) OVER (PARTITION BY dim_order) AS shown_sum,
         max(CASE WHEN rank = 1 THEN raw END) OVER (PARTITION BY dim_order) AS lead_raw,
         max(CASE WHEN rank = 1 THEN label END) OVER (PARTITION BY dim_order) AS leader
  FROM top),
out AS (
  SELECT top2.dim_order, "column", '{kind}' AS kind, {meas} AS measure,
         CAST(rank AS INTEGER) AS rank, label, value,
         CASE WHEN total_raw <> 0 THEN round(100 * value / total_raw, 1) END AS value_pct,
         CAST(categories AS BIGINT) AS categories, round(total_raw, 2) AS total,
         CASE WHEN categories > {W.TOP_N} AND round(total_raw - shown_sum, 2) > 0
              THEN round(total_raw - shown_sum, 2) END AS others,
         leader, round(lead_raw, 2) AS leader_value,
         {share} AS leader_share_pct,
         CASE WHEN rows_all > 0 THEN round(100 * rows_dim / rows_all, 1) ELSE 100.0 END
           AS coverage_pct
  FROM top2 JOIN cov ON top2.dim_order = cov.dim_order, allr)"""
    if dedup and len(dims) > 1:
        return body + """,
sig AS (
  SELECT dim_order, list(struct_pack(rank := rank, label := label, value := value)
                         ORDER BY rank) AS sig
  FROM out GROUP BY dim_order),
keep AS (SELECT min(dim_order) AS dim_order FROM sig GROUP BY sig)
SELECT * FROM out WHERE dim_order IN (SELECT dim_order FROM keep)"""
    return body + "\nSELECT * FROM out"


def breakdown_summary(source: str, dims: list[str], measure: str | None) -> str:
    return f"""
SELECT dim_order, "column", kind, measure, categories, total, others, leader,
       leader_value, leader_share_pct, coverage_pct
FROM ({breakdowns(source, dims, measure)}) WHERE rank = 1"""


# ------------------------------------------------------------------ schema
# Column kinds of the driver tables (numeric / datetime / categorical / other).
SCHEMA: dict[str, list[tuple[str, str, bool]]] = {}


def _schema(table: str, spec: str) -> None:
    cols = []
    for item in spec.split():
        name, t = item.split(":")
        kind = {"i": "numeric", "l": "numeric", "d": "numeric", "t": "datetime",
                "s": "categorical", "a": "other"}[t]
        cols.append((name, kind, t in ("i", "l")))
    SCHEMA[table] = cols


_schema("region", "r_regionkey:i r_name:s")
_schema("nation", "n_nationkey:i n_name:s n_regionkey:i")
_schema("customer", "c_custkey:l c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s")
_schema("supplier", "s_suppkey:l s_name:s s_nationkey:i s_acctbal:d")
_schema("part", "p_partkey:l p_name:s p_brand:s p_type:s p_size:i p_retailprice:d")
_schema("orders", "o_orderkey:l o_custkey:l o_orderstatus:s o_totalprice:d o_orderdate:t "
                  "o_orderpriority:s")
_schema("lineitem", "l_orderkey:l l_partkey:l l_suppkey:l l_linenumber:i l_quantity:d "
                    "l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s "
                    "l_shipdate:t")
_schema("events", "event_id:l ts:t user_id:l event_type:s value:d props:s")
_schema("documents", "doc_id:l text:s lang:s source:s n_chars:l")
_schema("embeddings", "vec_id:l embedding:a label:i")
_schema("pages", "page_id:l url:s html:s")
_schema("benchmark", "item_id:l text:s")
_schema("labels", "doc_id:l quality:i toxic:i")
_schema("conversations", "conv_id:l turn:l role:s text:s")


# ----------------------------------------------------------------- profile
def overview(source: str, cols: list[str]) -> str:
    nulls = " + ".join(f"sum(CASE WHEN {ident(c)} IS NULL THEN 1 ELSE 0 END)" for c in cols)
    n = len(cols)
    return f"""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST({n} AS BIGINT) AS cols,
       round(100 * ({nulls}) / greatest(count(*) * {n}, 1), 2) AS missing_pct,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS BIGINT)
         AS duplicate_rows
FROM {source}"""


def profile_columns(table: str) -> str:
    parts = [f"SELECT {i} AS ordinal, {lit(c)} AS \"column\", '{k}' AS kind, "
             f"count(*) - count({ident(c)}) AS nulls, "
             f"{'count(DISTINCT ' + ident(c) + ')' if k != 'other' else '0'} AS distinct "
             f"FROM {table}"
             for i, (c, k, _) in enumerate(SCHEMA[table])]
    return "\nUNION ALL\n".join(parts)


def profile_numeric(table: str) -> str:
    parts = []
    for i, (c, k, _) in enumerate(SCHEMA[table]):
        if k != "numeric":
            continue
        v = f"CAST({ident(c)} AS DOUBLE)"
        parts.append(f"""
SELECT {i} AS ordinal, {lit(c)} AS "column", round(avg({v}), 4) AS mean,
       round(stddev_samp({v}), 4) AS std, round(min({v}), 4) AS min, round(max({v}), 4) AS max,
       round(quantile_cont({v}, 0.5), 4) AS median, round(quantile_cont({v}, 0.25), 4) AS q1,
       round(quantile_cont({v}, 0.75), 4) AS q3,
       (SELECT CAST(count(*) AS BIGINT) FROM {table}, (
          SELECT quantile_cont({v}, 0.25) AS a, quantile_cont({v}, 0.75) AS b FROM {table}) qq
        WHERE {v} < a - 1.5 * (b - a) OR {v} > b + 1.5 * (b - a)) AS outliers
FROM {table}""")
    return "\nUNION ALL\n".join(parts)


def profile_datetime(table: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {i} AS ordinal, {lit(c)} AS \"column\", "
        f"strftime(min({ident(c)}), '%Y-%m-%d') AS min, "
        f"strftime(max({ident(c)}), '%Y-%m-%d') AS max FROM {table}"
        for i, (c, k, _) in enumerate(SCHEMA[table]) if k == "datetime")


def top_values(table: str, k: int = W.PROFILE_TOP_VALUES, bars_only: bool = False) -> str:
    counts = "\n  UNION ALL ".join(
        f"SELECT {i} AS ordinal, {lit(c)} AS \"column\", CAST({ident(c)} AS VARCHAR) AS value,"
        f" count(*) AS n FROM {table} WHERE {ident(c)} IS NOT NULL GROUP BY {ident(c)}"
        for i, (c, kind, _) in enumerate(SCHEMA[table]) if kind == "categorical")
    extra = ""
    if bars_only:
        extra = (f" AND ordinal IN (SELECT ordinal FROM counts GROUP BY ordinal "
                 f"HAVING count(*) > 1 AND count(*) <= {W.PROFILE_BAR_MAX_DISTINCT})")
    return f"""
WITH counts AS (
  {counts}),
r AS (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY n DESC, value ASC) AS rank
      FROM counts)
SELECT ordinal, "column", CAST(rank AS INTEGER) AS rank, value, CAST(n AS BIGINT) AS count
FROM r WHERE rank <= {k}{extra}"""


def profile_identifiers(table: str) -> str:
    parts = []
    for i, (c, k, _) in enumerate(SCHEMA[table]):
        low = c.lower()
        by_name = (low == "id" or low.endswith("_id") or low.endswith("-id")
                   or low.startswith("id_"))
        uniq = (f"(count(*) > 0 AND count(DISTINCT {ident(c)}) = count(*))"
                if k == "numeric" else "(count(*) < 0)")
        parts.append(f"SELECT {i} AS ordinal, {lit(c)} AS \"column\", "
                     f"({'true' if by_name else 'false'} OR {uniq}) AS is_identifier FROM {table}")
    return "\nUNION ALL\n".join(parts)


def correlations(source: str, nums: list[str], cut: float = W.CORRELATION_CUT) -> str:
    parts = []
    for i in range(len(nums)):
        for j in range(i + 1, len(nums)):
            a, b = f"CAST({ident(nums[i])} AS DOUBLE)", f"CAST({ident(nums[j])} AS DOUBLE)"
            parts.append(f"SELECT {lit(nums[i])} AS a, {lit(nums[j])} AS b, corr({a}, {b}) AS r "
                         f"FROM {source}")
    return (f"SELECT a, b, round(r, 3) AS r FROM ({' UNION ALL '.join(parts)}) "
            f"WHERE r IS NOT NULL AND NOT isnan(r) AND abs(r) >= {cut}")


def series(source: str, date_col: str, measure: str) -> str:
    return f"""
WITH d AS (SELECT CAST(CAST({ident(date_col)} AS TIMESTAMP) AS DATE) AS day,
                  CAST({ident(measure)} AS DOUBLE) AS m
           FROM {source} WHERE {ident(date_col)} IS NOT NULL),
b AS (SELECT min(day) AS mn, max(day) AS mx,
             CASE WHEN datediff('month', date_trunc('month', min(day)),
                                date_trunc('month', max(day))) + 1 >= 3
                  THEN 'month' ELSE 'day' END AS granularity FROM d),
spine AS (
  SELECT granularity, CASE WHEN granularity = 'month' THEN last_day(CAST(g AS DATE))
                           ELSE CAST(g AS DATE) END AS bin
  FROM (SELECT granularity, unnest(CASE WHEN granularity = 'month'
          THEN generate_series(CAST(date_trunc('month', mn) AS TIMESTAMP),
                               CAST(date_trunc('month', mx) AS TIMESTAMP), INTERVAL 1 MONTH)
          ELSE generate_series(CAST(mn AS TIMESTAMP), CAST(mx AS TIMESTAMP), INTERVAL 1 DAY)
          END) AS g FROM b)),
binned AS (
  SELECT CASE WHEN granularity = 'month' THEN last_day(day) ELSE day END AS bin, sum(m) AS s
  FROM d, b GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY spine.bin) - 1 AS INTEGER) AS position,
       strftime(spine.bin, '%Y-%m-%d') AS label, granularity,
       round(coalesce(s, 0.0), 4) AS value
FROM spine LEFT JOIN binned ON spine.bin = binned.bin"""


def histogram(source: str, column: str) -> str:
    v = f"CAST({ident(column)} AS DOUBLE)"
    return f"""
WITH vals AS (SELECT {v} AS v FROM {source} WHERE {v} IS NOT NULL),
b AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n,
             least({W.HISTOGRAM_MAX_BINS}, greatest({W.HISTOGRAM_MIN_BINS},
                   CAST(floor(sqrt(count(*))) AS INTEGER))) AS bins FROM vals),
c AS (SELECT CAST(least(floor((v - lo) / (hi - lo) * bins), bins - 1) AS INTEGER) AS bin,
             count(*) AS count FROM vals, b GROUP BY 1),
e AS (SELECT lo, hi, bins, CAST(unnest(generate_series(0, bins - 1)) AS INTEGER) AS bin FROM b)
SELECT {lit(column)} AS "column", e.bin,
       round(lo + (hi - lo) / bins * e.bin, 4) AS lo,
       round(CASE WHEN e.bin = bins - 1 THEN hi ELSE lo + (hi - lo) / bins * (e.bin + 1) END, 4)
         AS hi,
       CAST(coalesce(count, 0) AS BIGINT) AS count
FROM e LEFT JOIN c ON e.bin = c.bin"""


def multi_overview(tables: list[str], relationships: int) -> str:
    parts = " UNION ALL ".join(
        f"SELECT rows, missing_pct FROM ({overview(t, [c for c, _, _ in SCHEMA[t]])})"
        for t in tables)
    cols = sum(len(SCHEMA[t]) for t in tables)
    return f"""
SELECT CAST(count(*) AS BIGINT) AS tables, CAST(sum(rows) AS BIGINT) AS rows,
       CAST({cols} AS BIGINT) AS cols,
       round(coalesce(sum(missing_pct * rows) / sum(rows), 0.0), 2) AS missing_pct,
       CAST({relationships} AS BIGINT) AS relationships
FROM ({parts})"""


# --------------------------------------------------------------- semantics
def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def semantics(table: str) -> str:
    parts = []
    for i, (c, k, is_int) in enumerate(SCHEMA[table]):
        col = ident(c)
        if k == "numeric":
            flag = f"coalesce(bool_and(CAST({col} AS DOUBLE) IN (0, 1)), false)"
        else:
            flag = "(count(*) < 0)"
        distinct = f"count(DISTINCT {col})" if k != "other" else "0"
        parts.append(
            f"SELECT {i} AS ordinal, {lit(c)} AS \"column\", '{k}' AS kind, "
            f"{'true' if is_int else 'false'} AS is_integer, count(*) AS rows, "
            f"count({col}) AS nonnull, {distinct} AS ndist, {flag} AS flag_values "
            f"FROM {table}")
    stats = "\n  UNION ALL ".join(parts)
    low = 'lower("column")'
    return f"""
WITH s AS (
  {stats}),
t AS (
  SELECT *, list_filter(regexp_split_to_array(lower(trim("column")), '[\\s_\\-.]+'),
                        lambda x: length(x) > 0) AS toks FROM s),
f AS (
  SELECT *,
    kind = 'numeric' AND ((len(toks) > 0 AND (list_contains({_list(W.ID_TOKENS)}, toks[1])
                                              OR list_contains({_list(W.ID_TOKENS)}, toks[-1])))
      OR coalesce(is_integer AND rows >= {W.MIN_ROWS_FOR_RATIO}
                  AND ndist / rows >= {W.NEAR_UNIQUE_RATIO}, false)) AS is_identifier,
    kind = 'numeric' AND nonnull > 0 AND flag_values AS is_flag,
    {_hints_sql(low, W.RATE_HINTS)} AS is_rate,
    (CASE WHEN {_hints_sql(low, W.MEASURE_HINTS)} THEN 2 ELSE 0 END
     + CASE WHEN {_hints_sql(low, W.COUNT_HINTS)} THEN 1 ELSE 0 END
     + CASE WHEN {_hints_sql(low, W.AGGREGATE_HINTS)} THEN 2 ELSE 0 END
     - CASE WHEN {_hints_sql(low, W.RATE_HINTS)} THEN 3 ELSE 0 END) AS m_score,
    CASE WHEN {_hints_sql(low, W.DIM_HINTS)} THEN 1 ELSE 0 END AS d_score,
    kind = 'categorical' AND NOT {_hints_sql(low, W.NON_DIM_HINTS)}
      AND ndist > 1 AND ndist <= {W.MAX_DIM_CATEGORIES}
      AND coalesce(nonnull < {W.MIN_ROWS_FOR_RATIO}
                   OR ndist / nonnull <= {W.REPETITIVE_RATIO}, false) AS dim_ok
  FROM t),
g AS (
  SELECT *, CASE WHEN kind = 'datetime' THEN 'date'
                 WHEN kind = 'numeric' AND NOT is_identifier AND NOT is_flag THEN 'measure'
                 WHEN dim_ok THEN 'dimension' ELSE 'none' END AS role
  FROM f),
h AS (
  SELECT *, CASE WHEN role = 'measure' THEN m_score WHEN role = 'dimension' THEN d_score
                 ELSE 0 END AS score FROM g)
SELECT ordinal, "column", role, CAST(score AS INTEGER) AS score, is_identifier, is_flag,
       is_rate,
       CAST(row_number() OVER (PARTITION BY role ORDER BY score DESC,
            CASE WHEN role = 'dimension' THEN ndist ELSE 0 END, ordinal) AS INTEGER)
         AS role_rank
FROM h"""


# ------------------------------------------------------------ labels/format
def _map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in pairs.items()) + "}"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def humanize(expr: str, language: str = "en") -> str:
    from ..functions.labels import DICTIONARY, PHRASES
    idx = 0 if language == "ar" else 1
    word = _map({k: v[idx] for k, v in DICTIONARY.items()})
    phrase = _map({k: v[idx] for k, v in PHRASES.items()})
    raw = strip_ws(expr)
    w = (f"list_transform(list_filter(regexp_split_to_array(regexp_replace({raw}, "
         f"'([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[\\s_\\-.]+'), lambda p: p <> ''), "
         f"lambda p: lower(p))")
    n = f"len({w})"
    id_core = f"({n} > 1 AND {w}[-1] = 'id')"
    core = f"(CASE WHEN {id_core} THEN {w}[1:{n} - 1] ELSE {w} END)"
    known = f"list_transform({core}, lambda x: {word}[x])"
    pretty = f"array_to_string({core}, ' ')"
    return f"""(CASE
  WHEN regexp_matches({raw}, '[\\x{{0600}}-\\x{{06FF}}]') THEN {raw}
  WHEN {n} = 0 THEN {raw}
  WHEN {phrase}[array_to_string({w}, ' ')] IS NOT NULL THEN {phrase}[array_to_string({w}, ' ')]
  WHEN {id_core} AND {phrase}[array_to_string({core}, ' ')] IS NOT NULL
    THEN {phrase}[array_to_string({core}, ' ')]
  WHEN list_bool_and(list_transform({known}, lambda x: x IS NOT NULL))
    THEN array_to_string({known}, ' ')
  ELSE upper(substr({pretty}, 1, 1)) || substr({pretty}, 2) END)"""


def fmt_number(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN '—' ELSE regexp_replace(regexp_replace("
            f"format('{{:,.2f}}', CAST({x} AS DOUBLE)), '0+$', ''), '\\.$', '') END)")


def fmt_compact(x: str) -> str:
    d = f"CAST({x} AS DOUBLE)"

    def strip(s):
        return f"regexp_replace(regexp_replace({s}, '0+$', ''), '\\.$', '')"
    return (f"(CASE WHEN {x} IS NULL THEN '—' "
            f"WHEN abs({d}) >= 1e9 THEN {strip(f'format(' + chr(39) + '{:,.2f}' + chr(39) + f', {d} / 1e9)')} || 'B' "
            f"WHEN abs({d}) >= 1e6 THEN {strip(f'format(' + chr(39) + '{:,.2f}' + chr(39) + f', {d} / 1e6)')} || 'M' "
            f"WHEN abs({d}) >= 1000 THEN format('{{:,.0f}}', {d}) "
            f"ELSE {fmt_number(x)} END)")


def py_number(x: str, integral: str = "false") -> str:
    flt = f"regexp_replace(format('{{:.2f}}', CAST({x} AS DOUBLE)), '(\\.[0-9])0$', '\\1')"
    intg = f"format('{{:.0f}}', CAST({x} AS DOUBLE))"
    return (f"(CASE WHEN {x} IS NULL THEN 'None' WHEN {integral} THEN {intg} "
            f"ELSE {flt} END)")


def num_text(x: str, integral: str = "false") -> str:
    return f"(CASE WHEN {x} = 0 THEN '0' ELSE {py_number(x, integral)} END)"


def clean_title(x: str, fallback: str = "'report'") -> str:
    t = f"regexp_replace({strip_ws(x)}, '(?i)\\.(csv|xlsx?|json)(-\\d+)?$', '')"
    t = f"regexp_replace({t}, '\\s*\\(\\d+\\)$', '')"
    t = f"regexp_replace({t}, '^[ \\-_·]+|[ \\-_·]+$', '', 'g')"
    return f"(CASE WHEN {t} = '' THEN {fallback} ELSE {t} END)"


def numbers(x: str) -> str:
    return (f"list_distinct(list_filter(list_transform(regexp_extract_all({x}, "
            f"'[0-9][0-9,]*\\.?[0-9]*'), lambda t: regexp_replace(replace(t, ',', ''), "
            f"'\\.$', '')), lambda t: t <> ''))")
