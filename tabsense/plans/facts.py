"""Facts, narrative, grounding and fallback (FCT-1, NAR-1, GRD-2/3, TXT-4).

Facts and narrative are built from the small analysis outputs (<= 4 KPI
rows, one trend summary row, <= 9 rows per breakdown) with ``format_string``.
Grounding is a join: claim numbers against fact numbers.  The fact side is
bounded by construction (a few dozen numbers per report) and broadcast; the
claim side can be any size and is streamed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..functions import words as W
from ..operators import stats as S
from ..operators.stats import INTEGRAL_TYPES
from .analyze import Analysis

# FIXED VALUES: fact sentence templates per language.
FACT_WORDS = {
    "ar": {
        "records": "عدد السجلات", "total": "إجمالي {m}", "average": "متوسط {m}",
        "highest": "أعلى قيمة لـ{m}",
        "period": "الفترة من {a} إلى {b}",
        "change": "أول قيمة = {first}، آخر قيمة = {last}",
        "changePct": "، نسبة التغير = {pct}%",
        "peak": "الذروة في {label} = {value}",
        "by": "حسب {dim}: {n} فئة، المتصدر «{leader}» = {value}",
        "share": " ({pct}% من الإجمالي)",
        "scope": " (محسوبة على {pct}% من الصفوف التي تحمل قيمة)",
        "top": "أعلى قيم {dim}: {pairs}",
    },
    "en": {
        "records": "records", "total": "total of {m}", "average": "average of {m}",
        "highest": "highest of {m}",
        "period": "period from {a} to {b}",
        "change": "first value = {first}, last = {last}",
        "changePct": ", change = {pct}%",
        "peak": "peak at {label} = {value}",
        "by": "by {dim}: {n} categories, top is '{leader}' = {value}",
        "share": " ({pct}% of total)",
        "scope": " (computed on the {pct}% of rows that have a value)",
        "top": "top {dim} values: {pairs}",
    },
}

# FIXED VALUES: narrative templates per language.
NARRATIVE_WORDS = {
    "ar": {
        "covers": "يغطي هذا التقرير {records} سجلاً من {subject}.",
        "total": "بلغ إجمالي {measure} {total}، بمتوسط {average} لكل سجل، وأعلى قيمة {highest}.",
        "period": "تمتد البيانات من {start} إلى {end}.",
        "rose": "ارتفع مؤشر {measure} من {first} إلى {last} بنسبة {pct}%.",
        "fell": "تراجع مؤشر {measure} من {first} إلى {last} بنسبة {pct}%.",
        "steady": "استقر مؤشر {measure} عند مستوى {last} تقريباً.",
        "peak": "سُجلت الذروة في {label} بقيمة {value}.",
        "leader": "تصدّر «{leader}» في {dim} بقيمة {value} ({pct}% من الإجمالي{scope}).",
        "leaderNoPct": "تصدّر «{leader}» في {dim} بقيمة {value}.",
        "scopeNote": " المحسوب على {pct}% من الصفوف المصنّفة",
        "spread": "تتوزع البيانات على {count} {plural} في {dim}.",
        "recConcentration": "راجع تركّز {pct}% من {measure} في «{leader}» وقيّم مخاطر الاعتماد عليه.",
        "recTrend": "ادرس أسباب تغير {measure} بنسبة {pct}% خلال الفترة.",
        "recDetail": "وسّع البيانات المتاحة لتحليل أعمق (تفاصيل زمنية أو تصنيفات إضافية).",
        "recMonitor": "تابع مؤشرات {measure} دورياً لرصد أي انحراف مبكراً.",
        "of": "البيانات",
    },
    "en": {
        "covers": "This report covers {records} records from {subject}.",
        "total": "Total {measure} reached {total}, averaging {average} per record, with a peak of {highest}.",
        "period": "The data spans {start} to {end}.",
        "rose": "{measure} rose from {first} to {last}, up {pct}%.",
        "fell": "{measure} fell from {first} to {last}, down {pct}%.",
        "steady": "{measure} held steady at about {last}.",
        "peak": "The peak was recorded on {label} at {value}.",
        "leader": "'{leader}' leads {dim} with {value} ({pct}% of the total{scope}).",
        "leaderNoPct": "'{leader}' leads {dim} with {value}.",
        "scopeNote": ", measured on the {pct}% of rows that carry a value",
        "spread": "The data spreads across {count} {plural} in {dim}.",
        "recConcentration": "Review the {pct}% concentration of {measure} in '{leader}' and assess dependency risk.",
        "recTrend": "Investigate what drove the {pct}% change in {measure} over the period.",
        "recDetail": "Broaden the data available for deeper analysis (finer dates or extra categories).",
        "recMonitor": "Track {measure} regularly to catch deviations early.",
        "of": "the data",
    },
}


def template(tmpl: str, **parts: Column) -> Column:
    """Fill a ``{name}`` template with Column values (literal text kept)."""
    out, rest = [], tmpl
    while "{" in rest:
        pre, tail = rest.split("{", 1)
        key, rest = tail.split("}", 1)
        if pre:
            out.append(F.lit(pre))
        out.append(parts[key].cast("string"))
    if rest:
        out.append(F.lit(rest))
    return F.concat(*out) if out else F.lit("")


def _integral_measure(a: Analysis, df_schema) -> bool:
    m = a.choice.measure
    return bool(m) and m in df_schema.names and isinstance(df_schema[m].dataType,
                                                          INTEGRAL_TYPES)


def _num_text(v: Column, integral: bool | Column) -> Column:
    """Python text of a value after ``_num(v) or 0``: 0 prints as ``0``."""
    return F.when(v == 0, F.lit("0")).otherwise(L.py_number(v, integral))


# ------------------------------------------------------------------ FCT-1
def facts(a: Analysis, schema, table: str | None = None, language: str = "en") -> DataFrame:
    """FCT-1: numbered fact sentences ``(seq, text)`` — the only numbers a
    narrative may use."""
    w = FACT_WORDS.get(language, FACT_WORDS["en"])
    prefix = f"[{table}] " if table else ""
    int_m = _integral_measure(a, schema)
    m = F.coalesce(F.col("column"), F.lit(""))
    name = (F.when(F.col("key") == "records", F.lit(w["records"]))
            .when(F.col("key") == "total", template(w["total"], m=m))
            .when(F.col("key") == "average", template(w["average"], m=m))
            .otherwise(template(w["highest"], m=m)))
    whole = (F.col("key") == "records") | ((F.col("key") != "average") & F.lit(int_m))
    val = F.coalesce(L.py_digits(F.col("digits"), whole), L.py_number(F.col("value"), whole))
    parts = [a.kpis.select(F.col("seq").cast("int").alias("seq"),
                           F.concat(F.lit(prefix), name, F.lit(" = "), val).alias("text"))]
    if a.trend_summary is not None:
        s = a.trend_summary
        int_t = F.lit(int_m or a.choice.measure is None)
        change = F.concat(template(w["change"], first=_num_text(F.col("first"), int_t),
                                   last=_num_text(F.col("last"), int_t)),
                          F.when(F.col("change_pct").isNotNull(), template(
                              w["changePct"], pct=L.py_number(F.col("change_pct"))))
                          .otherwise(F.lit("")))
        parts += [
            s.select(F.lit(10).alias("seq"), F.concat(F.lit(prefix), template(
                w["period"], a=F.col("period_start"), b=F.col("period_end"))).alias("text")),
            s.select(F.lit(11).alias("seq"), F.concat(F.lit(prefix), change).alias("text")),
            s.select(F.lit(12).alias("seq"), F.concat(F.lit(prefix), template(
                w["peak"], label=F.col("peak_label"),
                value=_num_text(F.col("peak_value"), int_t))).alias("text"))]
    if a.breakdowns is not None:
        bd = a.breakdowns
        int_b = (F.col("kind") == "count") | ((F.col("kind") == "sum") & F.lit(int_m))
        pairs = (bd.where(F.col("rank") <= 5)
                 .groupBy("dim_order")
                 .agg(F.array_sort(F.collect_list(F.struct(
                     "rank", F.concat("label", F.lit("="),
                                      _num_text(F.col("value"), int_b)).alias("p"))))
                      .alias("pairs")))
        head = bd.where(F.col("rank") == 1).join(pairs, "dim_order")
        share = F.when(F.col("leader_share_pct").isNotNull(), template(
            w["share"], pct=L.py_number(F.col("leader_share_pct")))).otherwise(F.lit(""))
        scope = F.when(F.col("coverage_pct") >= W.COVERAGE_FULL_PCT, F.lit("")).otherwise(
            template(w["scope"], pct=L.py_number(F.col("coverage_pct"))))
        by = template(w["by"], dim=F.col("column"), n=F.col("categories"),
                      leader=F.col("leader"),
                      value=_num_text(F.col("leader_value"), int_b))
        top = template(w["top"], dim=F.col("column"),
                       pairs=F.array_join(F.transform("pairs", lambda x: x["p"]), ", "))
        parts += [
            head.select((F.lit(20) + 2 * F.col("dim_order")).cast("int").alias("seq"),
                        F.concat(F.lit(prefix), by, share, scope).alias("text")),
            head.where(F.col("categories") > 2).select(
                (F.lit(21) + 2 * F.col("dim_order")).cast("int").alias("seq"),
                F.concat(F.lit(prefix), top).alias("text"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("seq")))
                      .alias("seq"), "text")


# ------------------------------------------------------------------ NAR-1
def narrative(a: Analysis, subject: str = "", language: str = "en") -> DataFrame:
    """NAR-1: ``(section, seq, text)`` — summary (one row), findings (<= 8),
    recommendations (<= 4) written from the numbers alone."""
    t = NARRATIVE_WORDS.get(language, NARRATIVE_WORDS["en"])
    spark = a.kpis.sparkSession
    measure = a.choice.measure
    k = a.kpis.groupBy().agg(
        F.max(F.when(F.col("key") == "records", F.col("value"))).alias("records"),
        F.max(F.when(F.col("key") == "total", F.col("value"))).alias("total"),
        F.max(F.when(F.col("key") == "average", F.col("value"))).alias("average"),
        F.max(F.when(F.col("key") == "highest", F.col("value"))).alias("highest"),
        F.max("column").alias("mcol"))
    rows = []   # (section, order, DataFrame with column text)
    mname = F.lit(measure or "")
    m_or = F.lit(measure or t["of"])
    if measure:
        rows.append(("findings", 0, k.where(F.col("total").isNotNull()).select(template(
            t["total"], measure=L.measure_phrase(mname), total=L.fmt_number(F.col("total")),
            average=L.fmt_number(F.col("average")),
            highest=L.fmt_number(F.col("highest"))).alias("text"))))
    s = a.trend_summary
    if s is not None:
        pct = F.col("change_pct")
        steady = pct.isNull() | (F.abs(pct) < 1)
        move = F.when(pct > 0, template(t["rose"], measure=m_or,
                                        first=L.fmt_number(F.col("first")),
                                        last=L.fmt_number(F.col("last")),
                                        pct=L.fmt_number(F.abs(pct)))).otherwise(
            template(t["fell"], measure=m_or, first=L.fmt_number(F.col("first")),
                     last=L.fmt_number(F.col("last")), pct=L.fmt_number(F.abs(pct))))
        rows.append(("findings", 1, s.select(F.when(steady, template(
            t["steady"], measure=m_or, last=L.fmt_number(F.col("last")))).otherwise(move)
            .alias("text"))))
        rows.append(("recommendations", 1, s.where(~steady).select(template(
            t["recTrend"], measure=m_or, pct=L.fmt_number(F.abs(pct))).alias("text"))))
        rows.append(("findings", 2, s.select(template(
            t["peak"], label=F.col("peak_label"),
            value=L.fmt_number(F.col("peak_value"))).alias("text"))))
    if a.breakdowns is not None:
        # one row per remaining dimension: the first two are told, whatever was merged
        dense = Window.partitionBy(F.lit(0)).orderBy("dim_order")
        bd = (a.breakdowns.where(F.col("rank") == 1)
              .withColumn("pos", F.row_number().over(dense)).where("pos <= 2"))
        scope = F.when(F.col("coverage_pct") >= W.COVERAGE_FULL_PCT, F.lit("")).otherwise(
            template(t["scopeNote"], pct=L.fmt_number(F.col("coverage_pct"))))
        lead = F.when(F.col("leader_share_pct").isNotNull(), template(
            t["leader"], leader=F.col("leader"), dim=F.col("column"),
            value=L.fmt_number(F.col("leader_value")),
            pct=L.fmt_number(F.col("leader_share_pct")), scope=scope)).otherwise(
            template(t["leaderNoPct"], leader=F.col("leader"), dim=F.col("column"),
                     value=L.fmt_number(F.col("leader_value"))))
        spread = template(t["spread"], count=F.col("categories"), dim=F.col("column"),
                          plural=L.categories_word(F.col("categories"), language))
        rows.append(("findings", 10, bd.select(
            F.explode(F.filter(F.array(
                F.struct(F.lit(0).alias("i"), lead.alias("t")),
                F.struct(F.lit(1).alias("i"), F.when(F.col("categories") > 3, spread)
                         .alias("t"))), lambda x: x["t"].isNotNull())).alias("x"), "pos")
            .select(F.col("x.t").alias("text"), (F.col("pos") * 2 + F.col("x.i"))
                    .alias("sub"))))
        if measure:
            rows.append(("recommendations", 10, bd.where(
                F.col("leader_share_pct") >= W.CONCENTRATION_PCT).select(template(
                    t["recConcentration"], pct=L.fmt_number(F.col("leader_share_pct")),
                    measure=mname, leader=F.col("leader")).alias("text"),
                    F.col("pos").alias("sub"))))
    parts = []
    for section, order, df in rows:
        if "sub" not in df.columns:
            df = df.withColumn("sub", F.lit(0))
        parts.append(df.select(F.lit(section).alias("section"),
                               (F.lit(order * 100) + F.col("sub")).alias("o"), "text"))
    body = parts[0] if parts else spark.createDataFrame([], "section string, o int, text string")
    for p in parts[1:]:
        body = body.unionByName(p)
    # summary: covers + first two of (total line, period line)
    covers = k.select(template(t["covers"], records=L.fmt_number(F.col("records")),
                               subject=F.lit(subject or t["of"])).alias("c"))
    summary_bits = []
    if measure:
        summary_bits.append(k.where(F.col("total").isNotNull()).select(
            F.lit(0).alias("o"), template(
                t["total"], measure=L.measure_phrase(mname), total=L.fmt_number(F.col("total")),
                average=L.fmt_number(F.col("average")),
                highest=L.fmt_number(F.col("highest"))).alias("t")))
    if s is not None:
        summary_bits.append(s.select(F.lit(1).alias("o"), template(
            t["period"], start=F.col("period_start"), end=F.col("period_end")).alias("t")))
    if summary_bits:
        sb = summary_bits[0]
        for x in summary_bits[1:]:
            sb = sb.unionByName(x)
        joined = sb.agg(F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("o", "t"))), lambda x: x["t"]), " ").alias("rest"))
        summary = covers.crossJoin(joined).select(F.when(
            F.col("rest").isNull() | (F.col("rest") == ""), F.col("c"))
            .otherwise(F.concat_ws(" ", "c", "rest")).alias("text"))
    else:
        summary = covers.select(F.col("c").alias("text"))
    wo = Window.partitionBy("section").orderBy("o")
    ranked = body.withColumn("seq", F.row_number().over(wo))
    findings = ranked.where((F.col("section") == "findings") & (F.col("seq") <= 8))
    recs = ranked.where(F.col("section") == "recommendations").select("section", "o", "text")
    fallback_recs = recs.groupBy().agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") == 0).select(F.lit("recommendations").alias("section"),
                                F.lit(50000).alias("o"), F.lit(t["recDetail"]).alias("text"))
    recs = recs.unionByName(fallback_recs)
    if measure:
        recs = recs.unionByName(spark.range(1).select(
            F.lit("recommendations").alias("section"), F.lit(60000).alias("o"),
            template(t["recMonitor"], measure=mname).alias("text")))
    recs = (recs.withColumn("seq", F.row_number().over(wo)).where(F.col("seq") <= 4))
    return (summary.select(F.lit("summary").alias("section"), F.lit(1).alias("seq"), "text")
            .unionByName(findings.select("section", F.col("seq").cast("int"), "text"))
            .unionByName(recs.select("section", F.col("seq").cast("int"), "text")))


# ---------------------------------------------------------------- GRD-2/3
def fact_numbers(fact_texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct numbers in the facts: ``(token, v)``."""
    return (fact_texts.select(F.explode(T.numbers(F.col(text_col))).alias("token"))
            .distinct().withColumn("v", F.col("token").try_cast("double")))


def _within_band(v: Column, f: Column) -> Column:
    """Tolerance of GRD-2: ``|v - f| <= max(1, 1% of |f|)``."""
    return F.abs(v - f) <= F.greatest(F.lit(1.0), F.abs(f) * 0.01)


def _magnitude(v: Column) -> Column:
    return F.floor(F.log2(F.greatest(F.abs(v), F.lit(1.0)))).cast("int")


def _cell_width(k: Column) -> Column:
    # a quarter of max(1, 2% of 2^k): at most half the band of any fact in class k
    return F.greatest(F.lit(1.0), F.pow(F.lit(2.0), k) * 0.02) / 4


def band_unsupported(said: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``said`` (numbers ``v``) with no fact ``v`` within its band.

    Exact, without a broadcast and without emitting pairs: facts of
    magnitude class ``k`` (``|f|`` in ``[2^k, 2^k+1)``) are laid on a grid of
    cells narrower than half their band.  A fact lies in one cell and its
    band touches at most a dozen; each touched cell keeps only three
    aggregates — whether a fact lies inside it (then it supports every
    number in the cell), the largest fact left of it and the smallest right
    of it (the only candidates, since both band ends grow with ``f``).  A
    number probes its cell in classes ``k-1..k+1``: three equi-join rows.
    """
    f = facts.select(F.col("v").alias("f")).where(F.col("f").isNotNull()).distinct()
    k = _magnitude(F.col("f"))
    w = F.greatest(F.lit(1.0), F.abs(F.col("f")) * 0.01)
    cells = (f.select("f", k.alias("k"))
             .withColumn("s", _cell_width(F.col("k")))
             .withColumn("cell", F.explode(F.sequence(
                 F.floor((F.col("f") - w) / F.col("s")) - 1,
                 F.floor((F.col("f") + w) / F.col("s")) + 1)))
             .withColumn("a", F.col("cell") * F.col("s")))
    grid = (cells.groupBy("k", "cell")
            .agg(F.max((F.floor(F.col("f") / F.col("s")) == F.col("cell")).cast("int"))
                 .alias("inside"),
                 F.max(F.when(F.col("f") < F.col("a"), F.col("f"))).alias("left"),
                 F.min(F.when(F.col("f") >= F.col("a") + F.col("s"), F.col("f")))
                 .alias("right")))
    kv = _magnitude(F.col("v"))
    probe = (said.withColumn("k", F.explode(F.sequence(kv - 1, kv + 1)))
             .withColumn("cell", F.floor(F.col("v") / _cell_width(F.col("k")))))
    ok = (probe.join(grid, ["k", "cell"])
          .where((F.col("inside") == 1) | _within_band(F.col("v"), F.col("left")) |
                 _within_band(F.col("v"), F.col("right")))
          .select(*keys).distinct())
    return said.join(ok, keys, "left_anti")


def report_numbers(fact_texts: DataFrame) -> Column:
    """The numbers of one report's facts as a literal ``struct(tokens, values)``.

    A report states a handful of figures per KPI, trend and breakdown, so the
    list is bounded by the fact templates, not by the data.
    """
    got = sorted((r["token"], r["v"]) for r in fact_numbers(fact_texts).collect()
                 if r["v"] is not None)
    tokens = F.array(*[F.lit(t) for t, _ in got]).cast("array<string>")
    values = F.array(*[F.lit(v) for _, v in got]).cast("array<double>")
    return F.struct(tokens.alias("tokens"), values.alias("values"))


def unsupported(text: Column, numbers: Column) -> Column:
    """GRD-2 inside the row: the number tokens of ``text`` that no fact supports.

    A number is supported when it equals a fact token, is <= 12, or lies
    within ``max(1, 1% of |fact|)`` of a fact number.
    """
    def bad(token):
        v = token.try_cast("double")
        return ((v > 12) & ~F.array_contains(numbers["tokens"], token)
                & ~F.exists(numbers["values"], lambda f: _within_band(v, f)))
    return F.filter(T.numbers(text), bad)


def ungrounded(claims: DataFrame, fact_texts: DataFrame, id_cols: list[str],
               text_col: str = "text") -> DataFrame:
    """GRD-2: numbers in claims that no fact of a report supports: ``(*id_cols, token)``.

    The test runs inside the claim's row, without a join.
    """
    numbers = report_numbers(fact_texts)
    return claims.select(*id_cols, F.explode(unsupported(F.col(text_col), numbers))
                         .alias("token"))


def ungrounded_by_table(claims: DataFrame, facts: DataFrame, id_cols: list[str],
                        text_col: str = "text") -> DataFrame:
    """GRD-2 against a table of fact texts of any size: the grid join of ``band_unsupported``."""
    said = claims.select(*id_cols, F.explode(T.numbers(F.col(text_col))).alias("token"))
    said = said.withColumn("v", F.col("token").try_cast("double")).where("v > 12")
    nums = fact_numbers(facts)
    said = said.join(nums.select("token"), "token", "left_anti")
    return band_unsupported(said, nums, [*id_cols, "token"]).select(*id_cols, "token")


def strip_ungrounded(claims: DataFrame, fact_texts: DataFrame, id_cols: list[str],
                     text_col: str = "text") -> DataFrame:
    """GRD-3 on single claims: those with an unsupported number are dropped."""
    return claims.where(F.size(unsupported(F.col(text_col), report_numbers(fact_texts))) == 0)


def strip_reply(parsed: DataFrame, numbers: Column) -> DataFrame:
    """GRD-3 on parsed replies: items with a number that is unsupported anywhere in
    the reply go, a summary with one is blanked; ``dropped_claims`` counts both."""
    every = F.concat_ws(" ", F.col("summary"), F.array_join("findings", " "),
                        F.array_join("recommendations", " "))
    bad = unsupported(every, numbers)

    def clean(x):
        return ~F.arrays_overlap(T.numbers(x), F.col("bad_numbers"))
    out = parsed.withColumn("bad_numbers", bad)
    kept = {c: F.filter(F.col(c), clean) for c in ("findings", "recommendations")}
    lost = F.arrays_overlap(T.numbers(F.col("summary")), F.col("bad_numbers"))
    dropped = sum((F.size(c) - F.size(k) for c, k in kept.items()), F.lit(0))
    return (out.withColumn("dropped_claims", (dropped + lost.cast("int")).cast("long"))
            .withColumn("summary", F.when(lost, F.lit("")).otherwise(F.col("summary")))
            .withColumns(kept).drop("bad_numbers"))


# ------------------------------------------------------------------ TXT-4
SECTIONS = ("summary", "findings", "recommendations")


def _blank(name: str) -> Column:
    return F.lit("") if name == "summary" else F.array().cast("array<string>")


def _is_blank(c: Column, name: str) -> Column:
    return F.coalesce((c == "") if name == "summary" else (F.size(c) == 0), F.lit(True))


def _body(columns: dict[str, Column]) -> Column:
    return F.concat_ws(" ", columns["summary"], F.array_join(columns["findings"], " "),
                       F.array_join(columns["recommendations"], " "))


def fallback_fill(parsed: DataFrame, fallback: dict[str, str | list[str]] | None,
                  language: str = "en", sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """TXT-4: complete parsed replies from a narrative fallback.

    ``parsed`` has ``summary, findings array, recommendations array`` and any
    other columns, which stay.  ``fallback`` holds the same three parts (see
    ``fallback_of``).  A reply in the wrong language is replaced by the
    fallback; otherwise only empty sections that the fallback has are filled;
    sections not wanted are blanked.  ``language_ok`` tells the state of what
    is returned, ``used_fallback`` whether anything was taken.
    """
    now = {c: F.col(c) for c in SECTIONS}
    out, used = now, F.lit(False)
    if fallback:
        alt = {c: (F.lit(fallback.get(c) or "") if c == "summary" else
                   F.array(*[F.lit(x) for x in fallback.get(c) or []]).cast("array<string>"))
               for c in SECTIONS}
        ok = T.language_matches(_body(now), language)
        fills = {c: _is_blank(now[c], c) & F.lit(bool(fallback.get(c))) for c in sections}
        out = {c: F.when(~ok | fills[c], alt[c]).otherwise(now[c]) if c in sections
               else _blank(c) for c in SECTIONS}
        used = ~ok
        for c in sections:
            used = used | fills[c]
    out = {c: out[c] if c in sections else _blank(c) for c in SECTIONS}
    rest = [c for c in parsed.columns if c not in SECTIONS]
    return parsed.select(*rest, *[out[c].alias(c) for c in SECTIONS],
                         used.alias("used_fallback"),
                         T.language_matches(_body(out), language).alias("language_ok"))


def fallback_of(told: DataFrame) -> dict[str, str | list[str]]:
    """A narrative (one summary, at most 8 findings and 4 recommendations) as a fallback."""
    rows = sorted((r["section"], r["seq"], r["text"]) for r in told.collect())
    parts = {c: [t for s, _, t in rows if s == c] for c in SECTIONS}
    return {**parts, "summary": " ".join(parts["summary"])}


def reply_pipeline(replies: DataFrame, fact_texts: DataFrame, text_col: str = "text",
                   language: str = "en", fallback: dict | None = None,
                   sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """The chain after a reply: parse, strip ungrounded claims, fall back, blank the unwanted.

    Everything happens inside the reply's row.
    """
    rest = [c for c in replies.columns if c != text_col]
    parsed = replies.select(*rest, T.parse_sections(F.col(text_col)).alias("p")).select(
        *rest, "p.*")
    return fallback_fill(strip_reply(parsed, report_numbers(fact_texts)), fallback, language,
                         sections)
