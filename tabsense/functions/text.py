"""Text column functions (SQL-4, TXT-1..3, GRD-1).

All are Column -> Column expressions built from Spark's regex and
higher-order array functions, so they run inside whole-stage codegen over
any number of rows (no Python UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line breaks as Python's str.splitlines sees them.
LINE_BREAK = "\\r\\n|[\\n\\r\\u000B\\u000C\\u001C\\u001D\\u001E\\u0085\\u2028\\u2029]"
ARABIC_LETTER = "[\\u0600-\\u06FF]"
# FIXED VALUES: Arabic-Indic and Extended Arabic-Indic digits, then ASCII.
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "01234567890123456789"


def strip_ws(c: Column) -> Column:
    """Trim all whitespace (not only spaces) at both ends."""
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


# ------------------------------------------------------------------ SQL-4
def extract_sql(reply: Column) -> Column:
    """First fenced block (```sql optional) else the whole reply; blank and
    ``--`` lines dropped; surrounding whitespace and trailing ``;`` removed."""
    fenced = F.regexp_extract(reply, "(?is)```(?:sql)?\\s*(.+?)```", 1)
    body = F.when(fenced == "", reply).otherwise(fenced)
    kept = F.filter(lines(body), lambda ln: (strip_ws(ln) != "") &
                    ~strip_ws(ln).startswith("--"))
    return F.regexp_replace(strip_ws(F.array_join(kept, "\n")), ";+$", "")


# ---------------------------------------------------------------- TXT-1/2
def humanize(c: Column) -> Column:
    """TXT-2: unwrap ``[x]`` (1-60 chars), drop ``**``, trim."""
    return strip_ws(F.replace(F.regexp_replace(c, "\\[([^\\[\\]]{1,60})\\]", "$1"),
                              F.lit("**"), F.lit("")))


def section(text: Column, name: str) -> Column:
    """Body of ``## NAME`` up to the next ``##`` heading, trimmed ('' if absent)."""
    pat = f"(?is)##\\s*{name}\\s*\\n(.*?)(?=\\n##\\s|\\z)"
    return strip_ws(F.regexp_extract(text, pat, 1))


def bullets(block: Column) -> Column:
    """Lines starting with ``-``, ``*`` or ``•``, markers and stray ``*`` removed."""
    trimmed = F.transform(lines(block), strip_ws)
    marked = F.filter(trimmed, lambda ln: ln.rlike("^[-*•]"))
    cleaned = F.transform(marked, lambda ln: F.regexp_replace(
        strip_ws(F.regexp_replace(ln, "^[-*• ]+", "")), "^\\*+|\\*+$", ""))
    return F.filter(cleaned, lambda ln: ln != "")


def parse_sections(text: Column) -> Column:
    """TXT-1: ``struct(summary, findings, recommendations)``; no sections at
    all means the whole text is the summary."""
    summary = humanize(section(text, "SUMMARY"))
    findings = F.transform(bullets(section(text, "FINDINGS")), humanize)
    recs = F.transform(bullets(section(text, "RECOMMENDATIONS")), humanize)
    empty = (summary == "") & (F.size(findings) == 0)
    return F.struct(F.when(empty, humanize(text)).otherwise(summary).alias("summary"),
                    findings.alias("findings"), recs.alias("recommendations"))


# ------------------------------------------------------------------ TXT-3
def arabic_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(ARABIC_LETTER))


def latin_letters(text: Column) -> Column:
    """Letters inside Latin words of three or more letters."""
    return F.length(F.array_join(F.regexp_extract_all(text, F.lit("([A-Za-z]{3,})"), 1), ""))


def detect_language(text: Column) -> Column:
    return F.when(arabic_letters(text) > latin_letters(text), "ar").otherwise("en")


def language_matches(body: Column, language: Column | str) -> Column:
    """True when the body is in ``language`` (ar vs anything else), or too
    short (< 30 chars after trimming) to judge."""
    lang = F.lit(language) if isinstance(language, str) else language
    want = F.when(lang == "ar", "ar").otherwise("en")
    b = strip_ws(body)
    return (F.length(b) < 30) | (detect_language(b) == want)


# ------------------------------------------------------------------ GRD-1
def numbers(text: Column) -> Column:
    """GRD-1: distinct number tokens ``\\d[\\d,]*\\.?\\d*`` with commas and a
    trailing dot removed (Arabic-Indic digits read as ASCII)."""
    t = F.translate(text, ARABIC_DIGITS, ASCII_DIGITS)
    raw = F.regexp_extract_all(t, F.lit("([0-9][0-9,]*\\.?[0-9]*)"), 1)
    cleaned = F.transform(raw, lambda x: F.regexp_replace(F.replace(x, F.lit(","), F.lit("")),
                                                          "\\.$", ""))
    return F.array_distinct(F.filter(cleaned, lambda x: x != ""))
