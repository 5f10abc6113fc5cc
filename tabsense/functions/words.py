"""Fixed word lists and thresholds.

FIXED VALUES — these must stay equal to the behaviour being reproduced
(column-name hints, identifier tokens, caps and ratios). They are data, not
logic; the rules that use them live in ``operators/semantics.py``.
"""

# ---- FIXED VALUES: column-name hints (substring match on the lower-cased name)
MEASURE_HINTS = ("amount", "total", "price", "revenue", "sales", "cost", "value",
                 "salary", "profit", "balance", "قيمة", "مبلغ", "سعر", "إجمالي",
                 "ايراد", "إيراد", "مبيعات", "راتب", "تكلفة")
COUNT_HINTS = ("qty", "quantity", "count", "units", "stock", "عدد", "كمية", "مخزون")
AGGREGATE_HINTS = ("اجمالي", "إجمالي", "مجموع", "total", "sum", "net", "صافي")
RATE_HINTS = ("في الساعة", "بالساعة", "لكل", "معدل", "نسبة", "متوسط", "سعر",
              " per ", "per_", "_per", "rate", "ratio", "percent", "price",
              "avg", "average")
DIM_HINTS = ("city", "country", "region", "category", "type", "status", "state",
             "name", "product", "customer", "branch", "department", "gender",
             "مدينة", "دولة", "منطقة", "فئة", "نوع", "حالة", "اسم", "قسم", "فرع")
NON_DIM_HINTS = ("email", "mail", "phone", "mobile", "address", "description",
                 "note", "comment", "url", "link", "password",
                 "بريد", "هاتف", "جوال", "عنوان", "وصف", "ملاحظ", "رابط")
# ---- FIXED VALUES: whole tokens that mark an identifier column
ID_TOKENS = ("id", "code", "codes", "serial", "barcode", "sku", "no", "num", "number",
             "رقم", "الرقم", "ارقام", "أرقام", "كود", "الكود", "رمز", "الرمز",
             "معرف", "المعرف", "هوية", "الهوية", "تسلسل", "التسلسل", "بطاقة")
# ---- FIXED VALUES: caps and ratios
TOP_N = 8                    # groups shown in a breakdown (9 when exactly 9 exist)
MAX_TREND_POINTS = 24        # trend tail length
MAX_DIM_CATEGORIES = 30      # a dimension has at most this many categories
MIN_ROWS_FOR_RATIO = 20      # uniqueness ratios are ignored below this many rows
NEAR_UNIQUE_RATIO = 0.95     # integer column this unique is an identifier
REPETITIVE_RATIO = 0.6       # a dimension repeats: distinct/non-null <= this
MIN_EDGE_SHARE = 0.35        # edge bin below this share of the median count is trimmed
MONTH_SPAN_DAYS = 70         # trend uses month bins above this span, else days
CORRELATION_CUT = 0.5        # |r| kept in the profile
PROFILE_TOP_VALUES = 10      # most frequent values per categorical column
PROFILE_BAR_MAX_DISTINCT = 30
HISTOGRAM_MIN_DISTINCT = 5
HISTOGRAM_MIN_BINS, HISTOGRAM_MAX_BINS = 5, 12
SAMPLE_ROWS = 10
BROWSE_ROW_LIMIT = 500       # interactive page cap and SQL auto-limit
LOG_MAX_ENTRIES = 500        # non-favourite query-log entries kept
HEADER_SCAN_ROWS = 6         # rows scanned for a workbook header
COVERAGE_FULL_PCT = 95       # below this a breakdown is flagged as partial
CONCENTRATION_PCT = 50       # leader share that counts as concentration
