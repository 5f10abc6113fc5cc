"""Column labels and number formatting as Column expressions (LBL-1..5, FMT-1..3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ARABIC_LETTER, strip_ws

# FIXED VALUES: word dictionary, word -> (Arabic, English).
DICTIONARY: dict[str, tuple[str, str]] = {
    "id": ("المعرف", "ID"), "name": ("الاسم", "Name"), "title": ("العنوان", "Title"),
    "description": ("الوصف", "Description"), "email": ("البريد الإلكتروني", "Email"),
    "phone": ("الهاتف", "Phone"), "address": ("العنوان", "Address"),
    "city": ("المدينة", "City"), "country": ("الدولة", "Country"),
    "region": ("المنطقة", "Region"), "branch": ("الفرع", "Branch"),
    "department": ("القسم", "Department"), "status": ("الحالة", "Status"),
    "type": ("النوع", "Type"), "category": ("الفئة", "Category"),
    "categories": ("الفئات", "Categories"), "item": ("البند", "Item"),
    "items": ("البنود", "Items"), "transaction": ("العملية", "Transaction"),
    "transactions": ("العمليات", "Transactions"), "supplier": ("المورّد", "Supplier"),
    "suppliers": ("الموردون", "Suppliers"), "employees": ("الموظفون", "Employees"),
    "invoices": ("الفواتير", "Invoices"), "payments": ("المدفوعات", "Payments"),
    "branches": ("الفروع", "Branches"), "departments": ("الأقسام", "Departments"),
    "customer": ("العميل", "Customer"), "customers": ("العملاء", "Customers"),
    "client": ("العميل", "Client"), "user": ("المستخدم", "User"),
    "users": ("المستخدمون", "Users"), "subscriber": ("المشترك", "Subscriber"),
    "subscribers": ("المشتركون", "Subscribers"), "employee": ("الموظف", "Employee"),
    "product": ("المنتج", "Product"), "products": ("المنتجات", "Products"),
    "order": ("الطلب", "Order"), "orders": ("الطلبات", "Orders"),
    "invoice": ("الفاتورة", "Invoice"), "payment": ("الدفع", "Payment"),
    "amount": ("القيمة", "Amount"), "total": ("الإجمالي", "Total"),
    "price": ("السعر", "Price"), "cost": ("التكلفة", "Cost"),
    "revenue": ("الإيراد", "Revenue"), "sales": ("المبيعات", "Sales"),
    "profit": ("الربح", "Profit"), "salary": ("الراتب", "Salary"),
    "balance": ("الرصيد", "Balance"), "discount": ("الخصم", "Discount"),
    "tax": ("الضريبة", "Tax"), "quantity": ("الكمية", "Quantity"),
    "qty": ("الكمية", "Quantity"), "count": ("العدد", "Count"),
    "stock": ("المخزون", "Stock"), "units": ("الوحدات", "Units"),
    "date": ("التاريخ", "Date"), "time": ("الوقت", "Time"),
    "created": ("الإنشاء", "Created"), "updated": ("التحديث", "Updated"),
    "registration": ("التسجيل", "Registration"), "shipping": ("الشحن", "Shipping"),
    "delivery": ("التسليم", "Delivery"), "active": ("نشط", "Active"),
    "rating": ("التقييم", "Rating"), "score": ("النتيجة", "Score"),
    "age": ("العمر", "Age"), "gender": ("الجنس", "Gender"),
    "note": ("الملاحظة", "Note"), "notes": ("الملاحظات", "Notes"),
}
# FIXED VALUES: whole-name phrases, words joined by a space -> (Arabic, English).
PHRASES: dict[str, tuple[str, str]] = {
    "total amount": ("قيمة المبيعات", "Sales value"),
    "unit price": ("سعر الوحدة", "Unit price"),
    "order date": ("تاريخ الطلب", "Order date"),
    "created date": ("تاريخ الإنشاء", "Created date"),
    "created at": ("تاريخ الإنشاء", "Created at"),
    "registration date": ("تاريخ التسجيل", "Registration date"),
    "shipping address": ("عنوان الشحن", "Shipping address"),
    "stock quantity": ("الكمية بالمخزون", "Stock quantity"),
    "is active": ("نشط", "Active"),
    "first name": ("الاسم الأول", "First name"),
    "last name": ("اسم العائلة", "Last name"),
    "order items": ("بنود الطلبات", "Order items"),
    "order item": ("بند الطلب", "Order item"),
}
# FIXED VALUES: aggregate prefixes dropped before "total of"/"average of".
AGG_PREFIX = "(?i)^(اجمالي|إجمالي|مجموع|صافي|total|sum|net)\\s+"


def _lookup(table: dict[str, tuple[str, str]], idx: int):
    pairs = []
    for k, v in table.items():
        pairs += [F.lit(k), F.lit(v[idx])]
    m = F.create_map(*pairs)
    return lambda key: F.try_element_at(m, key)


def words(name: Column) -> Column:
    """LBL-1: lower-case words of a snake/camel/kebab name."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    parts = F.split(spaced, "[\\s_\\-.]+")
    return F.transform(F.filter(parts, lambda p: p != ""), F.lower)


def humanize(name: Column, language: str = "en") -> Column:
    """LBL-2: readable label for a column name."""
    idx = 0 if language == "ar" else 1
    word = _lookup(DICTIONARY, idx)
    phrase = _lookup(PHRASES, idx)
    raw = strip_ws(name)
    w = words(raw)
    n = F.size(w)
    core = F.when((n > 1) & (F.element_at(w, -1) == "id"), F.slice(w, 1, n - 1)).otherwise(w)
    known = F.transform(core, word)
    all_known = F.forall(known, lambda x: x.isNotNull())
    pretty = F.array_join(core, " ")
    capital = F.concat(F.upper(F.substring(pretty, 1, 1)), F.substring(pretty, 2, 1 << 30))
    id_core = (n > 1) & (F.element_at(w, -1) == "id")
    return (F.when(raw.rlike(ARABIC_LETTER), raw)
            .when(n == 0, raw)
            .when(phrase(F.array_join(w, " ")).isNotNull(), phrase(F.array_join(w, " ")))
            .when(id_core & phrase(F.array_join(core, " ")).isNotNull(),
                  phrase(F.array_join(core, " ")))
            .when(all_known, F.array_join(known, " "))
            .otherwise(capital))


def label(name: Column, override: Column | None = None, language: str = "en") -> Column:
    """LBL-3: a non-blank user label wins over the automatic one."""
    auto = humanize(name, language)
    if override is None:
        return auto
    return F.coalesce(F.nullif(strip_ws(override), F.lit("")), auto)


def measure_phrase(lbl: Column) -> Column:
    """LBL-4: drop a leading aggregate word ("Total sales" -> "sales")."""
    t = strip_ws(lbl)
    cut = F.regexp_replace(t, AGG_PREFIX, "")
    return F.when(cut == "", lbl).otherwise(cut)


def categories_word(count: Column, language: str = "en") -> Column:
    """LBL-5: plural of "category" (Arabic uses the plural for 3..10)."""
    if language == "ar":
        return F.when((count >= 3) & (count <= 10), "فئات").otherwise("فئة")
    return F.when(count == 1, "category").otherwise("categories")


# ------------------------------------------------------------------ FMT-1..3
def fmt_number(v: Column) -> Column:
    """FMT-1: thousands separators, at most 2 decimals, trailing zeros cut, '—' for null.

    Whole numbers and decimals keep all their digits.
    """
    two = F.format_number(v, 2)
    return F.when(v.isNull(), F.lit("—")).otherwise(
        F.regexp_replace(F.regexp_replace(two, "0+$", ""), "\\.$", ""))


def fmt_compact(v: Column) -> Column:
    """FMT-2: 1.49M / 2.5B with 2 decimals, >= 1000 without decimals."""
    d = v.cast("double")
    a = F.abs(d)

    def strip(x):
        return F.regexp_replace(F.regexp_replace(x, "0+$", ""), "\\.$", "")
    return (F.when(v.isNull(), F.lit("—"))
            .when(a >= 1e9, F.concat(strip(F.format_number(d / 1e9, 2)), F.lit("B")))
            .when(a >= 1e6, F.concat(strip(F.format_number(d / 1e6, 2)), F.lit("M")))
            .when(a >= 1000, F.format_number(d, 0))
            .otherwise(fmt_number(d)))


def py_number(v: Column, integral: bool | Column = False) -> Column:
    """Text of a number as Python prints it after 2-dp rounding: ``1234.5``,
    ``5.0`` (floats) or ``1234`` (integers)."""
    flt = F.regexp_replace(F.replace(F.format_number(v.cast("double"), 2), F.lit(","),
                                     F.lit("")), "(\\.[0-9])0$", "$1")
    intg = F.replace(F.format_number(v.cast("double"), 0), F.lit(","), F.lit(""))
    is_int = F.lit(integral) if isinstance(integral, bool) else integral
    return F.when(v.isNull(), F.lit("None")).when(is_int, intg).otherwise(flt)


def py_digits(v: Column, integral: bool | Column = False) -> Column:
    """:func:`py_number` of a decimal, with all its digits; null stays null."""
    is_int = F.lit(integral) if isinstance(integral, bool) else integral
    two = F.regexp_replace(F.round(v, 2).cast("decimal(38,2)").cast("string"),
                           "(\\.[0-9])0$", "$1")
    return F.when(is_int, F.round(v, 0).cast("decimal(38,0)").cast("string")).otherwise(two)


def clean_title(raw: Column, fallback: Column | str = "report") -> Column:
    """FMT-3: drop a file extension (with download suffix) and a copy number."""
    t = F.regexp_replace(strip_ws(raw), "(?i)\\.(csv|xlsx?|json)(-\\d+)?$", "")
    t = F.regexp_replace(t, "\\s*\\(\\d+\\)$", "")
    t = F.regexp_replace(t, "^[ \\-_·]+|[ \\-_·]+$", "")
    fb = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.when(t == "", fb).otherwise(t)
