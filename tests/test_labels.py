import pytest
from pyspark.sql import functions as F

from tabsense.functions import labels as L


def apply(spark, fn, values, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_humanize_english(spark):
    names = ["total_amount", "customer_id", "city", "shipping_address", "unitPrice",
             "order-date", "xyz_qq", "رقم المرجع"]
    assert apply(spark, lambda c: L.humanize(c, "en"), names) == [
        "Sales value", "Customer", "City", "Shipping address", "Unit price", "Order date",
        "Xyz qq", "رقم المرجع"]


def test_humanize_arabic(spark):
    assert apply(spark, lambda c: L.humanize(c, "ar"), ["city", "total_amount"]) == [
        "المدينة", "قيمة المبيعات"]


def test_override_label(spark):
    df = spark.createDataFrame([("city", "  "), ("city", "Town")], "n string, o string")
    got = [r[0] for r in df.select(L.label(F.col("n"), F.col("o"))).collect()]
    assert got == ["City", "Town"]


def test_measure_phrase_and_plural(spark):
    assert apply(spark, L.measure_phrase, ["Total sales", "إجمالي التكلفة", "sales"]) == [
        "sales", "التكلفة", "sales"]
    df = spark.createDataFrame([(1,), (5,), (12,)], "n int")
    assert [r[0] for r in df.select(L.categories_word(F.col("n"), "ar")).collect()] == [
        "فئة", "فئات", "فئة"]


@pytest.mark.parametrize("v,plain,compact", [
    (1486390.0, "1,486,390", "1.49M"), (204700.28, "204,700.28", "204,700"),
    (2.5e9, "2,500,000,000", "2.5B"), (12.5, "12.5", "12.5"), (None, "—", "—")])
def test_formats(spark, v, plain, compact):
    df = spark.createDataFrame([(v,)], "v double")
    r = df.select(L.fmt_number(F.col("v")), L.fmt_compact(F.col("v"))).first()
    assert (r[0], r[1]) == (plain, compact)


def test_clean_title(spark):
    assert apply(spark, L.clean_title, ["تقرير.XLSX-2", "sales (3).csv", " - .json"]) == [
        "تقرير", "sales", "report"]


def test_labels_of_names_in_rows_with_user_labels(spark):
    from tabsense.operators.labelling import labelled
    names = spark.createDataFrame([("customer_id",)] * 3 + [("unitPrice",), (None,), ("",),
                                  ("رقم المرجع",), ("odd name",)], "n string")
    given = spark.createDataFrame([("customer_id", "  Buyer "), ("unitPrice", "   "),
                                   ("nobody", "x")], "name string, label string")
    out = {r["name"]: r for r in labelled(names, "n", given).collect()}
    assert len(out) == 6 and out["customer_id"]["rows"] == 3
    assert (out["customer_id"]["label_en"], out["customer_id"]["overridden"]) == ("Buyer", True)
    assert out["unitPrice"]["label_en"] == "Unit price" and not out["unitPrice"]["overridden"]
    assert out["رقم المرجع"]["label_en"] == "رقم المرجع"
    assert out["odd name"]["label_en"] == "Odd name"
    assert out[None]["label_en"] is None
    auto = {r["name"]: r["label_en"] for r in labelled(names, "n").collect()}
    assert auto["customer_id"] != "Buyer"
