import io
import os
import random
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tabsense.errors import TabsenseError
from tabsense.operators import clean as CL
from tabsense.plans.analyze import analyze, metrics_long
from tabsense.sources import files as SF
from tabsense.sources import sinks as SK
from tabsense.sources import workbook as WB


def _cell(ref, v):
    if isinstance(v, str):
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    return f'<c r="{ref}"><v>{v}</v></c>'


def write_xlsx(path, sheets):
    """Minimal .xlsx writer for fixtures: {sheet name: list of rows (None = blank row)}."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        book = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>'
                       for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f"<workbook {ns} {rns}><sheets>{book}</sheets></workbook>")
        rels = "".join(
            f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml" Type="ws"/>'
            for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/'
                   f'relationships">{rels}</Relationships>')
        for i, rows in enumerate(sheets.values()):
            body = ""
            for r, row in enumerate(rows, 1):
                if row is None:
                    continue
                cells = "".join(_cell(f"{chr(65 + j)}{r}", v) for j, v in enumerate(row)
                                if v is not None)
                body += f'<row r="{r}">{cells}</row>'
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml",
                       f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_workbook_header_pick_and_sheets(spark, tmp_path):
    d = tmp_path / "books"
    d.mkdir()
    write_xlsx(d / "report.xlsx", {
        "Sales": [["Quarterly report"], None, ["المدينة", "total_amount"],
                  ["الرياض", 100], ["جدة", 250], ["الدمام", 75]],
        "Staff": [["department", "salary"], ["ops", 10], ["it", 20], ["hr", 30]],
        " ": [["x"]],
    })
    frames = WB.sheet_frames(WB.read_workbook_rows(spark, str(d)))
    keys = sorted(k[1] for k in frames)
    assert "Sales" in keys and "Staff" in keys
    sales = next(v for k, v in frames.items() if k[1] == "Sales")
    assert sales.columns == ["المدينة", "total_amount"]
    assert sorted(r["total_amount"] for r in sales.collect()) == [75.0, 100.0, 250.0]


def test_csv_and_json_sources(spark, tmp_path):
    p = tmp_path / "up.csv"
    p.write_text("city,amount,Unnamed: 2\nRiyadh,10,\nJeddah,20,\n,,\n")
    df = SF.read_csv(spark, str(p))
    assert df.columns == ["city", "amount"] and df.count() == 2
    j = tmp_path / "up.json"
    j.write_text('[{"city": "Riyadh", "amount": 10}, {"city": "Jeddah", "amount": 20}]')
    assert SF.read_json_records(spark, str(j)).count() == 2


def test_source_selection(spark):
    t = {"a": spark.range(1), "b": spark.range(2)}
    assert list(SF.select_sources(t)) == ["a", "b"]
    with pytest.raises(TabsenseError):
        SF.select_sources(t, ["zzz"])


def test_clean_helpers(spark):
    assert CL.clean_header("القيمة في ال\nشهر") == "القيمة في الشهر"
    assert CL.clean_header("  Unit   price ") == "Unit price"
    df = spark.createDataFrame([("2025-01-02", "x"), ("03/04/2025", None), ("", "y")],
                               "d string, t string")
    out = CL.promote_text_dates(df)
    assert dict(out.dtypes)["d"] == "timestamp_ntz" and dict(out.dtypes)["t"] == "string"


def test_jdbc_round_trip(spark):
    url = "jdbc:derby:memory:tabsense;create=true"
    props = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    try:
        spark.range(100).selectExpr("id", "id * 2 AS v").write.mode("overwrite") \
            .format("jdbc").option("url", url).option("dbtable", "T1") \
            .option("driver", props["driver"]).save()
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no in-memory JDBC driver available: {str(e)[:80]}")
    df = SF.read_jdbc(spark, url, "T1", props, partition_column="ID", lower_bound=0,
                      upper_bound=100, num_partitions=4)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 100


def test_sinks_and_registry(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "k string, v double")
    SK.export_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    m = metrics_long(analyze(df, {"measure": "v", "dimensions": ["k"]}))
    SK.export_metrics(m, str(tmp_path / "metrics"))
    reg = SK.ReportRegistry(spark, str(tmp_path / "reports"))
    reg.save("r1", {"title": "one", "created_at": "2025-01-01"}, {"metrics": m})
    reg.save("r2", {"title": "two", "created_at": "2025-02-01"}, {"metrics": m})
    assert [r["report_id"] for r in reg.list().collect()] == ["r2", "r1"]
    reg.delete("r1")
    assert [r["report_id"] for r in reg.list().collect()] == ["r2"]
    assert reg.output("r2", "metrics").count() == m.count()


def test_pages_by_key_continue_pages_by_offset(spark):
    from tabsense.operators import browse as BR
    rows = [(i % 13, f"v{(i * 7919) % 500}", None if i % 11 == 0 else i * 0.5)
            for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b string, c double").repartition(6)
    for order_by, direction in [("a", "desc"), ("c", "asc"), ("c", "desc"), (None, "asc")]:
        whole = [tuple(r) for r in BR.page(df, 500, 0, order_by, direction).collect()]
        for at in (0, 36, 453, 498):
            last = dict(zip(df.columns, whole[at]))
            got = BR.page_after(df, last, 25, order_by, direction).collect()
            assert [tuple(r) for r in got] == whole[at + 1:at + 26]
        assert [tuple(r) for r in BR.page(df, 7, 100, order_by, direction).collect()] \
            == whole[100:107]


def test_csv_round_trip_of_quotes_and_line_breaks(spark, tmp_path):
    rows = [('a "b" c, d', 1), ("two\nlines", 2), ("plain", 3), ('"', 4), ("back\\slash", 5)]
    df = spark.createDataFrame(rows, "s string, n int")
    SK.export_csv(df, str(tmp_path / "q"))
    back = SF.read_csv(spark, str(tmp_path / "q"), "s string, n int")
    assert sorted(map(tuple, back.collect()), key=lambda r: r[1]) == rows


def test_read_file_by_kind(spark, tmp_path):
    (tmp_path / "t.csv").write_text("city,amount\nNA,1\nRome,n/a\n")
    got = [tuple(r) for r in SF.read_file(spark, str(tmp_path / "t.csv")).collect()]
    assert sorted(got, key=str) == [("Rome", None), (None, "1")]
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "t.txt").write_text("x")
    for name, code in (("e.csv", "emptyFile"), ("t.txt", "unsupportedFormat")):
        with pytest.raises(TabsenseError) as e:
            SF.read_file(spark, str(tmp_path / name))
        assert e.value.code == code


def test_registry_ids_stay_text_and_cannot_leave_the_folder(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    reg = SK.ReportRegistry(spark, str(tmp_path / "reports"))
    for rid in ("0012", "12e3"):
        reg.save(rid, {"title": rid}, {"m": df})
    assert sorted(r["report_id"] for r in reg.list().collect()) == ["0012", "12e3"]
    reg.delete("0012")
    reg.delete("12e3")
    assert reg.list().collect() == []
    for bad in ("../x", "a/b", "", ".."):
        with pytest.raises(TabsenseError):
            reg.delete(bad)


def test_too_many_tables_is_an_error_not_a_cut(spark):
    tables = {f"t{i}": spark.range(1) for i in range(25)}
    assert len(SF.select_sources(tables)) == 25
    with pytest.raises(TabsenseError) as e:
        SF.select_sources(tables, most=20)
    assert e.value.code == "tooManyTables"


def test_import_counts_what_it_wrote(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS imported_t")
    try:
        made = SK.import_table(spark, spark.range(7), "imported_t", "create")
        assert made.first()["rows"] == 7 and spark.table("imported_t").count() == 7
    finally:
        spark.sql("DROP TABLE IF EXISTS imported_t")


def test_headers_that_clean_to_one_name_and_ambiguous_dates(spark):
    from tabsense.operators import clean as CL
    df = spark.createDataFrame([("1", "2", "03/04/2025"), ("3", "4", "25/12/2024")],
                               ["a  b", "a b", "day"])
    out = CL.promote_text_dates(CL.clean_frame(df))
    assert out.columns == ["a b", "a b_2", "day"]
    assert [str(r["day"])[:10] for r in out.orderBy("a b").collect()] == ["2025-03-04", "2024-12-25"]


def test_text_dates_make_a_trend(spark):
    rows = [(f"2025-{1 + i % 6:02d}-{1 + i % 28:02d}", f"c{i % 3}", 10.0 + i) for i in range(120)]
    a = analyze(spark.createDataFrame(rows, "order_day string, city string, amount double"))
    assert a.choice.date == "order_day" and a.trend.count() >= 2


def test_one_bin_is_no_trend(spark):
    import datetime as dt
    rows = [(dt.datetime(2025, 1, 1), 1.0), (dt.datetime(2025, 1, 1), 2.0)]
    a = analyze(spark.createDataFrame(rows, "day timestamp, amount double"))
    assert "trend" not in {r["metric"] for r in metrics_long(a).collect()}


@pytest.fixture
def small_blocks(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes",
                                           "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "90")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(4))
def test_csv_in_blocks_equals_the_one_task_reader(spark, tmp_path, small_blocks, seed):
    rnd = random.Random(seed)
    end = "\r\n" if seed == 3 else "\n"

    def value():
        v = "".join(rnd.choice(["a", "bc", ",", "\"", "\n", " ", "é", "1", "\n\n"])
                    for _ in range(rnd.randint(0, 12)))
        if seed == 3:
            v = v.replace("\n", " ")
        return '"' + v.replace('"', '""') + '"' if set(v) & set(',"\n') else v
    for f in range(3):
        rows = ["id,text,more"] + [f"{f}{i:03d},{value()},{value()}" for i in range(60)]
        if seed == 2:
            rows[7:7] = ['8888,5" pipe,x', "", '9999,"two\n\nlines",""']
        (tmp_path / f"part-{f}.csv").write_bytes((end.join(rows) + end).encode())
    schema = "id int, text string, more string"
    got = SF.read_csv(spark, str(tmp_path), schema, clean=False)
    want = (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').csv(str(tmp_path)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.rdd.getNumPartitions() <= 3
    lines = spark.read.text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 12           # a block a task


def test_csv_blocks_infer_types_and_take_odd_files(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text("\ufeffid,when,text\n" + "".join(
        f'{i},2024-01-{i % 28 + 1:02d},"line\n{i}"\n' for i in range(50)))
    df = SF.read_csv(spark, str(tmp_path / "a.csv"), clean=False)
    assert df.dtypes == [("id", "int"), ("when", "date"), ("text", "string")]
    assert df.count() == 50 and df.agg(F.sum("id")).first()[0] == sum(range(50))
    (tmp_path / "h.csv").write_text("a,b\n")
    assert SF.read_csv(spark, str(tmp_path / "h.csv"), clean=False).columns == ["a", "b"]
    (tmp_path / "open.csv").write_text('a,b\n1,"never\nclosed\n2,x\n')
    assert SF.read_csv(spark, str(tmp_path / "open.csv"), "a int, b string",
                       clean=False).first()["a"] == 1
    (tmp_path / "long.csv").write_text('a,b\n1,"' + 'x""\n' * 40_000 + '"\n2,' + "y" * 200_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    got = {r["a"]: len(r["b"]) for r in SF.read_csv(
        spark, str(tmp_path / "long.csv"), "a int, b string", clean=False).collect()}
    assert got == {1: 3 * 40_000, 2: 200_000}
