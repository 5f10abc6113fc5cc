import pytest
from pyspark.sql import functions as F

from tabsense.errors import NotFound, TabsenseError
from tabsense.operators import changes as CH
from tabsense.operators import oplog as LG

BATCH = "seq long, op string, set_cols array<string>, id long, name string, price double"


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)],
                                 "id long, name string, price double")


def test_sequential_batch(spark, base):
    batch = spark.createDataFrame([
        (1, "update", ["price"], 1, None, 10.0),
        (2, "update", ["name"], 1, "A", None),
        (3, "delete", [], 2, None, None),
        (4, "insert", [], 4, "d", 4.0),
        (5, "update", ["price"], 4, None, 40.0),
        (6, "insert", [], 5, "e", 5.0),
        (7, "delete", [], 5, None, None),
        (8, "update", ["price"], 9, None, 9.0),       # missing key: no-op
    ], BATCH)
    got = sorted(tuple(r) for r in CH.apply_changes(base, batch, ["id"]).collect())
    assert got == [(1, "A", 10.0), (3, "c", 3.0), (4, "d", 40.0)]
    c = CH.change_counts(base, batch, ["id"]).first()
    assert (c["inserted"], c["updated"], c["deleted"]) == (1, 1, 1)


def test_hot_key_batch(spark, base):
    # one key receives most of the batch: folded by aggregation, last update wins
    rows = [(i, "update", ["price"], 1, None, float(i)) for i in range(1, 3001)]
    rows += [(i, "update", ["price"], 2, None, float(i)) for i in range(1, 11)]
    batch = spark.createDataFrame(rows, BATCH)
    got = {r["id"]: r["price"] for r in CH.apply_changes(base, batch, ["id"]).collect()}
    assert got == {1: 3000.0, 2: 10.0, 3: 3.0}


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_batch_on_null_and_repeated_keys(spark, threshold):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        base = spark.createDataFrame(
            [(1, "a", 1.0), (1, "a2", 1.5), (2, "b", 2.0), (2, "b", 2.0), (3, "c", 3.0),
             (3, "c2", None), (None, "n", 0.0)], "id int, name string, price double")
        batch = spark.createDataFrame([
            (1, "update", ["price"], 1, None, 10.0),
            (2, "insert", [], 2, "B", 20.0),           # replaces both rows
            (3, "delete", [], 3, None, None),
            (4, "insert", [], 4, "d", 4.0),
            (5, "update", ["name"], 4, None, None),    # sets a null
            (6, "insert", [], 5, "e", 5.0),
            (7, "delete", [], 5, None, None),
            (8, "update", ["name"], 5, "late", None),  # the key is gone
            (9, "insert", [], None, "new", 9.0),       # a null key meets no row
            (10, "update", ["price"], None, None, 90.0),
            (None, "delete", [], 1, None, None),       # no place in the order
            (11, "update", None, 1, "x", None),        # sets nothing
        ], BATCH)
        for keys in (base, base.withColumn("id", F.col("id").cast("long"))):
            got = sorted(map(str, (tuple(r) for r in CH.apply_changes(
                keys, batch, ["id"]).collect())))
            assert got == sorted(map(str, [
                (1, "a", 10.0), (1, "a2", 10.0), (2, "B", 20.0), (2, "B", 20.0),
                (4, None, 4.0), (None, "n", 0.0), (None, "new", 90.0)]))
            c = CH.change_counts(keys, batch, ["id"]).first()
            assert (c["inserted"], c["updated"], c["deleted"]) == (2, 2, 1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_inserted_keys_that_the_base_type_rounds(spark):
    base = spark.createDataFrame([(1, "a")], "id long, name string")
    batch = spark.createDataFrame([(1, "insert", [], 1.0, "A"), (2, "insert", [], 7.5, "b")],
                                  "seq long, op string, set_cols array<string>, id double, "
                                  "name string")
    got = sorted(tuple(r) for r in CH.apply_changes(base, batch, ["id"]).collect())
    assert got == [(1, "A"), (7, "b")]


def test_insert_update_delete_helpers(spark, base):
    ins = CH.insert_rows(base, spark.createDataFrame([(7, "g")], "id long, name string"))
    assert ins.count() == 4
    upd = CH.update_rows(base, ["id"], spark.createDataFrame([(2, 20.0)], "id long, price double"))
    assert {r["id"]: r["price"] for r in upd.collect()}[2] == 20.0
    dele = CH.delete_rows(base, ["id"], spark.createDataFrame([(3,)], "id long"))
    assert sorted(r["id"] for r in dele.collect()) == [1, 2]


def test_change_errors(spark, base):
    with pytest.raises(TabsenseError) as e:
        CH.insert_rows(base, spark.createDataFrame([(1,)], "nope long"))
    assert e.value.code == "unknownColumns"
    with pytest.raises(TabsenseError) as e:
        CH.update_rows(base, [], spark.createDataFrame([(1, 1.0)], "id long, price double"))
    assert e.value.code == "noPrimaryKey"
    with pytest.raises(TabsenseError) as e:
        CH.update_rows(base, ["id", "name"], spark.createDataFrame([(1, 1.0)],
                                                                   "id long, price double"))
    assert e.value.code == "incompletePrimaryKey"


@pytest.fixture(scope="module")
def log(spark):
    rows = [(i, None, f"SELECT {i}", "read", "editor", None, 0, True, f"t{i}", i in (2, 5))
            for i in range(1, 12)]
    return spark.createDataFrame(rows, LG.LOG_SCHEMA)


def test_retention_keeps_favourites(log):
    kept = sorted(r["id"] for r in LG.retain(log, keep=3).collect())
    assert kept == [2, 5, 9, 10, 11]


def test_recent_and_clear(log):
    assert [r["id"] for r in LG.recent(log, 3).collect()] == [11, 10, 9]
    assert [r["id"] for r in LG.recent(log, 5, favorites_only=True).collect()] == [5, 2]
    assert LG.cleared_count(log).first()["deleted"] == 9
    assert sorted(r["id"] for r in LG.clear(log).collect()) == [2, 5]


def test_log_entry_errors(log):
    with pytest.raises(NotFound):
        LG.delete_entry(log, 99)
    fav = LG.set_favorite(log, 3, True)
    assert fav.where(F.col("favorite")).count() == 3


def test_edge_check_counts_orphans_with_hot_and_null_keys(spark):
    from tabsense.operators import catalog as C
    # key 1 holds a third of the child rows; nulls are never orphans
    child = spark.createDataFrame([(1, "a")] * 40 + [(i, "b") for i in range(2, 82)] +
                                  [(None, "c")] * 5, "pk int, x string")
    parent = spark.createDataFrame([(i,) for i in range(1, 60)] + [(1,), (3,)], "id int")
    got = C.edge_check({"c": child, "p": parent},
                       [C.Edge("c", ("pk",), "p", ("id",))]).collect()
    assert [(r["child_rows"], r["orphans"]) for r in got] == [(125, 22)]


def test_unmarked_favourites_survive_retention(spark):
    log = spark.createDataFrame([(1, None), (2, True), (3, False)], "id long, favorite boolean")
    from tabsense.operators import oplog
    assert {r["id"] for r in oplog.retain(log, 5).collect()} == {1, 2, 3}
    assert oplog.cleared_count(log).first()["deleted"] == 2


def test_an_update_key_given_twice_is_rejected(spark):
    import pytest
    from tabsense.errors import TabsenseError
    from tabsense.operators import changes
    base = spark.createDataFrame([(1, "a")], "id int, v string")
    twice = spark.createDataFrame([(1, "b"), (1, "c")], "id int, v string")
    with pytest.raises(TabsenseError) as e:
        changes.update_rows(base, ["id"], twice)
    assert e.value.code == "duplicateKeys"


def test_overview_of_a_map_column(spark):
    from tabsense.operators import profile
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1) "
                   "UNION ALL SELECT map('a', 3)")
    row = profile.overview(df).first()
    assert row["rows"] == 3 and row["duplicate_rows"] == 1


def test_stored_log_rewrites_one_part(spark, tmp_path):
    import os
    from tabsense.errors import NotFound, WriteBlocked
    from tabsense.plans.guarded_sql import guarded_sql
    log = LG.StoredLog(spark, str(tmp_path / "log"), per_part=10)
    assert log.read().collect() == []
    rows = [(i, "r", f"SELECT {i}", "read", "editor", None, i, True, "2024", i % 4 == 0)
            for i in range(1, 26)]
    log.append(spark.createDataFrame(rows, LG.LOG_SCHEMA))

    def files():
        return {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path)
                for f in fs if f.endswith(".parquet")}
    before = files()
    log.delete(12)
    log.favorite(13)
    after = files()
    kept = set(before) & set(after)
    assert kept and all(before[f] == after[f] for f in kept)
    got = {r["id"]: r["favorite"] for r in log.read().collect()}
    assert sorted(got) == [i for i in range(1, 26) if i != 12] and got[13] and not got[14]
    for i in range(20, 26):                                  # a part without entries is gone
        log.delete(i)
    assert max(r["id"] for r in log.read().collect()) == 19
    with pytest.raises(NotFound):
        log.delete(12)
    # runs: a blocked write leaves no record, a failure says so
    with pytest.raises(WriteBlocked):
        guarded_sql(spark, "DROP VIEW nothing", log=log)
    with pytest.raises(Exception):
        guarded_sql(spark, "SELECT * FROM no_such_table", log=log)
    guarded_sql(spark, "SELECT 1 AS x", log=log, request="one")
    new = {r["id"]: (r["request"], r["success"]) for r in log.read().where("id > 19").collect()}
    assert new == {20: ("", False), 21: ("one", True)}


def test_entries_without_an_id_stay(spark):
    log = spark.createDataFrame([(1, False), (None, False)], "id long, favorite boolean")
    assert [r["id"] for r in LG.delete_entry(log, 1).collect()] == [None]
