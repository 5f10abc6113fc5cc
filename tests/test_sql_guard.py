"""The SQL guard: classes, and above all effects (a blocked statement does nothing)."""

import os

import pytest

from tabsense.errors import TabsenseError, WriteBlocked
from tabsense.plans import guarded_sql as G


@pytest.fixture(scope="module", autouse=True)
def views(spark):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string") \
        .createOrReplaceTempView("customers")
    spark.range(3).createOrReplaceTempView("points")


READS = [
    "SELECT id FROM points WHERE id > 1",
    "FROM points SELECT id",
    "WITH big AS (SELECT id FROM points) SELECT count(*) FROM big",
    "SELECT * FROM (VALUES (1), (2)) AS v(x)",
    "SELECT id, row_number() OVER (ORDER BY id) FROM points",
    "SELECT id FROM points UNION ALL SELECT id FROM customers ORDER BY 1",
    "SELECT id FROM points INTERSECT SELECT id FROM customers",
    "SELECT id % 2, count(*) FROM points GROUP BY 1 HAVING count(*) > 0",
    "SELECT c.id FROM customers c JOIN points p ON c.id = p.id",
    "SELECT id FROM points WHERE EXISTS (SELECT 1 FROM customers c WHERE c.id = points.id)",
    "SELECT x FROM points LATERAL VIEW explode(array(1, 2)) e AS x",
    "SELECT p.id, s.n FROM points p, LATERAL (SELECT count(*) n FROM customers) s",
    "SELECT * FROM range(4)",
    "SELECT * FROM points TABLESAMPLE (50 PERCENT)",
    "SELECT id FROM points ORDER BY id LIMIT 2 OFFSET 1",
    "SELECT /*+ BROADCAST(p) */ p.id FROM points p",
    "SELECT * FROM (SELECT id, name FROM customers) PIVOT (count(id) FOR name IN ('a', 'b'))",
    "SELECT count(*) FROM points GROUP BY GROUPING SETS ((id), ())",
    "VALUES (1), (2)",
    "TABLE points",
    "SHOW VIEWS",
    "DESCRIBE customers",
    "FROM points |> WHERE id > 1 |> SELECT id |> ORDER BY id",
    "FROM points |> AGGREGATE sum(id) AS s GROUP BY id % 2 AS k |> EXTEND s + 1 AS t |> DROP k",
    "SELECT id, CASE WHEN id IN (SELECT max(id) FROM points) THEN transform(array(id), x -> x + 1)"
    " END AS y FROM points LATERAL VIEW explode(array(1, 2)) e AS z",
]
WRITES = [
    "INSERT INTO points SELECT 9",
    "INSERT OVERWRITE points SELECT 9",
    "UPDATE points SET id = 4 WHERE id = 2",
    "WITH gone AS (SELECT 2 AS id) DELETE FROM points",
    "MERGE INTO points p USING customers c ON p.id = c.id WHEN MATCHED THEN DELETE",
]
DDLS = [
    "CREATE OR REPLACE TEMP VIEW v AS SELECT 1",
    "DROP VIEW points",
    "ALTER VIEW points RENAME TO lines",
    "TRUNCATE TABLE points",
    "SET spark.sql.shuffle.partitions = 1",
    "CACHE TABLE points",
    "EXECUTE IMMEDIATE 'SELECT 1'",
    "CALL some_catalog.some_procedure(1)",
    "BEGIN SELECT 1; END",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.dir')",
    "SELECT id FROM points WHERE id IN (SELECT reflect('java.lang.Math', 'abs', -1))",
    "SELECT TRANSFORM(id) USING 'cat' AS x FROM points",
    "SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.dir')",
    "SELECT id FROM points WHERE IDENTIFIER('refl' || 'ect')('java.lang.Math', 'abs', -1) > '0'",
    "SELECT x FROM points LATERAL VIEW reflect('java.lang.Math', 'abs', -1) v AS x",
]


@pytest.mark.parametrize("sql", READS)
def test_reads(spark, sql):
    assert G.classify(spark, sql) == "read"
    G.guarded_sql(spark, sql).df.collect()


@pytest.mark.parametrize("sql,kind", [(s, "write") for s in WRITES] + [(s, "ddl") for s in DDLS])
def test_everything_else_is_blocked(spark, sql, kind):
    if not sql.startswith("BEGIN"):
        assert G.classify(spark, sql) == kind
    with pytest.raises(TabsenseError):
        G.guarded_sql(spark, sql)
    assert spark.table("points").count() == 3


def test_overwrite_directory_writes_nothing_unconfirmed(spark, tmp_path):
    target = tmp_path / "out"
    sql = f"INSERT OVERWRITE DIRECTORY '{target}' USING parquet SELECT id FROM points"
    with pytest.raises(WriteBlocked):
        G.guarded_sql(spark, sql)
    assert not os.path.exists(target)
    done = G.guarded_sql(spark, sql, confirm_write=True)
    assert done.sql_class == "write" and done.affected in (None, 3)
    assert spark.read.parquet(str(target)).count() == 3


def test_execute_immediate_creates_nothing_unconfirmed(spark):
    with pytest.raises(WriteBlocked):
        G.guarded_sql(spark, "EXECUTE IMMEDIATE 'CREATE TEMP VIEW sneaked AS SELECT 1 AS x'")
    assert not spark.catalog.tableExists("sneaked")


def test_reflection_does_not_run(spark):
    with pytest.raises(WriteBlocked):
        G.guarded_sql(spark, "SELECT reflect('java.lang.System', 'setProperty', 'guard', 'on')")
    assert spark._jvm.java.lang.System.getProperty("guard") is None


def test_computed_function_names_do_not_run(spark):
    with pytest.raises(WriteBlocked):
        G.guarded_sql(spark, "SELECT IDENTIFIER('java_method')"
                             "('java.lang.System', 'setProperty', 'guard2', 'on')")
    assert spark._jvm.java.lang.System.getProperty("guard2") is None


def test_views_over_reflection_are_not_read(spark):
    spark.sql("CREATE OR REPLACE TEMP VIEW hidden AS SELECT id, "
              "reflect('java.lang.System', 'setProperty', 'guard3', 'on') AS x FROM points")
    for sql in ("SELECT * FROM hidden", "SELECT id FROM points WHERE id IN (SELECT x FROM hidden)",
                "SELECT (SELECT max(x) FROM hidden) AS x", "WITH h AS (TABLE hidden) TABLE h"):
        with pytest.raises(WriteBlocked):
            G.guarded_sql(spark, sql)
    assert spark._jvm.java.lang.System.getProperty("guard3") is None


def test_affected_count_of_an_insert(spark, tmp_path):
    spark.sql(f"CREATE TABLE guarded_t (id BIGINT) USING parquet LOCATION '{tmp_path}/t'")
    try:
        done = G.guarded_sql(spark, "INSERT INTO guarded_t SELECT id FROM points", True)
        assert done.sql_class == "write" and done.affected == 3
        assert spark.table("guarded_t").count() == 3
    finally:
        spark.sql("DROP TABLE guarded_t")


@pytest.mark.parametrize("sql,code", [
    ("SELECT 1; SELECT 2", "singleStatementOnly"),
    ("SELECT id FROM points; DROP VIEW points", "singleStatementOnly"),
    ("SELEKT id FROM", "sqlParseFailed"),
    ("  ;  ", "sqlParseFailed"),
])
def test_one_parseable_statement(spark, sql, code):
    with pytest.raises(TabsenseError) as e:
        G.classify(spark, sql)
    assert e.value.code == code


def test_semicolon_inside_string_is_not_a_split():
    assert G.split_statements("SELECT 'a;b'; ") == ["SELECT 'a;b'"]


def test_limit_only_where_asked(spark):
    spark.range(600).createOrReplaceTempView("many")
    assert G.guarded_sql(spark, "SELECT id FROM many").df.count() == 600
    capped = G.guarded_sql(spark, "SELECT id FROM many ORDER BY id", row_limit=500)
    assert capped.limited and capped.df.count() == 500
    own = G.guarded_sql(spark, "SELECT id FROM many LIMIT 550", row_limit=500)
    assert not own.limited and own.df.count() == 550


@pytest.mark.parametrize("sql", [
    "SELECT id FROM many UNION SELECT id + 600 FROM many",
    "SELECT id FROM many UNION ALL SELECT id FROM many ORDER BY 1",
    "SELECT id FROM many EXCEPT SELECT -1",
])
def test_set_operations_stay_whole(spark, sql):
    spark.range(600).createOrReplaceTempView("many")
    res = G.guarded_sql(spark, sql, row_limit=500)
    assert not res.limited and res.df.count() >= 600
