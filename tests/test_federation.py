"""Databases behind a Python driver: what is sent to them as text, in which dialect, and what comes back."""

import datetime
import functools
import sqlite3

import duckdb
import pytest

from tessera.sources import federation
from tessera.sources.federation import Database, dialect, spark_type


def connect(path):
    return sqlite3.connect(path)


def connect_duck(path):
    return duckdb.connect(path, read_only=True)


ROWS = [(1, "Al", 10, 100.5, "2020-01-02"), (2, "Bo", 20, 200.0, "2021-03-04"), (3, "Cy", 10, 300.0, None), (4, "Da", None, None, None), (5, "it's", 30, 50.0, "2019-09-09")]


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "a.sqlite")
    c = sqlite3.connect(path)
    c.execute("CREATE TABLE STAFF (NO INTEGER NOT NULL, NAME VARCHAR(20), TEAM INTEGER, PAY DOUBLE, SINCE DATE)")
    c.executemany("INSERT INTO STAFF VALUES (?, ?, ?, ?, ?)", ROWS)
    c.execute("CREATE TABLE TEAMS (TEAM INTEGER, TITLE VARCHAR(20))")
    c.executemany("INSERT INTO TEAMS VALUES (?, ?)", [(10, "Sales"), (20, "Build"), (40, "None")])
    c.execute("CREATE VIEW RICH AS SELECT * FROM STAFF WHERE PAY > 100")
    c.commit()
    c.close()
    return path


@pytest.fixture(scope="module")
def db(spark, path):
    return Database(spark, functools.partial(connect, path), "SQLite", sqlite3.sqlite_version)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_metadata(db):
    assert db.tables() == [("RICH", "VIEW"), ("STAFF", "TABLE"), ("TEAMS", "TABLE")]
    assert db.columns("STAFF")[0] == ("NO", "INTEGER", "int", False) and db.columns("STAFF")[4][2] == "date"
    assert db.metadata().where("TABLE_TYPE = 'VIEW'").count() == 5
    with pytest.raises(ValueError):
        db.columns("NOTHING")


def test_types():
    kinds = {"DECIMAL(12,3)": "decimal(12,3)", "numeric": "decimal(38,10)", "money": "decimal(19,4)", "bit": "boolean", "tinyint": "smallint", "bigint": "bigint", "float": "double", "real": "float", "varbinary(4)": "binary", "datetime2(3)": "timestamp_ntz", "date": "date", "time(3)": "string", "uuid": "string", "nvarchar(9)": "string"}
    assert {k: spark_type(k) for k in kinds} == kinds


def test_reads_what_the_database_holds(db):
    got = {r["NO"]: r for r in db.table("STAFF").read().collect()}
    assert got[1]["SINCE"] == datetime.date(2020, 1, 2) and got[4]["PAY"] is None and got[5]["NAME"] == "it's"


def test_filters_of_spark_are_sent(db):
    found = db.table("STAFF").read().where("PAY > 90 AND NAME <> 'Bo' AND TEAM IN (10, 30) AND SINCE IS NOT NULL").select("NO")
    assert rows(found) == [(1,)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    kept = next(x for x in plan.splitlines() if "Filter" in x)
    assert "NAME" in kept and "PAY" not in kept and "TEAM" not in kept and "SINCE" not in kept


def test_one_text_for_a_whole_expression(db):
    staff, teams = db.table("STAFF"), db.table("TEAMS")
    whole = staff.where("PAY > 90 AND (NAME LIKE '%o%' OR TEAM = 10)").join(teams, [("TEAM", "TEAM")], "left", "l.PAY < 1000").aggregate(["TITLE"], N=("COUNT(*)", "bigint"), S=("SUM(PAY)", "double")).sort("TITLE DESC", limit=5)
    assert rows(whole.read()) == [("Build", 1, 200.0), ("Sales", 2, 400.5)]
    assert whole.sql().count("SELECT") >= 3 and "LEFT JOIN" in whole.sql() and "GROUP BY" in whole.sql()
    assert rows(staff.join(teams, [("TEAM", "TEAM")], "full").select("NO", "TITLE").read()) == sorted([(1, "Sales"), (3, "Sales"), (2, "Build"), (4, None), (5, None), (None, "None")], key=repr)
    assert rows(staff.select("TEAM").minus(teams.select("TEAM")).read()) == [(30,), (None,)]
    assert rows(staff.select("TEAM").intersect(teams.select("TEAM")).read()) == [(10,), (20,)]
    assert staff.select("TEAM").union(teams.select("TEAM"), every=True).read().count() == 8
    assert [r[0] for r in staff.sort("PAY", limit=2, offset=3).select("NO").read().collect()] == [3, 4]
    assert rows(db.values([(1, "x'y", None)], "a int, b string, c double").read()) == [(1, "x'y", None)]
    assert db.values([], "a int").read().count() == 0


def test_what_is_not_sent(db, spark, path):
    staff = db.table("STAFF")
    with pytest.raises(NotImplementedError):
        staff.where("my_function(PAY) > 1")  # a user function stays in Spark
    with pytest.raises(NotImplementedError):
        staff.select(x=("rank_it(PAY)", "int"))
    with pytest.raises(NotImplementedError):
        staff.join(db.table("TEAMS"), [("TEAM", "TEAM")], "left_semi")
    other = Database(spark, functools.partial(connect, path), "SQLite")
    with pytest.raises(NotImplementedError):
        staff.join(other.table("TEAMS"), [("TEAM", "TEAM")])
    with pytest.raises(NotImplementedError):
        staff.select("TEAM").intersect(db.table("TEAMS").select("TEAM"), every=True)
    with pytest.raises(ValueError):
        staff.where("NO_SUCH > 1")
    assert federation.called("my_f(x) + SUM(y)") == {"MY_F"}
    both = staff.read().join(other.table("TEAMS").read(), "TEAM")  # each side is sent, the join runs in Spark
    assert sorted(r["NO"] for r in both.collect()) == [1, 2, 3]


def test_parameters(db, spark):
    assert rows(db.query("SELECT NO FROM STAFF WHERE PAY > ? AND NAME <> ?", "n int", [90, "it's"])) == [(1,), (2,), (3,)]
    outer = spark.createDataFrame([(1, 10), (2, 20), (3, None), (4, 99), (5, 10)], "id int, k int")
    found = db.correlate(outer, "SELECT NAME, PAY FROM STAFF WHERE TEAM = ?", "name string, pay double", ["k"], "left")
    assert rows(found.select("id", "name")) == sorted([(1, "Al"), (1, "Cy"), (2, "Bo"), (3, None), (4, None), (5, "Al"), (5, "Cy")], key=repr)
    assert db.correlate(outer, "SELECT NAME FROM STAFF WHERE TEAM = ?", "name string", ["k"]).count() == 5


def test_partitions(db):
    df = db.table("STAFF").read(split=("NO % 2 = ?", [(0,), (1,)]))
    assert df.rdd.getNumPartitions() == 2 and df.count() == 5


def test_another_product(spark, tmp_path):
    path = str(tmp_path / "b.duckdb")
    c = duckdb.connect(path)
    c.execute("CREATE TABLE T (A INTEGER NOT NULL, B DECIMAL(12,3), C TIMESTAMP, D BOOLEAN, E BLOB)")
    c.execute("INSERT INTO T VALUES (1, 2.5, TIMESTAMP '2024-01-02 03:04:05', true, 'x'::BLOB), (2, NULL, NULL, NULL, NULL)")
    c.close()
    db = Database(spark, functools.partial(connect_duck, path), "DuckDB", duckdb.__version__)
    assert db.tables() == [("T", "TABLE")] and [x[2] for x in db.columns("T")] == ["int", "decimal(12,3)", "timestamp_ntz", "boolean", "binary"]
    t = db.table("T")
    got = t.where("A = 1").read().first()
    assert (float(got["B"]), got["C"].hour, got["D"], bytes(got["E"])) == (2.5, 3, True, b"x")
    assert rows(t.select("A").intersect(t.select("A"), every=True).read()) == [(1,), (2,)]


def test_dialects():
    class Fake:
        spark = None

    def remote(product, version=""):
        db = Fake()
        db.dialect = dialect(product, version)
        return federation.Remote(db, 'SELECT "A" FROM "T"', (("A", "int"), ("B", "string")), plain="S.T")

    new, old = remote("Microsoft SQL Server", "15.0"), remote("SQL Server", "10.5")
    assert new.sort("A DESC", limit=5, offset=2).sql() == "SELECT [A], [B] FROM [S].[T] t ORDER BY CASE WHEN [A] IS NULL THEN 1 ELSE 0 END DESC, [A] DESC OFFSET 2 ROWS FETCH NEXT 5 ROWS ONLY"
    assert old.limit(5).sql() == "SELECT TOP (5) [A], [B] FROM [S].[T] t"
    assert new.select(x=("B || 'y'", "string")).sql() == "SELECT [B] + 'y' AS [x] FROM [S].[T] t"
    assert remote("MySQL", "8.0.40").sort("A").sql() == "SELECT `A`, `B` FROM `S`.`T` t ORDER BY CASE WHEN `A` IS NULL THEN 1 ELSE 0 END ASC, `A` ASC"
    assert remote("PostgreSQL").sort("A", limit=1).sql().endswith('ORDER BY "A" ASC NULLS LAST LIMIT 1')
    assert remote("Something else").limit(3, 1).sql().endswith("OFFSET 1 ROWS FETCH NEXT 3 ROWS ONLY")
    with pytest.raises(NotImplementedError):
        remote("MySQL", "8.0.40").join(remote("MySQL"), [("A", "A")], "full")
    with pytest.raises(NotImplementedError):
        remote("sqlite", "3.20").aggregate([], n=("COUNT(*) FILTER (WHERE A > 1)", "bigint"))
    assert dialect("sqlite", "3.38").lacks >= {"FULL", "RIGHT"} and "FULL" not in dialect("sqlite", "3.45.1").lacks
    words = dialect("sqlite")
    assert [words.literal(v) for v in (None, True, 1.5, "a'b", b"\x01", datetime.date(2024, 1, 2))] == ["NULL", "1", "1.5", "'a''b'", "X'01'", "'2024-01-02'"]
