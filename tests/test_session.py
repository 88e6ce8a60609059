"""SQL text through the session: rewrites, parameters, DDL, DML, metadata."""

import datetime
import json
import threading
import time

import pytest

from tessera.plans.frontend import tokens, translate
from tessera.session import Engine
from tessera.sources import readers


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    for name in ("SALES", "EMPS", "IN_3", "V", "T2"):
        spark.catalog.dropTempView(name)
    e.register("SALES", spark.sql("SELECT * FROM VALUES (1,'EAST',10,'A'),(2,'EAST',20,'B'),(3,'EAST',20,'C'),(4,'WEST',30,'D'),(5,'WEST',NULL,'E'),(6,'WEST',5,'F') AS t(ID, REGION, AMOUNT, LABEL)"))
    return e


def ids(df):
    return [r[0] for r in df.collect()]


def test_null_collation_is_high(engine):
    assert ids(engine.execute('SELECT "ID" FROM "SALES" ORDER BY "AMOUNT", "ID"')) == [6, 1, 2, 3, 4, 5]
    assert ids(engine.execute('SELECT "ID" FROM "SALES" ORDER BY "AMOUNT" DESC, "ID"')) == [5, 4, 2, 3, 1, 6]
    assert ids(engine.execute("SELECT ID FROM SALES ORDER BY AMOUNT NULLS FIRST, ID")) == [5, 6, 1, 2, 3, 4]


def test_pages(engine):
    assert ids(engine.execute("SELECT ID FROM SALES ORDER BY ID OFFSET 2 ROWS FETCH NEXT 2 ROWS ONLY")) == [3, 4]
    assert ids(engine.execute("SELECT ID FROM SALES ORDER BY ID OFFSET 4 ROWS")) == [5, 6]
    assert ids(engine.execute("SELECT ID FROM SALES ORDER BY ID FETCH FIRST 1 ROW ONLY")) == [1]


def test_text_is_left_alone():
    assert "'FETCH -- x ''y'' /* ORDER BY'" in translate("SELECT 'FETCH -- x ''y'' /* ORDER BY' -- OFFSET 2 ROWS\n")
    assert tokens('"a""b"') == ['`a"b`']
    for sql in ("SELECT SUM(x) OVER (ORDER BY y ROWS UNBOUNDED PRECEDING EXCLUDE TIES) FROM t", "SELECT * FROM t MATCH_RECOGNIZE (PATTERN (A B))"):
        with pytest.raises(NotImplementedError):
            translate(sql)


def test_casts(engine):
    r = engine.execute("SELECT CAST('ab' AS CHAR(5)), CAST('abcdef' AS VARCHAR(3)), CAST(12 AS VARCHAR), CAST(1 AS FLOAT), CAST(255 AS TINYINT UNSIGNED), CAST(CAST('7' AS INTEGER) AS CHAR(2)), CAST(NULL AS SMALLINT UNSIGNED), CAST('2024-01-02 03:04:05' AS TIMESTAMP)").first()
    assert tuple(r)[:7] == ("ab   ", "abc", "12", 1.0, 255, "7 ", None) and r[7].hour == 3
    with pytest.raises(Exception, match="out of range"):
        engine.execute("SELECT CAST(-1 AS TINYINT UNSIGNED)").collect()


def test_asof_and_unnest(engine):
    got = engine.execute('SELECT a."ID", b."ID" FROM "SALES" a LEFT ASOF JOIN (SELECT * FROM "SALES" WHERE "ID" > 3) b MATCH_CONDITION b."ID" <= a."ID" ON a."REGION" = b."REGION" ORDER BY a."ID"').collect()
    assert [tuple(r) for r in got] == [(1, None), (2, None), (3, None), (4, 4), (5, 5), (6, 6)]
    ahead = engine.execute("SELECT a.ID, b.ID FROM SALES a ASOF JOIN SALES b MATCH_CONDITION b.ID > a.ID ON a.REGION = b.REGION ORDER BY a.ID").collect()
    assert [tuple(r) for r in ahead] == [(1, 2), (2, 3), (4, 5), (5, 6)]
    assert [tuple(r) for r in engine.execute("SELECT x, n FROM UNNEST(ARRAY[7, 8]) WITH ORDINALITY AS t(x, n)").collect()] == [(7, 1), (8, 2)]


def test_window_tables(engine):
    engine.execute_non_query("CREATE OR REPLACE VIEW V AS SELECT TIMESTAMP_NTZ '2024-01-01 00:10:00' AS ts, 1 AS id")
    r = engine.execute("SELECT * FROM TABLE(TUMBLE(TABLE V, DESCRIPTOR(ts), INTERVAL '1' HOUR, INTERVAL '10' MINUTE))").first()
    assert r["window_start"].minute == 10
    assert engine.execute("SELECT * FROM TABLE(HOP(TABLE V, DESCRIPTOR(ts), INTERVAL '30' MINUTE, INTERVAL '1' HOUR))").count() == 2
    assert engine.execute("SELECT * FROM TABLE(SESSION(TABLE V, DESCRIPTOR(ts), DESCRIPTOR(id), INTERVAL '1' HOUR))").first()["window_end"].hour == 1


def test_parameters_scalar_rows_batch(engine):
    assert engine.scalar("SELECT COUNT(*) FROM SALES WHERE AMOUNT > ?", [10]) == 3
    assert engine.scalar("SELECT ID FROM SALES WHERE ID > 100") is None
    assert [r["ID"] for r in engine.rows("SELECT ID FROM SALES ORDER BY ID")] == [1, 2, 3, 4, 5, 6]
    assert [d.count() for d in engine.batch(["SELECT * FROM SALES", "SELECT * FROM DUAL"])] == [6, 1]
    assert "Physical Plan" in engine.execute("EXPLAIN PLAN FOR SELECT ID FROM SALES").first()[0]
    with pytest.raises(NotImplementedError):
        engine.begin()


def test_ddl_and_dml(engine):
    run = engine.execute_non_query
    assert run("CREATE TABLE EMPS (ID INTEGER, NAME VARCHAR(10), DEPTNO INTEGER)") == 0
    with pytest.raises(ValueError):
        run("CREATE TABLE EMPS (ID INTEGER)")
    assert run("INSERT INTO EMPS VALUES (10, 'Alice', 3), (20, 'Bob', 1), (30, 'Carol', 3)") == 3
    engine.create_view("IN_3", "SELECT ID, NAME FROM EMPS WHERE DEPTNO = 3", modifiable={"DEPTNO": 3})
    assert run("INSERT INTO IN_3 VALUES (40, 'Dan')") == 1
    assert ids(engine.execute("SELECT ID FROM IN_3 ORDER BY ID")) == [10, 30, 40]
    assert run("INSERT INTO EMPS (ID, DEPTNO) VALUES (50, NULL)") == 1
    assert run("UPDATE EMPS SET DEPTNO = DEPTNO + 1, NAME = UPPER(NAME) WHERE DEPTNO = 3") == 3
    assert engine.scalar("SELECT COUNT(*) FROM EMPS WHERE NAME = 'ALICE' AND DEPTNO = 4") == 1
    assert run("DELETE FROM EMPS WHERE DEPTNO = 4") == 3
    assert ids(engine.execute("SELECT ID FROM EMPS ORDER BY ID")) == [20, 50]
    merged = "MERGE INTO EMPS t USING (SELECT ID, LABEL AS NAME FROM SALES WHERE ID < 3 UNION ALL SELECT 20, 'Z') s ON t.ID = s.ID WHEN MATCHED THEN UPDATE SET NAME = s.NAME WHEN NOT MATCHED THEN INSERT (ID, NAME) VALUES (s.ID, s.NAME)"
    assert run(merged) == 3
    assert [tuple(r) for r in engine.execute("SELECT ID, NAME FROM EMPS ORDER BY ID").collect()] == [(1, "A"), (2, "B"), (20, "Z"), (50, None)]
    with pytest.raises(ValueError):
        run("MERGE INTO EMPS t USING (SELECT 20 AS ID, 'Q' AS NAME UNION ALL SELECT 20, 'R') s ON t.ID = s.ID WHEN MATCHED THEN UPDATE SET NAME = s.NAME")
    assert run("DELETE FROM EMPS") == 4
    assert run("SELECT * FROM EMPS") == -1
    with pytest.raises(ValueError):
        run("DROP VIEW NO_SUCH")
    assert run("DROP VIEW IF EXISTS NO_SUCH") == 0
    assert run("DROP TABLE EMPS") == 0
    with pytest.raises(ValueError):
        run("INSERT INTO SALES VALUES (1, 'x', 1, 'y')")


def test_metadata_and_model(engine, spark, tmp_path):
    assert engine.schema("MetaDataCollections").count() == 7
    assert engine.schema("Restrictions").count() == 3 and engine.schema("DataSourceInformation").first()["ParameterMarker"] == "?"
    seen = []
    engine.observe(lambda text, df: seen.append((text, df.columns)))
    engine.execute("SELECT ID FROM SALES")
    assert seen == [("SELECT ID FROM SALES", ["ID"])]
    assert "SALES" in {r[0].upper() for r in engine.schema("Tables").collect()}
    assert engine.schema("Columns").where("upper(TABLE_NAME) = 'SALES'").count() == 4
    assert engine.schema("ReservedWords").count() > 10 and engine.schema("DataTypes").count() > 10
    with pytest.raises(ValueError):
        engine.schema("Nothing")
    (tmp_path / "people.csv").write_text("Id,Name,Age\n15,Person A,11\n19,Person E,1243\n")
    model = {"version": "1.0", "schemas": [{"name": "s", "tables": [
        {"name": "PEOPLE", "type": "csv", "path": str(tmp_path / "people.csv"), "options": {"header": "true", "inferSchema": "true"}},
        {"name": "NUMS", "type": "values", "rows": [[3], [1]], "columns": ["N"]},
        {"name": "OLD", "type": "view", "sql": ["SELECT Id FROM PEOPLE", "WHERE Age > 100"]}]}]}
    loaded = Engine(spark, model=json.dumps(model))
    assert loaded.scalar("SELECT Id FROM OLD") == 19 and loaded.scalar("SELECT SUM(N) FROM NUMS") == 4
    with pytest.raises(FileNotFoundError):
        Engine(spark, model=str(tmp_path / "none.json"))
    with pytest.raises(ValueError):
        Engine(spark, colour="red")


def test_sources(spark, tmp_path):
    got = readers.scannable(spark, "squares", "n int, sq int", lambda p: ((i, i * i) for i in range(p * 2, p * 2 + 2)), 2)
    assert sorted(map(tuple, got.collect())) == [(0, 0), (1, 1), (2, 4), (3, 9)]
    readers.values(spark, [(1, "a")], "i int, s string").write.parquet(str(tmp_path / "p"))
    assert readers.parquet(spark, str(tmp_path / "p"), "i int, s string").count() == 1
    db = readers.External(spark, "jdbc:x", paging="fetch")
    assert db.select("HR.EMPS", where="SALARY > 1", group=["DEPTNO"], aggregates={"N": "COUNT(*)"}, order=["1"], limit=5, offset=2) == 'SELECT "DEPTNO", COUNT(*) AS "N" FROM "HR"."EMPS" WHERE SALARY > 1 GROUP BY "DEPTNO" ORDER BY 1 OFFSET 2 ROWS FETCH NEXT 5 ROWS ONLY'
    assert readers.External(spark, "jdbc:x", quote="`").select("T", ["A"], limit=1) == "SELECT `A` FROM `T` LIMIT 1"


def test_the_engine_cancels_a_running_read(spark):
    engine, found = Engine(spark), []

    def read():
        try:
            found.append(sum(1 for _ in engine.rows("SELECT reflect('java.lang.Thread', 'sleep', CAST(500 AS BIGINT)) AS x, id FROM range(0, 80, 1, 4)")))
        except Exception as e:
            found.append(e)

    reader = threading.Thread(target=read, daemon=True)
    reader.start()
    time.sleep(3)
    engine.cancel()
    reader.join(15)
    assert not reader.is_alive() and isinstance(found[0], Exception)
    assert engine.scalar("SELECT COUNT(*) FROM DUAL") == 1  # the session goes on


def test_hooks(engine):
    seen = []
    for stage in ("parse", "text", "plan"):
        engine.hook(stage, lambda x, stage=stage: seen.append((stage, type(x).__name__)))
    engine.execute("SELECT ID FROM SALES")
    assert [s for s, _ in seen] == ["parse", "text", "plan"] and seen[0][1] == "list" and seen[2][1] == "DataFrame"
    with pytest.raises(KeyError):
        engine.hook("nothing", print)


def test_explain_modes(engine):
    assert "Parsed Logical Plan" in engine.execute("EXPLAIN LOGICAL SELECT ID FROM SALES").first()[0]
    assert "Statistics" in engine.execute("EXPLAIN COST SELECT ID FROM SALES").first()[0]
    assert engine.execute("EXPLAIN SELECT 'a  b' AS x, AMOUNT IN (SELECT ID FROM SALES) AS m FROM SALES").count() == 1


def test_three_valued_in(engine):
    got = engine.execute("SELECT ID, AMOUNT IN (SELECT AMOUNT FROM SALES b WHERE b.ID > a.ID AND b.REGION = a.REGION) AS m, NOT (REGION, ID) IN (SELECT REGION, AMOUNT FROM SALES) AS p, CASE WHEN AMOUNT IN (SELECT AMOUNT FROM SALES WHERE ID > 3) THEN 1 ELSE 0 END AS c FROM SALES a ORDER BY ID")
    assert [tuple(r) for r in got.collect()] == [(1, False, True, 0), (2, True, True, 0), (3, False, True, 0), (4, None, None, 1), (5, None, False, 0), (6, False, None, 1)]
    assert ids(engine.execute("SELECT ID FROM SALES WHERE AMOUNT NOT IN (SELECT AMOUNT FROM SALES WHERE ID < 3) ORDER BY ID")) == [4, 6]


def test_integer_arithmetic(engine):
    r = engine.execute("SELECT AVG(AMOUNT) AS a, AVG(DISTINCT AMOUNT) AS d, AVG(AMOUNT) FILTER (WHERE ID < 4) AS f, -7 / 2 AS q, 7 / 2.0 AS x, SUM(AMOUNT) / COUNT(*) / 2 AS s, AVG(CAST(AMOUNT AS DOUBLE)) AS e, (1 + 9) / (1 + 2) * 2 AS p FROM SALES").first()
    assert tuple(r)[:4] == (17, 16, 16, -3) and float(r["x"]) == 3.5 and (r["s"], r["e"], r["p"]) == (7, 17.0, 6)
    assert ids(engine.execute("SELECT AVG(AMOUNT) OVER (PARTITION BY REGION ORDER BY ID) FROM SALES ORDER BY ID")) == [10, 15, 16, 30, 30, 17]
    assert [tuple(x) for x in engine.execute("SELECT REGION, AVG(ID) / 2 AS h FROM SALES GROUP BY REGION HAVING SUM(ID) / 2 > 2 ORDER BY 1").collect()] == [("EAST", 1), ("WEST", 2)]
    with pytest.raises(Exception, match="OVERFLOW"):
        engine.execute("SELECT SUM(ID + 2147483000) AS s FROM SALES WHERE ID < 3").collect()


def test_exclusions_as_text(engine):
    def run(what):
        return [tuple(r) for r in engine.execute(f'SELECT "ID", COUNT("AMOUNT") OVER (ORDER BY "AMOUNT" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {what}), MAX("AMOUNT") OVER (PARTITION BY REGION ORDER BY AMOUNT ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE {what}) FROM "SALES" ORDER BY "ID"').collect()]

    assert [x[2] for x in run("CURRENT ROW")] == [20, 20, 20, 5, 30, 30]
    assert [x[2] for x in run("GROUP")] == [20, 10, None, 5, 30, 30]
    assert [x[1] for x in run("NO OTHERS")] == [2, 3, 4, 5, 5, 1]
    with pytest.raises(NotImplementedError):
        engine.execute("SELECT STDDEV(ID) OVER (ORDER BY ID ROWS UNBOUNDED PRECEDING EXCLUDE TIES) FROM SALES")


def test_recursion_as_text(engine):
    assert ids(engine.execute("WITH RECURSIVE t(n) AS (SELECT 1 UNION SELECT n % 4 + 1 FROM t) SELECT n FROM t ORDER BY n")) == [1, 2, 3, 4]
    assert ids(engine.execute("WITH RECURSIVE a(x) AS (SELECT 2), t(n) AS (SELECT 1 UNION SELECT t.n + a.x FROM t, a WHERE t.n < 6), u(n) AS (SELECT MAX(n) FROM t) SELECT t.n + u.n FROM t, u ORDER BY 1")) == [8, 10, 12, 14]
    assert ids(engine.execute("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 3) SELECT n FROM t ORDER BY n")) == [1, 2, 3]


def test_row_patterns_as_text(engine):
    text = "SELECT * FROM {} MATCH_RECOGNIZE (ORDER BY ID MEASURES A.ID AS s, LAST(B.ID) AS e ONE ROW PER MATCH PATTERN (A B) DEFINE B AS B.AMOUNT > PREV(B.AMOUNT) AND B.REGION = A.REGION) AS m ORDER BY s"
    assert [tuple(r) for r in engine.execute(text.format("SALES")).collect()] == [(1, 2)]
    assert [tuple(r) for r in engine.execute(text.format("(SELECT ID, REGION, -AMOUNT AS AMOUNT FROM SALES) AS x")).collect()] == []
    for refused in ("PATTERN (A B+)", "ALL ROWS PER MATCH PATTERN (A B)", "AFTER MATCH SKIP TO NEXT ROW PATTERN (A B)"):
        with pytest.raises(NotImplementedError):
            engine.execute(f"SELECT * FROM SALES MATCH_RECOGNIZE (ORDER BY ID MEASURES A.ID AS s {refused} DEFINE B AS B.ID > 1) AS m")


def test_collections_and_times_as_text(engine):
    r = engine.execute("SELECT ARRAY(SELECT ID FROM SALES WHERE ID < 3) AS a, MULTISET(SELECT AMOUNT FROM SALES WHERE ID > 4) AS m, ARRAY(SELECT ID, LABEL FROM SALES WHERE ID = 1) AS s, CAST(NULL AS ARRAY<INT>) IS EMPTY AS u, ARRAY[1] IS NOT EMPTY AS n").first()
    assert (sorted(r["a"]), sorted(r["m"], key=repr), [tuple(x) for x in r["s"]], r["u"], r["n"]) == ([1, 2], [5, None], [(1, "A")], None, True)
    t = engine.execute("SELECT LOCALTIME, LOCALTIME(0) AS t0, LOCALTIMESTAMP(0) AS s0, CURRENT_TIME, LOCALTIMESTAMP").first()
    assert t["t0"].microsecond == 0 and t["s0"].microsecond == 0
    assert [r[0] for r in engine.execute("SELECT JSON_ARRAYAGG(AMOUNT ORDER BY ID) FROM SALES GROUP BY REGION ORDER BY REGION").collect()] == ["[10,20,20]", "[30,5]"]


def test_measures_of_a_view(engine):
    engine.execute_non_query("CREATE OR REPLACE VIEW V AS SELECT REGION, AVG(AMOUNT) AS MEASURE M, COUNT(*) AS MEASURE N FROM SALES")
    assert [tuple(r) for r in engine.execute("SELECT REGION, AGGREGATE(M) AS m, AGGREGATE(N) AS n FROM V GROUP BY REGION ORDER BY 1").collect()] == [("EAST", 16, 3), ("WEST", 17, 3)]
    assert engine.scalar("SELECT AGGREGATE(M) FROM V WHERE ID < 3") == 15


def test_ties_of_an_asof_join_are_settled(engine):
    engine.register("TIES", engine.spark.sql("SELECT * FROM VALUES (1, 7, 'b'), (1, 7, 'a'), (1, 9, 'c') AS t(K, T, V)"))
    text = "SELECT a.ID, b.V FROM (SELECT 1 AS K, 8 AS T, 0 AS ID) a ASOF JOIN TIES b MATCH_CONDITION a.T >= b.T ON a.K = b.K"
    assert [tuple(r) for r in engine.execute(text).collect()] == [(0, "a")]
    shown = [engine.execute(text.replace("a.ID, b.V", "V")).collect() for _ in range(3)]  # unqualified: the lateral way
    assert shown[0] == shown[1] == shown[2]


def test_parameters_in_changes(engine):
    run = engine.execute_non_query
    run("CREATE TABLE T2 (ID INTEGER, NAME VARCHAR(10), AT DATE)")
    assert run("INSERT INTO T2 VALUES (1, 'a', NULL), (2, 'b', NULL)") == 2
    assert run("UPDATE T2 SET NAME = ?, AT = ? WHERE ID = ?", ["it's", datetime.date(2024, 1, 2), 2]) == 1
    assert run("MERGE INTO T2 t USING (SELECT 3 AS ID, ? AS NAME) s ON t.ID = s.ID WHEN NOT MATCHED THEN INSERT (ID, NAME) VALUES (s.ID, s.NAME)", ["c"]) == 1
    assert run("DELETE FROM T2 WHERE NAME = ?", ["a"]) == 1
    assert [tuple(r) for r in engine.execute("SELECT ID, NAME, AT FROM T2 ORDER BY ID").collect()] == [(2, "it's", datetime.date(2024, 1, 2)), (3, "c", None)]
    with pytest.raises(ValueError):
        run("DELETE FROM T2 WHERE ID = ?", [1, 2])
    run("DROP TABLE T2")
