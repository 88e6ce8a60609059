"""Queries that go through the session, the sources and streams: what a client of the engine would write."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.lineage import own_dir
from tessera.session import Engine
from tessera.sources import federation, readers
from tessera.streaming import windows

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


def _nations(spark: SparkSession, sf_dir: str) -> tuple[Engine, str]:
    engine, name = Engine(spark), f"t_{uuid.uuid4().hex[:8]}"
    engine.register("nation", spark.read.parquet(f"{sf_dir}/nation.parquet"))
    engine.execute_non_query(f"CREATE TABLE {name} (K INTEGER, NAME VARCHAR(25), R INTEGER)")
    engine.execute_non_query(f"INSERT INTO {name} SELECT n_nationkey, n_name, n_regionkey FROM nation")
    return engine, name


@query("dml_insert", "SELECT n_nationkey AS K, n_name AS NAME, n_regionkey AS R FROM nation UNION ALL SELECT 100, 'NEW', NULL")
def _insert(spark, sf_dir):
    engine, t = _nations(spark, sf_dir)
    engine.execute_non_query(f"INSERT INTO {t} (K, NAME) VALUES (100, 'NEW')")
    return engine.execute(f"SELECT * FROM {t}")


@query("dml_update", "SELECT n_nationkey AS K, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS NAME, CASE WHEN n_regionkey = 1 THEN 11 ELSE n_regionkey END AS R FROM nation")
def _update(spark, sf_dir):
    engine, t = _nations(spark, sf_dir)
    engine.execute_non_query(f"UPDATE {t} SET NAME = LOWER(NAME), R = R + 10 WHERE R = 1")
    return engine.execute(f"SELECT * FROM {t}")


@query("dml_delete", "SELECT n_nationkey AS K, n_name AS NAME, n_regionkey AS R FROM nation WHERE n_regionkey <> 2")
def _delete(spark, sf_dir):
    engine, t = _nations(spark, sf_dir)
    engine.execute_non_query(f"DELETE FROM {t} WHERE R = 2")
    return engine.execute(f"SELECT * FROM {t}")


@query("dml_merge", "SELECT n_nationkey AS K, CASE WHEN n_nationkey < 5 THEN 'N' ELSE n_name END AS NAME, n_regionkey AS R FROM nation UNION ALL SELECT 200, 'N', NULL")
def _merge(spark, sf_dir):
    engine, t = _nations(spark, sf_dir)
    engine.execute_non_query(f"MERGE INTO {t} a USING (SELECT n_nationkey AS K, 'N' AS NAME FROM nation WHERE n_nationkey < 5 UNION ALL SELECT 200, 'N') b ON a.K = b.K WHEN MATCHED THEN UPDATE SET NAME = b.NAME WHEN NOT MATCHED THEN INSERT (K, NAME) VALUES (b.K, b.NAME)")
    return engine.execute(f"SELECT * FROM {t}")


@query("dml_counts", "SELECT CAST(v AS BIGINT) AS n FROM (VALUES (2), (5), (6)) AS t(v)")
def _counts(spark, sf_dir):
    engine, t = _nations(spark, sf_dir)
    counts = [engine.execute_non_query(x) for x in (f"INSERT INTO {t} VALUES (100, 'A', 9), (101, 'B', 0)", f"UPDATE {t} SET NAME = 'X' WHERE R = 3", f"DELETE FROM {t} WHERE R = 0")]
    return spark.createDataFrame([(n,) for n in counts], "n long")


@query("view_insert", "SELECT n_nationkey AS K, n_name AS NAME FROM nation WHERE n_regionkey = 3 UNION ALL SELECT 300, 'THROUGH'")
def _view(spark, sf_dir):
    engine, t = _nations(spark, sf_dir)
    engine.create_view(f"v_{t}", f"SELECT K, NAME FROM {t} WHERE R = 3", modifiable={"R": 3})
    engine.execute_non_query(f"INSERT INTO v_{t} VALUES (300, 'THROUGH')")
    return engine.execute(f"SELECT * FROM v_{t}")


@query("parameters", "SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 5")
def _parameters(spark, sf_dir):
    engine = Engine(spark)
    engine.register("nation", spark.read.parquet(f"{sf_dir}/nation.parquet"))
    return engine.execute("SELECT n_name FROM nation WHERE n_regionkey = ? AND n_nationkey > ?", [2, 5])


@query("csv_source", "SELECT r_regionkey AS k, r_name AS name FROM region")
def _csv(spark, sf_dir):
    path = f"{own_dir(spark)}/csv/{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr("r_regionkey AS k", "r_name AS name").write.option("header", True).csv(path)
    return readers.csv(spark, path, "k int, name string")


@query("python_source", "SELECT CAST(i AS INT) AS n, CAST(i * i AS INT) AS sq FROM range(0, 40) t(i)")
def _python(spark, sf_dir):
    return readers.scannable(spark, "tessera_squares", "n int, sq int", lambda p: ((i, i * i) for i in range(p * 10, p * 10 + 10)), 4)


@query("streaming_tumble", "SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def _stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.rpartition("/")[0] + "/events.parquet*")
    base = f"{own_dir(spark)}/stream_{uuid.uuid4().hex[:8]}"
    counted = windows.windowed_counts(stream.withColumn("ts", stream.ts.cast("timestamp")), "ts", "1 day", ["event_type"], "1 hour")
    keys = ["window_start", "event_type"]
    windows.upserted(counted, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return windows.latest(spark.read.parquet(f"{base}/table"), keys).selectExpr("CAST(window_start AS TIMESTAMP_NTZ) AS window_start", "event_type", "n")


# ---- constructs of SQL text that the session rewrites or hands to an operator

SALES = "(VALUES (1, 'EAST', 10, 'A'), (2, 'EAST', 20, 'B'), (3, 'EAST', 20, 'C'), (4, 'WEST', 30, 'D'), (5, 'WEST', NULL, 'E'), (6, 'WEST', 5, 'F')) AS sales(id, region, amount, label)"


def _engine(spark: SparkSession, sf_dir: str, *tables: str, **options) -> Engine:
    engine = Engine(spark, **options)
    for t in tables:
        engine.register(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    return engine


def _text(name: str, text: str, sql: str, *tables: str) -> None:
    def run(spark, sf_dir):
        return _engine(spark, sf_dir, *tables).execute(text)

    QUERIES[name] = (run, sql)


_text("sql_nested_pages", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 20 ROWS FETCH NEXT 40 ROWS ONLY) x ORDER BY o_orderkey DESC FETCH FIRST 7 ROWS ONLY", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 40 OFFSET 20) ORDER BY o_orderkey DESC LIMIT 7", "orders")
_IN = "SELECT id, amount IN (SELECT amount FROM {0} WHERE b.id > 3) AS one, amount NOT IN (SELECT amount FROM {0} WHERE b.id > 3) AS other, amount IN (SELECT amount FROM {0} WHERE b.id > 100) AS never, amount IN (SELECT amount FROM {0} WHERE b.id < 3) AS known FROM {1}".format(SALES.replace("sales(", "b("), SALES)
_text("sql_in_projected", _IN, _IN)
_text("sql_in_projected_pairs", f"SELECT id, (region, amount) IN (SELECT region, amount FROM {SALES.replace('sales(', 'b(')} WHERE b.id > 3) AS m FROM {SALES}", f"SELECT id, (SELECT CASE WHEN bool_or(region = r2 AND amount = a2) THEN true WHEN bool_or((region = r2 AND amount = a2) IS NULL) THEN NULL ELSE false END FROM (SELECT region AS r2, amount AS a2 FROM {SALES.replace('sales(', 'b(')} WHERE b.id > 3)) AS m FROM {SALES}")
_text("sql_integer_arithmetic", "SELECT o_custkey, AVG(o_custkey * 7 + o_orderkey) AS a, SUM(o_orderkey) / COUNT(*) AS q, -7 / 2 AS r, MAX(o_orderkey) / 7 * 2 AS s, 7 / 2.0E0 AS d FROM orders GROUP BY o_custkey", "SELECT o_custkey, CAST(SUM(o_custkey * 7 + o_orderkey) // COUNT(*) AS BIGINT) AS a, CAST(SUM(o_orderkey) // COUNT(*) AS BIGINT) AS q, -3 AS r, MAX(o_orderkey) // 7 * 2 AS s, 3.5::DOUBLE AS d FROM orders GROUP BY o_custkey", "orders")
_text("sql_json_kinds", """SELECT JSON_VALUE('{"a":"[x"}', '$.a') AS v, JSON_QUERY('{"a":"[x"}', '$.a') AS q, JSON_QUERY('{"a":[1,2]}', 'lax $.a') AS l, JSON_VALUE('{"a":[1]}', '$.a') AS n, JSON_VALUE('{"a":"{y"}', '$.a') AS w, JSON_QUERY('{"a":{"b":1}}', '$.a') AS o""", """SELECT '[x' AS v, CAST(NULL AS VARCHAR) AS q, '[1,2]' AS l, CAST(NULL AS VARCHAR) AS n, '{y' AS w, '{"b":1}' AS o""")
_text("sql_asof_events", "SELECT a.event_id, b.event_id AS near FROM events a LEFT ASOF JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') b MATCH_CONDITION b.ts < a.ts ON a.user_id = b.user_id", "SELECT a.event_id, b.event_id AS near FROM events a ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts > b.ts", "events")


def _excluded(what: str, keep: str) -> None:
    frame = f"OVER (PARTITION BY o_custkey ORDER BY o_orderstatus EXCLUDE {what})" if what != "CURRENT ROW" else "OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW)"
    test = "b.k <= a.k" if what != "CURRENT ROW" else "b.rn <= a.rn + 2"
    _text(
        f"sql_exclude_{what.split()[0].lower()}",
        f"SELECT o_orderkey, SUM(o_orderkey) {frame} AS s, COUNT(*) {frame} AS n FROM orders",
        f"WITH o AS (SELECT o_orderkey, o_custkey, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS k, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) SELECT a.o_orderkey, CAST(SUM(b.o_orderkey) AS BIGINT) AS s, COUNT(b.o_orderkey) AS n FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND {test} AND ({keep}) GROUP BY a.o_orderkey",
        "orders",
    )


_excluded("CURRENT ROW", "a.rn <> b.rn")
_excluded("TIES", "a.k <> b.k OR a.rn = b.rn")
_excluded("GROUP", "a.k <> b.k")
_text("sql_recursive_union", "WITH RECURSIVE e(a, b) AS (SELECT n_nationkey, MOD(n_nationkey * 3 + 1, 25) FROM nation), r(s, a) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT r.s, e.b FROM r JOIN e ON e.a = r.a) SELECT s, a FROM r", "WITH RECURSIVE e(a, b) AS (SELECT n_nationkey, (n_nationkey * 3 + 1) % 25 FROM nation), r(s, a) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT r.s, e.b FROM r JOIN e ON e.a = r.a) SELECT s, a FROM r", "nation")
_text("sql_match_recognize", f"SELECT * FROM {SALES} MATCH_RECOGNIZE (PARTITION BY region ORDER BY id MEASURES STRT.id AS s, UP.id AS e PATTERN (STRT UP) DEFINE UP AS UP.amount > PREV(UP.amount)) AS t", "SELECT * FROM (VALUES ('EAST', 1, 2)) AS t(region, s, e)")
_text("sql_match_three", "SELECT * FROM orders MATCH_RECOGNIZE (PARTITION BY o_custkey ORDER BY o_orderkey MEASURES A.o_orderkey AS s, C.o_orderkey AS e AFTER MATCH SKIP PAST LAST ROW PATTERN (A B C) DEFINE B AS B.o_totalprice < A.o_totalprice AND B.o_orderkey > 0, C AS C.o_totalprice > PREV(C.o_totalprice, 2)) AS t WHERE s >= 0", """
WITH RECURSIVE x AS (SELECT *, ROW_NUMBER() OVER w AS rn, LEAD(o_totalprice) OVER w AS p2, LEAD(o_totalprice, 2) OVER w AS p3, LEAD(o_orderkey, 2) OVER w AS k3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
m AS (SELECT o_custkey, o_orderkey AS s, k3 AS e, rn FROM x WHERE p2 < o_totalprice AND p3 > o_totalprice),
t AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY rn) AS k FROM m) WHERE k = 1
  UNION ALL SELECT n.* FROM t JOIN LATERAL (SELECT m.*, 1 AS k FROM m WHERE m.o_custkey = t.o_custkey AND m.rn > t.rn + 2 ORDER BY m.rn LIMIT 1) n ON TRUE)
SELECT o_custkey, s, e FROM t""", "orders")
_text("sql_array_subquery", "SELECT r_regionkey, SIZE(ARRAY(SELECT n_nationkey FROM nation)) AS n, ARRAY_JOIN(SORT_ARRAY(ARRAY(SELECT n_name FROM nation WHERE n_regionkey = r_regionkey)), ',') AS names, ARRAY(SELECT n_name FROM nation WHERE n_nationkey > 1000) IS EMPTY AS none, MULTISET(SELECT n_name FROM nation) IS NOT EMPTY AS some FROM region", "SELECT r_regionkey, 25 AS n, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) AS names, true AS none, true AS some FROM region", "nation", "region")
_text("sql_local_times", "SELECT EXTRACT(SECOND FROM LOCALTIMESTAMP(0)) = FLOOR(EXTRACT(SECOND FROM LOCALTIMESTAMP(0))) AS whole, LOCALTIMESTAMP >= LOCALTIMESTAMP(3) AS cut, TYPEOF(LOCALTIME) AS t, TYPEOF(LOCALTIME(3)) AS t3, TYPEOF(LOCALTIMESTAMP(3)) AS ts, CURRENT_DATE = CAST(LOCALTIMESTAMP AS DATE) AS today", "SELECT true AS whole, true AS cut, 'time(6)' AS t, 'time(3)' AS t3, 'timestamp_ntz' AS ts, true AS today")
_text("measure", "SELECT o_orderstatus, AGGREGATE(price) AS price, AGGREGATE(n) AS n FROM (SELECT o_orderstatus, o_orderpriority, CAST(AVG(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS MEASURE price, COUNT(DISTINCT o_custkey) AS MEASURE n FROM orders) GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(AVG(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS price, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus", "orders")
_text("measure_integer", f"SELECT AGGREGATE(m) AS a FROM (SELECT region, AVG(amount) AS MEASURE m FROM {SALES})", f"SELECT CAST(SUM(amount) // COUNT(amount) AS INT) AS a FROM {SALES}")
_text("two_level_correlation", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49 AND l.l_suppkey > c.c_nationkey))", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49 AND l.l_suppkey > c.c_nationkey))", "customer", "orders", "lineitem")
_text("dual", "SELECT DUMMY, 1 + 1 AS two FROM DUAL", "SELECT 'X' AS DUMMY, 2 AS two")


@query("sql_approximate_distinct", "SELECT true AS close, 5 AS priorities")
def _approximate(spark, sf_dir):
    near = _engine(spark, sf_dir, "orders", approximateDistinctCount=True).execute("SELECT COUNT(DISTINCT o_custkey) AS n, COUNT(DISTINCT o_orderpriority) AS p FROM orders")
    exact = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("COUNT(DISTINCT o_custkey) AS e")
    return near.join(exact).selectExpr("ABS(n - e) <= 0.15 * e AS close", "CAST(p AS INT) AS priorities")


@query("ctas", "SELECT n_regionkey AS R, COUNT(*) AS N FROM nation GROUP BY n_regionkey")
def _ctas(spark, sf_dir):
    engine, name = _engine(spark, sf_dir, "nation"), f"t_{uuid.uuid4().hex[:8]}"
    engine.execute_non_query(f"CREATE TABLE {name} AS SELECT n_regionkey AS R, COUNT(*) AS N FROM nation GROUP BY n_regionkey")
    return engine.execute(f"SELECT * FROM {name}")


@query("batch", "SELECT CAST(1 AS BIGINT) AS k, COUNT(*) AS n FROM nation UNION ALL SELECT 2, COUNT(*) FROM region UNION ALL SELECT 3, 0")
def _batch(spark, sf_dir):
    engine, name = _engine(spark, sf_dir, "nation", "region"), f"t_{uuid.uuid4().hex[:8]}"
    found = engine.batch(["SELECT COUNT(*) AS n FROM nation", "SELECT COUNT(*) AS n FROM region", f"CREATE TABLE {name} (A INTEGER)"])
    return spark.createDataFrame([(i + 1, d.first()[0]) for i, d in enumerate(found)], "k long, n long")


@query("parameters_dml", "SELECT n_nationkey AS K, CASE WHEN n_regionkey = 1 THEN 'it''s' ELSE n_name END AS NAME, n_regionkey AS R FROM nation WHERE n_nationkey <> 3")
def _parameters_dml(spark, sf_dir):
    engine, t = _nations(spark, sf_dir)
    engine.execute_non_query(f"UPDATE {t} SET NAME = ? WHERE R = ?", ["it's", 1])
    engine.execute_non_query(f"DELETE FROM {t} WHERE K = ?", [3])
    return engine.execute(f"SELECT * FROM {t}")


@query("get_schema", "SELECT 'N_NATIONKEY' AS name, 1 AS place, 'int' AS kind UNION ALL SELECT 'N_NAME', 2, 'string' UNION ALL SELECT 'N_REGIONKEY', 3, 'int'")
def _schema(spark, sf_dir):
    engine = _engine(spark, sf_dir, "nation")
    return engine.schema("Columns").where("upper(TABLE_NAME) = 'NATION'").selectExpr("upper(COLUMN_NAME) AS name", "ORDINAL_POSITION AS place", "DATA_TYPE AS kind")


# ---- another database: SQLite files, which Python brings along, filled from the smallest tables


def _connect(path: str):
    import sqlite3

    return sqlite3.connect(path)


def _database(spark: SparkSession, sf_dir: str) -> federation.Database:
    """nation, region and supplier (bounded tables) as a SQLite file in the shared folder."""
    import sqlite3

    folder = own_dir(spark).removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{uuid.uuid4().hex}.sqlite"
    c = sqlite3.connect(path)
    for name, columns in (("nation", "n_nationkey INTEGER NOT NULL, n_name VARCHAR(25), n_regionkey INTEGER"), ("region", "r_regionkey INTEGER NOT NULL, r_name VARCHAR(25)"), ("supplier", "s_suppkey BIGINT NOT NULL, s_name VARCHAR(25), s_nationkey INTEGER, s_acctbal DOUBLE")):
        c.execute(f"CREATE TABLE {name} ({columns})")
        rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*(x.split()[0] for x in columns.split(", "))).collect()]
        c.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    c.commit()
    c.close()
    return federation.Database(spark, functools.partial(_connect, path), "SQLite", sqlite3.sqlite_version)


def _remote(name: str, sql: str):
    def put(f):
        QUERIES[name] = (lambda spark, sf_dir: f(_database(spark, sf_dir), spark, sf_dir), sql)
        return f

    return put


@_remote("federated_scan", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 1000 AND s_nationkey IN (1, 2, 3, 4) AND s_name <> 'x'")
def _fed_scan(db, spark, sf_dir):
    return db.table("supplier").read().where("s_acctbal > 1000 AND s_nationkey IN (1, 2, 3, 4) AND s_name <> 'x'").select("s_suppkey", "s_name")


@_remote("federated_filter_project", "SELECT s_suppkey, s_acctbal * 2 AS twice, upper(s_name) AS big FROM supplier WHERE s_acctbal BETWEEN 0 AND 5000 OR s_nationkey = 7")
def _fed_filter(db, spark, sf_dir):
    return db.table("supplier").where("s_acctbal BETWEEN 0 AND 5000 OR s_nationkey = 7").select("s_suppkey", twice=("s_acctbal * 2", "double"), big=("UPPER(s_name)", "string")).read()


@_remote("federated_join", "SELECT n_name, r_name, s_suppkey FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey")
def _fed_join(db, spark, sf_dir):
    nations = db.table("nation").join(db.table("region"), [("n_regionkey", "r_regionkey")])
    return nations.join(db.table("supplier"), [("n_nationkey", "s_nationkey")], "left").read().select("n_name", "r_name", "s_suppkey")


@_remote("federated_aggregate", "SELECT s_nationkey, COUNT(*) AS n, MAX(s_acctbal) AS top, COUNT(*) FILTER (WHERE s_acctbal > 0) AS p FROM supplier GROUP BY s_nationkey")
def _fed_aggregate(db, spark, sf_dir):
    return db.table("supplier").aggregate(["s_nationkey"], n=("COUNT(*)", "bigint"), top=("MAX(s_acctbal)", "double"), p=("COUNT(*) FILTER (WHERE s_acctbal > 0)", "bigint")).read()


@_remote("federated_top", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5 OFFSET 2")
def _fed_top(db, spark, sf_dir):
    return db.table("supplier").select("s_suppkey", "s_acctbal").sort("s_acctbal DESC", "s_suppkey", limit=5, offset=2).read()


@_remote("federated_sets", "(SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION (SELECT n_regionkey FROM nation INTERSECT SELECT r_regionkey FROM region)")
def _fed_sets(db, spark, sf_dir):
    rich = db.table("supplier").where("s_acctbal > 5000").select("s_nationkey")
    left = db.table("nation").select(k=("n_nationkey", "int")).minus(rich)
    return left.union(db.table("nation").select(k=("n_regionkey", "int")).intersect(db.table("region").select("r_regionkey"))).read()


@_remote("federated_values", "SELECT n_name, v FROM nation JOIN (VALUES (1, 'one'), (3, 'it''s')) AS t(k, v) ON n_nationkey = k")
def _fed_values(db, spark, sf_dir):
    return db.table("nation").join(db.values([(1, "one"), (3, "it's")], "k int, v string"), [("n_nationkey", "k")]).read().select("n_name", "v")


@_remote("federated_correlate", "SELECT r_regionkey, s.s_suppkey FROM region LEFT JOIN (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 3000) s ON s.s_nationkey = r_regionkey")
def _fed_correlate(db, spark, sf_dir):
    outer = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey")
    return db.correlate(outer, "SELECT s_suppkey FROM supplier WHERE s_nationkey = ? AND s_acctbal > 3000", "s_suppkey long", ["r_regionkey"], "left")


@_remote("federated_with_local", "SELECT n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _fed_local(db, spark, sf_dir):
    local = spark.read.parquet(f"{sf_dir}/customer.parquet")
    remote = db.table("nation").select("n_nationkey", "n_name").read()
    return local.join(remote, local.c_nationkey == remote.n_nationkey).groupBy("n_name").count().withColumnRenamed("count", "n")


@_remote("federated_parallel", "SELECT s_suppkey, s_acctbal FROM supplier")
def _fed_parallel(db, spark, sf_dir):
    return db.table("supplier").select("s_suppkey", "s_acctbal").read(split=("s_suppkey % 3 = ?", [(0,), (1,), (2,)]))


@_remote("federated_metadata", "SELECT * FROM (VALUES ('nation', 'n_nationkey', 'int', false), ('nation', 'n_name', 'string', true), ('nation', 'n_regionkey', 'int', true), ('region', 'r_regionkey', 'int', false), ('region', 'r_name', 'string', true), ('supplier', 's_suppkey', 'bigint', false), ('supplier', 's_name', 'string', true), ('supplier', 's_nationkey', 'int', true), ('supplier', 's_acctbal', 'double', true)) AS t(tab, col, kind, nullable)")
def _fed_metadata(db, spark, sf_dir):
    return db.metadata().selectExpr("TABLE_NAME AS tab", "COLUMN_NAME AS col", "DATA_TYPE AS kind", "IS_NULLABLE AS nullable")
