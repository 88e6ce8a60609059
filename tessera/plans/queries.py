"""One query per operator, over the tables of a folder, with the same in DuckDB's SQL.

SAME: text that both engines read alike. Others pair a function, mostly an operator of this package, with SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars, udf
from tessera.operators import collections, dynamic
from tessera.operators.combine import combine, numbered
from tessera.operators.joins import asof_join, mark_join, null_safe_join, range_join
from tessera.operators.match import match_sequence
from tessera.operators.recursion import repeat_union
from tessera.operators.setops import merge_union
from tessera.operators.windows import CURRENT_ROW, GROUP, TIES, exclude_window
from tessera.plans import session_queries
from tessera.plans.frontend import translate
from tessera.streaming import windows

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Six rows with a tie, a null and two groups.
SALES = "(VALUES (1, 'EAST', 10, 'A'), (2, 'EAST', 20, 'B'), (3, 'EAST', 20, 'C'), (4, 'WEST', 30, 'D'), (5, 'WEST', NULL, 'E'), (6, 'WEST', 5, 'F')) AS sales(id, region, amount, label)"
MONEY = "CAST(SUM(CAST({} AS DECIMAL(18,4))) AS DOUBLE)"


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    for name in TABLES:
        if name in text:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {SALES}")


def text_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, sql)
        return spark.sql(translate(sql))

    return run


NULLED = "(SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS ck, o_orderpriority, o_totalprice FROM orders)"

SAME: dict[str, str] = {
    "scan_filter_project": "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS doubled FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45",
    "values_rows": f"SELECT id, region, amount, label FROM {SALES}",
    "inner_join": "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'",
    "left_join": f"SELECT o.o_orderkey, o.ck, c.c_name FROM {NULLED} o LEFT JOIN customer c ON o.ck = c.c_custkey AND c.c_acctbal > 0",
    "right_join": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'",
    "full_join": "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_acctbal > c_acctbal",
    "theta_join": "SELECT n.n_name, s.s_suppkey FROM nation n JOIN supplier s ON n.n_nationkey < s.s_nationkey AND s.s_acctbal > 5000",
    "semi_join": "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "anti_join": "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)",
    "cross_join": "SELECT r.r_name, x.v FROM region r CROSS JOIN (VALUES (1), (2), (3)) AS x(v)",
    "lateral_topn": "SELECT c.c_custkey, t.o_orderkey, t.o_totalprice FROM customer c, LATERAL (SELECT o_orderkey, o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT MAX(o_totalprice) * 0.9 FROM orders)",
    "correlated_subquery": "SELECT c_custkey, (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c",
    "correlated_inequality": f"SELECT a.id, (SELECT COUNT(*) FROM {SALES.replace('sales(', 'b(')} WHERE b.region = a.region AND b.id > a.id) AS n FROM {SALES.replace('sales(', 'a(')}",
    "not_in_nulls": f"SELECT id FROM {SALES} WHERE amount NOT IN (SELECT amount FROM {SALES.replace('sales(', 'b(')} WHERE b.id > 5)",
    "row_valued_in": f"SELECT id FROM {SALES} WHERE (region, label) IN (SELECT region, label FROM {SALES.replace('sales(', 'b(')} WHERE b.id > 2)",
    "hash_agg": f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, {MONEY.format('l_extendedprice')} AS total, MIN(l_quantity) AS low, MAX(l_quantity) AS high FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "global_agg_empty": "SELECT COUNT(*) AS n, MAX(o_orderkey) AS m FROM orders WHERE o_orderkey < 0",
    "distinct_agg": "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS customers, COUNT(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus",
    "filter_agg": f"SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS finished, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS open_price FROM orders GROUP BY o_orderpriority",
    "grouping_sets": f"SELECT o_orderstatus, o_orderpriority, CAST(GROUPING(o_orderstatus) AS INT) AS g1, CAST(GROUPING(o_orderpriority) AS INT) AS g2, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
    "rollup": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    "distinct_rows": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "variance": "SELECT l_returnflag, ROUND(VAR_POP(l_quantity), 6) AS vp, ROUND(VAR_SAMP(l_quantity), 6) AS vs FROM lineitem GROUP BY l_returnflag",
    "window_rank": "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS rn, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr FROM orders",
    "window_rows": f"SELECT id, SUM(id) OVER (PARTITION BY region ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s, COUNT(amount) OVER (PARTITION BY region ORDER BY id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS c, MIN(amount) OVER (PARTITION BY region ORDER BY id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS m FROM {SALES}".replace("SUM(id) OVER (PARTITION BY region ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)", "CAST(SUM(id) OVER (PARTITION BY region ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT)"),
    "window_range": "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM events",
    "window_range_peers": f"SELECT id, CAST(SUM(amount) OVER (PARTITION BY region ORDER BY amount RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM {SALES}",
    "window_lead_lag": "SELECT event_id, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, LEAD(event_type, 2, 'none') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after2 FROM events",
    "window_nth_ntile": "SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER w AS f, LAST_VALUE(o_orderkey) OVER w AS l, NTH_VALUE(o_orderkey, 2) OVER w AS n2, CAST(NTILE(3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS t FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "window_null_partition": f"SELECT o_orderkey, COUNT(*) OVER (PARTITION BY ck) AS n FROM {NULLED} o",
    "union_all": "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region",
    "union_distinct": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "intersect_distinct": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer",
    "intersect_all": f"SELECT amount FROM {SALES} INTERSECT ALL SELECT amount FROM {SALES.replace('sales(', 'b(')} WHERE b.id <> 3",
    "except_distinct": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000",
    "except_all": f"SELECT amount FROM {SALES} EXCEPT ALL SELECT amount FROM {SALES.replace('sales(', 'b(')} WHERE b.id = 3",
    "batch_nested_loop": "SELECT n.n_nationkey, s.s_suppkey FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > n.n_nationkey * 300",
    "range_join_text": "SELECT o_orderkey, n_nationkey FROM orders JOIN nation ON o_totalprice >= n_nationkey * 20000 AND o_totalprice < n_nationkey * 20000 + 30000",
    "sorted_agg": "SELECT l_orderkey, COUNT(*) AS n, MAX(l_quantity) AS high FROM (SELECT * FROM lineitem ORDER BY l_orderkey) GROUP BY l_orderkey",
    "correlated_two_inequalities": f"SELECT s.id, (SELECT COUNT(*) FROM {SALES.replace('sales(', 'x(')} WHERE x.amount > s.amount AND x.id < s.id) AS n FROM {SALES.replace('sales(', 's(')} WHERE s.id < s.amount",
    "mode_bit_and": "SELECT o_orderpriority, MODE(o_orderstatus) AS m, BIT_AND(o_orderkey) AS b, BIT_OR(o_orderkey) AS o FROM orders GROUP BY o_orderpriority",
    "window_range_null_key": f"SELECT id, COUNT(*) OVER (PARTITION BY region ORDER BY amount NULLS LAST RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS n FROM {SALES}",
    "nvl": f"SELECT id, COALESCE(amount, 0 - 1) AS a FROM {SALES}",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "recursive_union_all": "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t",
    "case_coalesce": f"SELECT id, CASE WHEN amount > 10 THEN 'high' WHEN amount IS NULL THEN 'none' ELSE 'low' END AS grade, COALESCE(amount, -1) AS a, amount IS DISTINCT FROM 20 AS d FROM {SALES}",
    "string_funcs": "SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l, c_name || '/' || c_mktsegment AS j FROM customer WHERE c_name LIKE '%1_'",
    "interval_arith": "SELECT o_orderkey, o_orderdate + INTERVAL '1' DAY AS d, o_orderdate - INTERVAL '2' MONTH AS m FROM orders",
    "revenue_by_nation": f"SELECT n_name, c_mktsegment, {MONEY.format('l_extendedprice * (1 - l_discount)')} AS revenue, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY n_name, c_mktsegment",
}

#: (Spark text, DuckDB text): one dialect's words differ.
PAIRS: dict[str, tuple[str, str]] = {
    "any_value_mode": (
        "SELECT o_custkey, MAX_BY(o_orderkey, STRUCT(o_totalprice, o_orderkey)) AS top, MIN_BY(o_orderkey, STRUCT(o_totalprice, o_orderkey)) AS low, BIT_OR(o_orderkey) AS bits, ANY_VALUE(o_custkey) AS any_key FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, ARG_MAX(o_orderkey, (o_totalprice, o_orderkey)) AS top, ARG_MIN(o_orderkey, (o_totalprice, o_orderkey)) AS low, BIT_OR(o_orderkey) AS bits, ANY_VALUE(o_custkey) AS any_key FROM orders GROUP BY o_custkey",
    ),
    "listagg_ordered": (
        f"SELECT region, LISTAGG(label, ',') WITHIN GROUP (ORDER BY amount DESC NULLS LAST, id) AS labels, COUNT(*) AS n FROM {SALES} GROUP BY region",
        f"SELECT region, STRING_AGG(label, ',' ORDER BY amount DESC NULLS LAST, id) AS labels, COUNT(*) AS n FROM {SALES} GROUP BY region",
    ),
    "topk_offset": (
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 10 ROWS FETCH NEXT 20 ROWS ONLY",
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10",
    ),
    "nulls_high_order": (
        f"SELECT id, amount FROM {SALES} ORDER BY amount DESC, id FETCH FIRST 3 ROWS ONLY",
        f"SELECT id, amount FROM {SALES} ORDER BY amount DESC NULLS FIRST, id LIMIT 3",
    ),
    "row_number_unordered": (
        "SELECT COUNT(*) AS n, MAX(rn) AS m FROM (SELECT CAST(ROW_NUMBER() OVER () AS BIGINT) AS rn FROM nation)",
        "SELECT COUNT(*) AS n, MAX(rn) AS m FROM (SELECT ROW_NUMBER() OVER () AS rn FROM nation)",
    ),
    "json_value": (
        "SELECT event_id, CAST(JSON_VALUE(props, '$.k') AS INT) AS k, JSON_EXISTS(props, '$.k') AS has_k, JSON_EXISTS(props, '$.zz') AS has_z FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_exists(props, '$.k') AS has_k, json_exists(props, '$.zz') AS has_z FROM events",
    ),
    "unnest_lateral_text": (
        "SELECT r_name, u.x FROM region, UNNEST(ARRAY[r_regionkey, r_regionkey + 10]) AS u(x)",
        "SELECT r_name, u.x FROM region, UNNEST([r_regionkey, r_regionkey + 10]) AS u(x)",
    ),
    "window_ignore_nulls": (
        f"SELECT id, LAST_VALUE(amount) IGNORE NULLS OVER (PARTITION BY region ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM {SALES}",
        f"SELECT id, LAST_VALUE(amount IGNORE NULLS) OVER (PARTITION BY region ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM {SALES}",
    ),
    "collect_over": (
        f"SELECT id, TO_JSON(COLLECT_LIST(id) OVER (PARTITION BY region ORDER BY id)) AS ids FROM {SALES}",
        f"SELECT id, CAST(to_json(list(id) OVER (PARTITION BY region ORDER BY id)) AS VARCHAR) AS ids FROM {SALES}",
    ),
    "json_arrayagg": (
        f"SELECT region, JSON_ARRAYAGG(amount ORDER BY id DESC) AS a, JSON_ARRAYAGG(label) AS l FROM {SALES} GROUP BY region".replace("ORDER BY id DESC", "ORDER BY -id"),
        f"SELECT region, CAST(to_json(list(amount ORDER BY id DESC) FILTER (WHERE amount IS NOT NULL)) AS VARCHAR) AS a, CAST(to_json(list(label ORDER BY label)) AS VARCHAR) AS l FROM {SALES} GROUP BY region",
    ),
    "casts": (
        "SELECT n_nationkey, CAST(n_nationkey AS DECIMAL(9,2)) AS d, CAST(n_name AS VARCHAR(5)) AS v, CAST(n_nationkey AS TINYINT UNSIGNED) AS u, CAST(CAST(n_nationkey AS CHAR(4)) AS VARCHAR) AS c, CAST(n_nationkey AS FLOAT) AS f FROM nation",
        "SELECT n_nationkey, CAST(n_nationkey AS DECIMAL(9,2)) AS d, left(n_name, 5) AS v, CAST(n_nationkey AS SMALLINT) AS u, rpad(CAST(n_nationkey AS VARCHAR), 4, ' ') AS c, CAST(n_nationkey AS DOUBLE) AS f FROM nation",
    ),
    "intervals": (
        "SELECT o_orderkey, o_orderdate + INTERVAL '1' YEAR AS y, o_orderdate + INTERVAL '1-2' YEAR TO MONTH AS ym, o_orderdate + INTERVAL '1 2' DAY TO HOUR AS dh, o_orderdate + INTERVAL '1 2:3' DAY TO MINUTE AS dm, o_orderdate + INTERVAL '1 2:3:4' DAY TO SECOND AS ds, o_orderdate - INTERVAL '2:3' HOUR TO MINUTE AS hm, o_orderdate + INTERVAL '2:3:4' HOUR TO SECOND AS hs, o_orderdate + INTERVAL '3:4' MINUTE TO SECOND AS ms FROM orders",
        "SELECT o_orderkey, o_orderdate + INTERVAL 1 YEAR AS y, o_orderdate + INTERVAL 14 MONTH AS ym, o_orderdate + INTERVAL 26 HOUR AS dh, o_orderdate + INTERVAL 1563 MINUTE AS dm, o_orderdate + INTERVAL 93784 SECOND AS ds, o_orderdate - INTERVAL 123 MINUTE AS hm, o_orderdate + INTERVAL 7384 SECOND AS hs, o_orderdate + INTERVAL 184 SECOND AS ms FROM orders",
    ),
    "asof_sql": (
        f"SELECT a.id AS id, b.id AS near FROM {SALES.replace('sales(', 'a(')} LEFT ASOF JOIN (SELECT * FROM {SALES} WHERE id > 3) b MATCH_CONDITION b.id <= a.id ON a.region = b.region",
        f"SELECT a.id AS id, b.id AS near FROM {SALES.replace('sales(', 'a(')} ASOF LEFT JOIN (SELECT * FROM {SALES} WHERE id > 3) b ON a.region = b.region AND a.id >= b.id",
    ),
}

OPERATORS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def operator(name: str, sql: str | None = None):
    def put(f):
        OPERATORS[name] = (f, sql)
        return f

    return put


def _nulled(spark, sf_dir):
    views(spark, sf_dir, "orders")
    return spark.sql(f"SELECT * FROM {NULLED} o")


@operator("null_safe_join", f"SELECT a.o_orderkey, b.n FROM {NULLED} a JOIN (SELECT ck, COUNT(*) AS n FROM {NULLED} x GROUP BY ck) b ON a.ck IS NOT DISTINCT FROM b.ck")
def _null_safe(spark, sf_dir):
    a = _nulled(spark, sf_dir)
    b = _nulled(spark, sf_dir).groupBy(F.col("ck").alias("bk")).agg(F.count("*").alias("n"))
    return null_safe_join(a, b, [("ck", "bk")]).select("o_orderkey", "n")


@operator("merge_join", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'")
def _merge_join(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), table(spark, sf_dir, "lineitem")
    return o.hint("merge").join(li, o.o_orderkey == li.l_orderkey).select("o_orderkey", "l_linenumber")


@operator("mark_join_in", f"SELECT id, amount IN (SELECT amount FROM {SALES.replace('sales(', 'b(')} WHERE b.id >= 4) AS mark FROM {SALES}")
def _mark(spark, sf_dir):
    return mark_join(sales(spark), sales(spark).where("id >= 4"), [("amount", "amount")]).select("id", "mark")


@operator("mark_join_orders", f"SELECT c_custkey, c_custkey IN (SELECT ck FROM {NULLED} o WHERE o.o_totalprice > 250000) AS mark FROM customer")
def _mark_orders(spark, sf_dir):
    return mark_join(table(spark, sf_dir, "customer"), _nulled(spark, sf_dir).where("o_totalprice > 250000"), [("c_custkey", "ck")]).select("c_custkey", "mark")


@operator("mark_join_empty", f"SELECT id, amount IN (SELECT amount FROM {SALES.replace('sales(', 'b(')} WHERE b.id > 100) AS mark FROM {SALES}")
def _mark_empty(spark, sf_dir):
    return mark_join(sales(spark), sales(spark).where("id > 100"), [("amount", "amount")]).select("id", "mark")


@operator("mark_join_pairs", f"SELECT id, (SELECT CASE WHEN bool_or(region = r2 AND amount = a2) THEN true WHEN bool_or((region = r2 AND amount = a2) IS NULL) THEN NULL ELSE false END FROM (SELECT region AS r2, amount AS a2 FROM {SALES.replace('sales(', 'b(')} WHERE b.id > 2)) AS mark FROM {SALES}")
def _mark_pairs(spark, sf_dir):
    return mark_join(sales(spark), sales(spark).where("id > 2"), [("region", "region"), ("amount", "amount")]).select("id", "mark")


_CLICK = "(SELECT event_id, user_id, ts, value FROM events WHERE event_type = (SELECT MIN(event_type) FROM events))"


def _asof(op, how, sign):
    def run(spark, sf_dir):
        e = table(spark, sf_dir, "events")
        first = e.agg(F.min("event_type").alias("t"))
        right = e.join(F.broadcast(first), e.event_type == first.t, "left_semi").select("event_id", "user_id", "ts", "value")
        return asof_join(e.select("event_id", "user_id", "ts"), right, [("user_id", "user_id")], ("ts", "ts"), op, how).select("event_id", F.col("r_event_id").alias("near"), F.col("r_value").alias("value"))

    join = "ASOF LEFT JOIN" if how == "left" else "ASOF JOIN"
    return run, f"SELECT a.event_id, b.event_id AS near, b.value FROM events a {join} {_CLICK} b ON a.user_id = b.user_id AND a.ts {sign} b.ts"


for _name, _op, _how, _sign in (("asof_inner", "<=", "inner", ">="), ("asof_left", "<=", "left", ">="), ("asof_strict", "<", "left", ">"), ("asof_forward", ">", "inner", "<"), ("asof_forward_equal", ">=", "left", "<=")):
    OPERATORS[_name] = _asof(_op, _how, _sign)


@operator("integer_agg", f"SELECT region, CAST(SUM(amount) AS INT) AS s, CAST(SUM(amount) // NULLIF(COUNT(amount), 0) AS INT) AS a FROM {SALES} GROUP BY region")
def _integers(spark, sf_dir):
    return sales(spark).groupBy("region").agg(scalars.int_sum("amount").alias("s"), scalars.int_avg("amount").alias("a"))


@operator("approx_distinct", "SELECT o_orderstatus, true AS close FROM orders GROUP BY o_orderstatus")
def _approx(spark, sf_dir):
    """A sketch's estimate has no SQL to equal; it lies within three of its standard errors of the exact count."""
    got = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey", 0.02).alias("near"), F.countDistinct("o_custkey").alias("exact"))
    return got.select("o_orderstatus", (F.abs(F.col("near") - F.col("exact")) <= 0.06 * F.col("exact")).alias("close"))


@operator("range_join", "SELECT o_orderkey, n_nationkey FROM orders JOIN nation ON o_totalprice >= n_nationkey * 20000 AND o_totalprice < n_nationkey * 20000 + 30000 AND n_regionkey <> 9")
def _range_join(spark, sf_dir):
    bands = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 20000).alias("low"), (F.col("n_nationkey") * 20000 + 30000).alias("high"))
    return range_join(table(spark, sf_dir, "orders"), bands, "o_totalprice", "low", "high").select("o_orderkey", "n_nationkey")


def _excluding(kind, sql_kind):
    def run(spark, sf_dir):
        e = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice").withColumn("c", F.round(F.col("o_totalprice") * 100).cast("long"))
        out = exclude_window(e, ["o_custkey"], [F.col("o_orderpriority").asc_nulls_last()], "c", {"s": "sum", "n": "count", "low": "min"}, kind, None, 0, ["o_orderkey"])
        return out.select("o_orderkey", "s", "n", "low")

    return run, sql_kind


def _exclude_sql(kind: str, keep: str) -> str:
    """DuckDB's frames need one order for rows and peers, so its side goes through the frame's rows."""
    return f"""
    WITH o AS (SELECT o_orderkey, o_custkey, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS c, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rn, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS pk FROM orders)
    SELECT a.o_orderkey, CAST(SUM(b.c) AS BIGINT) AS s, COUNT(b.c) AS n, MIN(b.c) AS low FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.rn <= a.rn AND ({keep}) GROUP BY a.o_orderkey"""


OPERATORS["window_exclude_current"] = _excluding(CURRENT_ROW, _exclude_sql("CURRENT ROW", "b.rn <> a.rn"))
OPERATORS["window_exclude_ties"] = _excluding(TIES, _exclude_sql("TIES", "b.pk <> a.pk OR b.rn = a.rn"))
OPERATORS["window_exclude_group"] = _excluding(GROUP, _exclude_sql("GROUP", "b.pk <> a.pk"))


@operator("window_exclude_sales", f"SELECT id, CAST(SUM(amount) OVER (PARTITION BY region ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS s FROM {SALES}")
def _exclude_sales(spark, sf_dir):
    return exclude_window(sales(spark), ["region"], [F.col("id")], "amount", {"s": "sum"}, CURRENT_ROW, None, None).select("id", "s")


@operator("merge_union_limit", "SELECT k, v FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O') ORDER BY v DESC, k LIMIT 15 OFFSET 5")
def _merge_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    parts = [o.where(F.col("o_orderstatus") == s).select("k", "v") for s in "FO"]
    return merge_union(parts, [F.col("v").desc(), F.col("k")], fetch=15, offset=5)


_EDGES = "(SELECT c_custkey AS a, c_custkey // 2 AS b FROM customer WHERE c_custkey > 1)"


@operator("recursive_union_distinct", f"WITH RECURSIVE t(s, a) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT t.s, e.b FROM t JOIN {_EDGES} e ON e.a = t.a) SELECT s, a FROM t")
def _recursive(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    edges = c.where("c_custkey > 1").select(F.col("c_custkey").alias("x"), F.floor(F.col("c_custkey") / 2).alias("b"))
    seed = c.select(F.col("c_custkey").alias("s"), F.col("c_custkey").alias("a"))
    return repeat_union(seed, lambda t: t.join(edges, t.a == edges.x).select("s", F.col("b").alias("a")))


@operator("tumble", "SELECT event_id, ts, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 hour' AS window_end FROM events")
def _tumble(spark, sf_dir):
    return windows.tumble(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "1 hour")


@operator("tumble_offset", "SELECT event_id, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01 00:10:00') AS window_start FROM events")
def _tumble_offset(spark, sf_dir):
    return windows.tumble(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "1 hour", "10 minutes").select("event_id", "window_start")


@operator("tumble_agg", "SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def _tumble_agg(spark, sf_dir):
    return windows.windowed_counts(table(spark, sf_dir, "events"), "ts", "1 day", ["event_type"], "1 hour")


@operator("hop", "SELECT event_id, s AS window_start, s + INTERVAL '1 hour' AS window_end FROM (SELECT event_id, ts, unnest([time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') - INTERVAL '30 minutes']) AS s FROM events) WHERE s <= ts AND ts < s + INTERVAL '1 hour'")
def _hop(spark, sf_dir):
    return windows.hop(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "30 minutes", "1 hour").drop("ts")


@operator("session_rows", "SELECT event_id, MIN(ts) OVER w AS window_start, MAX(ts) OVER w + INTERVAL '6 hours' AS window_end FROM (SELECT *, SUM(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts < LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' THEN 0 ELSE 1 END AS f FROM events)) WINDOW w AS (PARTITION BY user_id, s)")
def _session(spark, sf_dir):
    return windows.session(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "ts", ["user_id"], "6 hours").select("event_id", "window_start", "window_end")


@operator("unnest_array", "SELECT vec_id, unnest(embedding) AS embedding FROM embeddings")
def _unnest(spark, sf_dir):
    return collections.unnest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), ["embedding"])


@operator("unnest_ordinality", "SELECT vec_id, unnest(embedding) AS embedding, CAST(unnest(range(1, len(embedding) + 1)) AS BIGINT) AS n FROM embeddings")
def _ordinality(spark, sf_dir):
    return collections.unnest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), ["embedding"], ordinality="n")


@operator("unnest_product", f"SELECT id, x, y FROM {SALES}, UNNEST([id, id * 10]) AS a(x), UNNEST([region, label]) AS b(y)")
def _product(spark, sf_dir):
    return collections.unnest(sales(spark).select("id", F.array("id", F.col("id") * 10).alias("x"), F.array("region", "label").alias("y")), ["x", "y"])


@operator("collect_array", "SELECT c_mktsegment, CAST(to_json(list(c_custkey ORDER BY c_custkey)) AS VARCHAR) AS keys FROM customer GROUP BY c_mktsegment")
def _collect(spark, sf_dir):
    out = collections.collect_array(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), [F.col("c_custkey")], ["c_mktsegment"])
    return out.select("c_mktsegment", F.to_json("items").alias("keys"))


@operator("collect_nulls", f"SELECT CAST(to_json(list(amount ORDER BY amount NULLS FIRST)) AS VARCHAR) AS items FROM {SALES}")
def _collect_nulls(spark, sf_dir):
    out = collections.collect_multiset(sales(spark).select("amount"))
    return out.select(F.to_json(F.array_sort(F.filter("items", lambda x: x.isNotNull()))).alias("known"), F.filter("items", lambda x: x.isNull()).alias("none")).select(F.concat(F.lit("["), F.array_join(F.transform("none", lambda x: F.lit("null")), ","), F.lit(","), F.substring("known", 2, 1 << 30)).alias("items"))


@operator("collect_map", "SELECT n_nationkey AS k, n_name AS v FROM nation")
def _collect_map(spark, sf_dir):
    return collections.collect_map(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")).select(F.explode("items").alias("k", "v"))


@operator("combine_queries", "SELECT n.place, r.r_name AS region, n.n_name AS nation FROM (SELECT n_name, ROW_NUMBER() OVER (ORDER BY n_nationkey) AS place FROM nation) n LEFT JOIN (SELECT r_name, ROW_NUMBER() OVER (ORDER BY r_regionkey) AS place FROM region) r ON r.place = n.place")
def _combine(spark, sf_dir):
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    out = combine({"r": (r.select("r_regionkey", "r_name"), ["r_regionkey"]), "n": (n.select("n_nationkey", "n_name"), ["n_nationkey"])})
    return out.select("place", F.col("r")["r_name"].alias("region"), F.col("n")["n_name"].alias("nation"))


ANYS = "(VALUES (1, 'EAST', '10'), (2, 'EAST', '20.5'), (3, 'WEST', '30'), (4, 'WEST', NULL), (5, 'WEST', '5')) AS anys(id, k, v)"


@operator("any_window", f"SELECT id, CAST(SUM(CAST(v AS DOUBLE)) OVER (ORDER BY id) AS DOUBLE) AS s, CAST(MIN(CAST(v AS DOUBLE)) OVER (PARTITION BY k) AS DOUBLE) AS low, CAST(MAX(CAST(v AS DOUBLE)) OVER (PARTITION BY k) AS DOUBLE) AS high FROM {ANYS}")
def _any_window(spark, sf_dir):
    d = spark.sql(f"SELECT id, k, parse_json(v) AS v FROM {ANYS}")
    return d.select("id", dynamic.any_sum("v", Window.orderBy("id")).cast("double").alias("s"), dynamic.any_min("v", Window.partitionBy("k")).cast("double").alias("low"), dynamic.any_max("v", Window.partitionBy("k")).cast("double").alias("high"))


WORDS = "(VALUES (1, 'EAST', '\"b\"'), (2, 'EAST', '\"a\"'), (3, 'WEST', '\"d\"'), (4, 'WEST', NULL), (5, 'WEST', '\"c\"')) AS words(id, k, v)"


@operator("any_strings", f"SELECT k, MIN(replace(v, '\"', '')) AS low, MAX(replace(v, '\"', '')) AS high FROM {WORDS} GROUP BY k")
def _any_strings(spark, sf_dir):
    d = spark.sql(f"SELECT id, k, parse_json(v) AS v FROM {WORDS}")
    return d.groupBy("k").agg(dynamic.any_min("v").alias("low"), dynamic.any_value("v").alias("high"))


@operator("any_agg", f"SELECT k, CAST(CAST(SUM(CAST(v AS DECIMAL(18,4))) AS DOUBLE) AS DOUBLE) AS s, CAST(AVG(CAST(v AS DOUBLE)) AS DOUBLE) AS a, CAST(MIN(CAST(v AS DOUBLE)) AS DOUBLE) AS low, CAST(MAX(CAST(v AS DOUBLE)) AS DOUBLE) AS high FROM {ANYS} GROUP BY k")
def _any(spark, sf_dir):
    d = spark.sql(f"SELECT id, k, parse_json(v) AS v FROM {ANYS}")
    return d.groupBy("k").agg(dynamic.any_sum("v").cast("double").alias("s"), dynamic.any_avg("v").cast("double").alias("a"), dynamic.any_min("v").cast("double").alias("low"), dynamic.any_max("v").cast("double").alias("high"))


@operator("char_padding", "SELECT n_nationkey, rpad(n_name, 10, ' ') AS padded FROM nation")
def _padding(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", scalars.pad_char("n_name", 10).alias("padded"))


@operator("posix_regex", "SELECT c_custkey FROM customer WHERE regexp_matches(c_mktsegment, '(?i)^build') AND NOT regexp_matches(c_name, '7$')")
def _posix(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(scalars.posix_match("c_mktsegment", "^build", case_sensitive=False) & scalars.posix_match("c_name", "7$", negated=True)).select("c_custkey")


@operator("collated_sort", f"SELECT id, region, ROW_NUMBER() OVER (ORDER BY lower(region), id DESC) AS place FROM (SELECT id, CASE WHEN id % 2 = 0 THEN lower(region) ELSE region END AS region FROM {SALES})")
def _collated(spark, sf_dir):
    d = sales(spark).withColumn("region", F.when(F.col("id") % 2 == 0, F.lower("region")).otherwise(F.col("region")))
    return numbered(d.select("id", "region"), [F.collate("region", "UTF8_LCASE"), F.col("id").desc()])


@operator("udf", "SELECT o_orderkey, o_orderkey * 3 + 1 AS y FROM orders")
def _udf(spark, sf_dir):
    f = udf.scalar_function(lambda x: None if x is None else int(x) * 3 + 1, "long")
    return table(spark, sf_dir, "orders").select("o_orderkey", f("o_orderkey").alias("y"))


@operator("udaf", "SELECT o_custkey, CAST(SUM(o_orderkey) AS BIGINT) AS s FROM orders GROUP BY o_custkey")
def _udaf(spark, sf_dir):
    add = lambda s, x: s + (x or 0)
    return udf.aggregate_by(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "s", lambda: 0, add, lambda s: s, "long")


@operator("udaf_merge", "SELECT l_returnflag, CAST(SUM(l_orderkey) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
def _udaf_merge(spark, sf_dir):
    add = lambda s, x: s + (x or 0)
    return udf.aggregate_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_orderkey", "s", lambda: 0, add, lambda s: s, "long", merge=add)


@operator("udaf_over", f"SELECT id, CAST(COALESCE(SUM(amount) OVER (ORDER BY id), 0) AS BIGINT) AS s FROM {SALES}")
def _udaf_over(spark, sf_dir):
    my_sum = udf.aggregate_function(lambda: 0, lambda s, x: s + int(x or 0), lambda s: s, "long")
    running = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sales(spark).select("id", my_sum("amount").over(running).alias("s"))


@operator("udtf", "SELECT r_regionkey, CAST(x AS INT) AS n FROM region, LATERAL (SELECT unnest(range(1, r_regionkey + 1)) AS x)")
def _udtf(spark, sf_dir):
    count = udf.table_function(lambda n: ((i,) for i in range(1, n + 1)), "n int")
    spark.udtf.register("numbers_to", count)
    views(spark, sf_dir, "region")
    return spark.sql("SELECT r_regionkey, t.n FROM region, LATERAL numbers_to(r_regionkey) t")


_MATCH = "SELECT o_custkey, o_orderkey AS s, next_key AS e FROM (SELECT *, LEAD(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_key, LEAD(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_price, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE next_price > o_totalprice"


@operator("match_concat", f"""WITH RECURSIVE m AS (SELECT o_custkey, s, e, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY s) AS k FROM ({_MATCH})),
t AS (SELECT * FROM m WHERE k = 1 UNION ALL SELECT n.* FROM t JOIN LATERAL (SELECT * FROM m WHERE m.o_custkey = t.o_custkey AND m.s > t.e ORDER BY m.s LIMIT 1) n ON TRUE) SELECT o_custkey, s, e FROM t""")
def _match(spark, sf_dir):
    up = lambda at: at("o_totalprice", 0) > at("o_totalprice", -1)
    return match_sequence(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], ["STRT", "UP"], {"UP": up}, {"s": ("STRT", "o_orderkey"), "e": ("UP", "o_orderkey")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: text_query(v) for k, v in SAME.items()}
    out |= {k: text_query(s) for k, (s, _) in PAIRS.items()}
    return out | {k: f for k, (f, _) in (OPERATORS | session_queries.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    out = dict(SAME)
    out |= {k: d for k, (_, d) in PAIRS.items()}
    return out | {k: s for k, (_, s) in (OPERATORS | session_queries.QUERIES).items() if s is not None}
