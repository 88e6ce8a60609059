"""Contracts of single operators that the queries don't reach."""

import itertools
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.functions.udf import aggregate_by
from tessera.operators import collections, dynamic
from tessera.operators.combine import combine, numbered
from tessera.operators.joins import asof_join, mark_join, range_join
from tessera.operators.match import match_sequence
from tessera.operators.recursion import repeat_union
from tessera.operators.setops import merge_union
from tessera.operators.windows import CURRENT_ROW, GROUP, NO_OTHERS, TIES, exclude_window
from tessera.plans import lineage
from tessera.streaming import windows

SALES = [(1, "EAST", 10, "A"), (2, "EAST", 20, "B"), (3, "EAST", 20, "C"), (4, "WEST", 30, "D"), (5, "WEST", None, "E"), (6, "WEST", 5, "F")]
SCHEMA = "id int, region string, amount int, label string"


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(SALES, SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


small = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
key = st.one_of(st.none(), st.integers(0, 2))


@small
@given(left=st.lists(st.tuples(key, key), max_size=8), right=st.lists(st.tuples(key, key, st.integers(0, 5)), max_size=8), op=st.sampled_from(["<=", "<", ">=", ">"]))
def test_asof_nearest(spark, left, right, op):
    lf = spark.createDataFrame([(i, *x) for i, x in enumerate(left)], "i int, k int, t int")
    rf = spark.createDataFrame(right, "k int, t int, v int")
    got = {r["i"]: (r["r_t"], r["r_v"]) for r in asof_join(lf, rf, [("k", "k")], ("t", "t"), op, "left", first=["v"]).collect()}
    test = {"<=": lambda a, b: a <= b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, ">": lambda a, b: a > b}[op]
    for i, (k, t) in enumerate(left):
        fits = [(r[1], r[2]) for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and test(r[1], t)]
        best = (max if op[0] == "<" else min)((x[0] for x in fits), default=None)
        assert got[i] == ((best, min(v for x, v in fits if x == best)) if fits else (None, None))


def test_asof_refuses(sales):
    with pytest.raises(ValueError):
        asof_join(sales, sales, [("region", "region")], ("id", "id"), "=")
    with pytest.raises(ValueError):
        asof_join(sales, sales, [("region", "region")], ("id", "id"), "<", "full")


@small
@given(left=st.lists(st.tuples(key, key), max_size=5), right=st.lists(st.tuples(key, key), max_size=5))
def test_mark_is_three_valued(spark, left, right):
    lf = spark.createDataFrame([(i, *x) for i, x in enumerate(left)], "i int, a int, b int")
    rf = spark.createDataFrame(right, "a int, b int")

    def equal(x, y):
        return None if x is None or y is None else x == y

    def conj(x, y):
        return False if x is False or y is False else None if x is None or y is None else True

    def mark(tests):
        tests = list(tests)
        return True if True in tests else None if None in tests else False

    one = {r["i"]: r["mark"] for r in mark_join(lf, rf, [("a", "a")]).collect()}
    two = {r["i"]: r["mark"] for r in mark_join(lf, rf, [("a", "a"), ("b", "b")]).collect()}
    for i, (a, b) in enumerate(left):
        assert one[i] is mark(equal(a, x) for x, _ in right)
        assert two[i] is mark(conj(equal(a, x), equal(b, y)) for x, y in right)


@pytest.mark.parametrize("kind", [NO_OTHERS, CURRENT_ROW, GROUP, TIES])
@pytest.mark.parametrize("frame", [(None, 0), (None, None), (-1, 1), (1, 2)])
def test_exclusions(sales, kind, frame):
    out = exclude_window(sales, ["region"], [F.col("amount").asc_nulls_last()], "amount", {"s": "sum", "n": "count", "a": "avg", "low": "min", "high": "max"}, kind, *frame, ["id"])
    got = {r["id"]: (r["s"], r["n"], r["a"], r["low"], r["high"]) for r in out.collect()}
    for _, part in itertools.groupby(sorted(SALES, key=lambda r: r[1]), key=lambda r: r[1]):
        part = sorted(part, key=lambda r: (r[2] is None, r[2] or 0, r[0]))
        for i, me in enumerate(part):
            low = 0 if frame[0] is None else max(0, i + frame[0])
            high = len(part) if frame[1] is None else min(len(part), i + frame[1] + 1)
            inside = [r for r in part[low:high] if {NO_OTHERS: True, CURRENT_ROW: r is not me, GROUP: r[2] != me[2], TIES: r[2] != me[2] or r is me}[kind]]
            v = [r[2] for r in inside if r[2] is not None]
            assert got[me[0]] == ((sum(v), len(v), sum(v) / len(v), min(v), max(v)) if v else (None, 0, None, None, None))


def test_recursion(spark):
    seed = spark.createDataFrame([(1,), (1,)], "n int")
    step = lambda t: t.where("n < 20").select((F.col("n") + 1).alias("n"))
    assert rows(repeat_union(seed, step)) == [(i,) for i in sorted(range(1, 21), key=lambda i: repr((i,)))]
    assert len(rows(repeat_union(seed, step, distinct=False, limit=2))) == 6
    assert rows(repeat_union(seed, step, limit=0)) == [(1,)]
    loop = repeat_union(seed, lambda t: t.select((F.col("n") % 3 + 1).alias("n")))
    assert rows(loop) == [(1,), (2,), (3,)]
    nothing = repeat_union(seed.where("n > 5"), step)
    assert rows(nothing) == []


def test_collections(spark, sales):
    whole = collections.collect_array(sales.select("amount"), [F.col("amount")]).first()[0]
    assert len(whole) == 6 and whole.count(None) == 1
    assert collections.collect_array(sales.where("id > 9").select("id")).first()[0] == []
    assert collections.collect_map(sales.select("region", "id")).first()[0] == {"EAST": 3, "WEST": 6}
    nested = spark.createDataFrame([(1, [(1, "a"), (2, "b")], {"x": 1}, [[1], [2, 3]], None)], "id int, s array<struct<n:int,c:string>>, m map<string,int>, d array<array<int>>, z array<int>")
    assert rows(collections.unnest(nested, ["s"], "i", keep=["id"])) == [(1, 1, "a", 1), (1, 2, "b", 2)]
    assert rows(collections.unnest(nested, ["m"], keep=[])) == [("x", 1)]
    assert rows(collections.unnest(nested, ["d"], keep=[])) == [([1],), ([2, 3],)]
    assert rows(collections.unnest(nested, ["z"], keep=["id"])) == []
    assert rows(collections.unnest(nested, ["z"], keep=["id"], outer=True)) == [(1, None)]
    assert [r[-1] for r in rows(collections.unnest(nested, ["s", "d"], "i", keep=[]))] == [1, 2, 3, 4]


def test_combine(spark, sales):
    out = combine({"a": (sales.select("id"), ["id"]), "b": (sales.where("id < 3").select("label"), ["label"])}).orderBy("place").collect()
    assert [r["a"] for r in out] == [{"id": str(i)} for i in range(1, 7)]
    assert [r["b"] for r in out] == [{"label": "A"}, {"label": "B"}] + [None] * 4


def test_dynamic(spark):
    d = spark.sql("SELECT id, parse_json(v) v, parse_json(s) s FROM VALUES (1, '10', '\"b\"'), (2, '20.5', '\"a\"'), (3, '30', '\"d\"'), (4, NULL, NULL), (5, '5', '\"c\"') AS t(id, v, s)")
    r = d.agg(dynamic.any_min("v"), dynamic.any_max("v"), dynamic.any_sum("v"), dynamic.any_avg("v"), dynamic.any_min("s"), dynamic.any_value("s")).first()
    assert (r[0], r[1], float(r[2]), float(r[3]), r[4], r[5]) == ("5", "30", 65.5, 16.375, "a", "d")
    with pytest.raises(Exception, match="arithmetic"):
        d.agg(dynamic.any_sum("s")).collect()
    with pytest.raises(Exception, match="mixed"):
        d.select(F.explode(F.array("v", "s")).alias("x")).agg(dynamic.any_min("x")).collect()


def test_match_goes_on_behind_a_match(spark):
    d = spark.createDataFrame([("p", i, v) for i, v in enumerate([1, 2, 3, 4, 1, 5])] + [("q", 0, 1)], "k string, i int, v int")
    up = lambda at: at("v", 0) > at("v", -1)
    out = match_sequence(d, ["k"], ["i"], ["STRT", "UP"], {"UP": up}, {"s": ("STRT", "i"), "e": ("UP", "i")})
    assert rows(out) == [("p", 0, 1), ("p", 2, 3), ("p", 4, 5)]
    three = match_sequence(d, ["k"], ["i"], ["A", "B", "C"], {"B": up, "C": up}, {"s": ("A", "v"), "e": ("C", "v")})
    assert rows(three) == [("p", 1, 3)]


def test_merge_union(sales):
    got = merge_union([sales.select("id"), sales.select("id")], [F.col("id")], distinct=True, fetch=2, offset=1).collect()
    assert [r[0] for r in got] == [2, 3]
    assert merge_union([sales.select("id"), sales.select("id")], [F.col("id")]).count() == 12


def test_window_tables(spark):
    e = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ '2024-01-01 00:00:00', 1), (TIMESTAMP_NTZ '2024-01-01 00:10:00', 2), (TIMESTAMP_NTZ '2024-01-01 01:00:00', 3), (TIMESTAMP_NTZ '2024-01-01 02:30:00', 4), (NULL, 5) AS t(ts, id)")
    assert [r["window_start"].hour for r in windows.tumble(e, "ts", "1 hour").orderBy("id").collect()] == [0, 0, 1, 2]
    assert windows.hop(e, "ts", "30 minutes", "1 hour").count() == 8
    s = windows.session(e.withColumn("k", F.lit(1)), "ts", ["k"], "'1' HOUR").orderBy("id").collect()
    assert [(r["window_start"].hour, r["window_end"].hour, r["window_end"].minute) for r in s] == [(0, 2, 0)] * 3 + [(2, 3, 30)]


def test_windows_of_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 10,0) AS ts, 'a' AS k FROM range(12)").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, k string").parquet(src)
    q = windows.windowed_counts(stream, "ts", "1 hour", ["k"], "10 minutes").writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert [r["n"] for r in spark.table("counted").orderBy("window_start").collect()] == [6, 6]


def test_scalars(spark):
    d = spark.sql("SELECT * FROM VALUES (1, -7, '{\"a\": 1, \"o\": {\"b\": 2}, \"n\": null}'), (1, -8, NULL), (2, NULL, '[1]') AS t(g, x, j)")
    assert rows(d.groupBy("g").agg(scalars.int_avg("x"), scalars.int_sum("x"))) == [(1, -7, -15), (2, None, None)]
    r = d.select(scalars.json_value("j", "lax $.a"), scalars.json_value("j", "$.o"), scalars.json_query("j", "$.o"), scalars.json_exists("j", "$.n"), scalars.json_exists("j", "$.z")).collect()
    assert tuple(r[0]) == ("1", None, '{"b":2}', True, False)
    assert r[1][4] is None
    assert d.select(scalars.pad_char(F.lit("ab"), 5), scalars.pad_char(F.lit("abcdef"), 3)).first()[:2] == ("ab   ", "abc")
    assert d.select(scalars.unsigned(F.lit(255), 8), scalars.unsigned(F.lit(str(2**64 - 1)), 64)).first()[0] == 255
    with pytest.raises(Exception, match="out of range"):
        d.select(scalars.unsigned(F.lit(256), 8)).collect()


@pytest.mark.parametrize("kind", [NO_OTHERS, CURRENT_ROW, GROUP, TIES])
@pytest.mark.parametrize("frame", [(None, -2), (None, 3), (2, None), (-3, None), (-2, -1), (0, 0), (-4, 4)])
def test_exclusions_of_any_frame(spark, kind, frame):
    r = random.Random(3)
    data = [(i, i % 2, r.choice([None, 1, 1, 2, 3, 3, 3, 5]), r.choice([None, *range(9)])) for i in range(30)]
    df = spark.createDataFrame(data, "id int, p int, o int, v int")
    out = exclude_window(df, ["p"], [F.col("o").asc_nulls_last()], "v", {"s": "sum", "n": "count", "a": "avg", "low": "min", "high": "max"}, kind, *frame, ["id"])
    got = {x["id"]: tuple(x)[4:] for x in out.collect()}
    for p in (0, 1):
        part = sorted((x for x in data if x[1] == p), key=lambda x: (x[2] is None, x[2] or 0, x[0]))
        for i, me in enumerate(part):
            inside = [x for j, x in enumerate(part) if (frame[0] is None or j >= i + frame[0]) and (frame[1] is None or j <= i + frame[1])]
            inside = [x for x in inside if {NO_OTHERS: True, CURRENT_ROW: x is not me, GROUP: x[2] != me[2], TIES: x[2] != me[2] or x is me}[kind]]
            v = [x[3] for x in inside if x[3] is not None]
            assert got[me[0]] == ((sum(v), len(v), sum(v) / len(v), min(v), max(v)) if v else (None, 0, None, None, None)), (me, kind, frame)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("width", [None, 0.5, 1000.0])
def test_range_join(spark, how, width):
    r = random.Random(4)
    left = [(i, r.choice([None, 0, 1]), r.choice([None, *[x / 2 for x in range(-10, 60)]])) for i in range(60)]
    right = [(i, r.choice([None, 0, 1]), float(a), a + r.choice([-1.0, 0.0, 0.5, 3.0, 40.0])) for i, a in enumerate(r.choices(range(-9, 30), k=40))] + [(99, 0, None, 4.0), (98, 0, 1.0, None)]
    lf, rf = spark.createDataFrame(left, "i int, k int, x double"), spark.createDataFrame(right, "j int, k int, low double, high double")
    got = range_join(lf, rf, "x", "low", "high", [("k", "k")], width, how).select("i", "j")
    want = []
    for i, k, x in left:
        hits = [j for j, k2, a, b in right if k is not None and k == k2 and x is not None and a is not None and b is not None and a <= x < b]
        want += [(i, j) for j in hits] or ([(i, None)] if how == "left" else [])
    assert rows(got) == sorted(want, key=repr)


def test_numbering_many_ranges(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("v"))
    assert [(x["v"], x["place"]) for x in numbered(df, [F.col("v").desc()]).orderBy("place").collect()] == [(999 - i, i + 1) for i in range(1000)]
    assert numbered(df.limit(0), ["v"]).count() == 0


@pytest.mark.parametrize("merge", [None, lambda a, b: (a[0] + b[0], max(a[1], b[1]))])
def test_folds_of_many_groups(spark, merge):
    r = random.Random(5)
    data = [(r.choice([None, "a", "b", *map(str, range(50))]), r.choice([None, *range(100)])) for _ in range(3000)] + [("hot", 1)] * 3000
    df = spark.createDataFrame(data, "k string, v int").repartition(5)
    add = lambda s, v: (s[0] + 1, max(s[1], v or 0))
    out = aggregate_by(df, ["k"], "v", "r", lambda: (0, 0), add, lambda s: f"{s[0]}/{s[1]}", "string", merge)
    want = {}
    for k, v in data:
        want[k] = add(want.get(k, (0, 0)), v)
    assert {x["k"]: x["r"] for x in out.collect()} == {k: f"{n}/{m}" for k, (n, m) in want.items()}


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="share"):
        lineage.shared_dir(Session())


def test_a_stream_is_written_by_batches(spark, tmp_path):
    for k in range(3):
        spark.sql(f"SELECT TIMESTAMP '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 20,0) AS ts, 'a' AS k FROM range({6 * (k + 1)})").write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema("ts timestamp, k string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    counted = windows.windowed_counts(stream, "ts", "1 hour", ["k"], "10 hours")
    windows.upserted(counted, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    table = spark.read.parquet(str(tmp_path / "out"))
    assert table.select("batch").distinct().count() > 1
    assert [r["n"] for r in windows.latest(table, ["window_start", "k"]).orderBy("window_start").collect()] == [9, 9, 6, 6, 3, 3]
