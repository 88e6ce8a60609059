"""What the operators of this subpackage share: tables, cut lineage, row identity, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a character class of Java's, Python's and DuckDB's regular expressions.
BLANK = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Applications whose tables are to be deleted when Python ends.
_MINE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset a local session gets a temporary folder;
    a cluster is refused, as its executors don't see the driver's."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later stages don't depend on the executors that made it.

    Tables lie in a folder of the application, which is deleted when the driver's Python ends; forget() deletes one sooner.
    """
    spark = df.sparkSession
    mine = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"
    if mine not in _MINE:
        _MINE.add(mine)
        atexit.register(_delete, spark, mine)
    path = f"{mine}/{uuid.uuid4().hex}"
    # once the table is written, nobody needs the shuffle files that it came from
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped before: its folder is left to whoever owns the shared one
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once nothing will read them again."""
    for df in tables:
        for name in {x.rpartition("/")[0] for x in df.inputFiles()}:
            _delete(df.sparkSession, name)


def beside(docs: DataFrame, made: dict[str, str], run) -> DataFrame:
    """docs and the columns `made` (name to type) that run adds to each Arrow batch, by mapInArrow, which can't take every name: columns
    go through it by number."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields), *(f"m{i} {t}" for i, t in enumerate(made.values()))])
    return plain.mapInArrow(run, schema).toDF(*names, *made)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the links i-j."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(a, b), both long and not null; root is the smallest node that it reaches.

    Large-star and small-star rounds, each a partially aggregated minimum and a join on the node. The minima are written
    tables of their own, so that the join isn't dealt as they are and Spark can split a hub's rows. Every round is
    written to the shared folder: a lost executor costs one round. Rounds end when the edges stay the same, which takes about as
    many as the logarithm of the largest component; what comes to the driver is a count and a checksum.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m")))
        large = cut(both.join(least, F.col("a") == F.col("of")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "of"))
        ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(low, F.col("a") == F.col("of")).select(F.explode(ends).alias("e")).select("e.*").where("a <> b").distinct()
        old, now = now, cut(small)
        forget(old, least, large, low)
        is_now = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if is_now == was:
            break
        was = is_now
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
