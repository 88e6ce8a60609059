"""Cutting lineage: tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders that are to be deleted when Python ends.
_MINE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session, as in tests, gets a temporary folder; a cluster is refused, as its
    executors don't see the driver's."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is deleted when the driver's Python ends."""
    mine = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"
    if mine not in _MINE:
        _MINE.add(mine)
        atexit.register(_delete, spark, mine)
    return mine


def _delete(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table and read it back, so that nothing before it is computed again."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # once the table is written, nobody needs the shuffle files that it came from
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)
