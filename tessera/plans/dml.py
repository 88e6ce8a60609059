"""INSERT, UPDATE, DELETE and MERGE with row counts, over tables that are lists of parquet folders."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.lineage import own_dir


class FileTable:
    """A table in the shared folder. Inserts add a folder; the other statements write the changed table anew and
    then change over, so a statement that fails, or loses an executor, leaves the table as it was."""

    def __init__(self, spark: SparkSession, name: str, schema: T.StructType):
        self.spark, self.name, self.schema = spark, name, schema
        self.base = f"{own_dir(spark)}/tables/{uuid.uuid4().hex}"
        self.parts: list[str] = []
        self._show()

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.parts) if self.parts else self.spark.createDataFrame([], self.schema)

    def _show(self):
        self.read().createOrReplaceTempView(self.name)

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.base}/{uuid.uuid4().hex}"
        rows.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema.fields)).write.parquet(path)
        return path

    def insert(self, rows: DataFrame, columns: list[str] | None = None) -> int:
        """Rows by position; columns not named are null."""
        names = columns or self.schema.names
        rows = rows.toDF(*names)
        rows = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in self.schema.fields if f.name not in names})
        path = self._write(rows)
        n = self.spark.read.schema(self.schema).parquet(path).count()
        self.parts.append(path)
        self._show()
        return n

    def _replace(self, rows: DataFrame) -> None:
        self.parts = [self._write(rows)]
        self._show()

    def update(self, values: dict[str, Column], where: Column | None = None) -> int:
        hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        rows = self.read()
        n = rows.where(hit).count()
        if n:
            old = rows.withColumn("__hit", hit)
            self._replace(old.select(*(F.when(F.col("__hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in self.schema.names)))
        return n

    def delete(self, where: Column | None = None) -> int:
        rows = self.read()
        hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        n = rows.where(hit).count()
        if n:
            self._replace(rows.where(~hit))
        return n

    def merge(self, source: DataFrame, on: list[str], update: dict[str, str] | None = None, insert: bool = True) -> int:
        """Rows of source that match on the columns `on` update (column: source column), others are inserted. A row that two source
        rows match is an error."""
        src = source.select(*(F.col(c).alias(f"__s_{c}") for c in source.columns)).withColumn("__there", F.lit(True))
        rows = self.read()
        same = F.lit(True)
        for c in on:
            same &= rows[c] == src[f"__s_{c}"]
        twice = src.groupBy(*(f"__s_{c}" for c in on)).count().where("count > 1")
        if not twice.join(rows, [twice[f"__s_{c}"] == rows[c] for c in on], "left_semi").isEmpty():
            raise ValueError("a row of the target matches more than one row of the source")
        n = 0
        changed = rows
        if update:
            joined = rows.join(src, same, "left")
            n += joined.where("__there").count()
            changed = joined.select(*(F.when(F.col("__there"), F.col(f"__s_{update[c]}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in rows.columns))
        if insert:
            new = src.join(rows, same, "left_anti").select(*((F.col(f"__s_{c}") if c in source.columns else F.lit(None)).alias(c) for c in rows.columns))
            n += new.count()
            changed = changed.unionByName(new)
        self._replace(changed)
        return n
