"""Sources: files, rows in memory, Python scans, and other databases by JDBC with their part of a query as SQL text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """With a schema one pass over the files; without, Spark reads them once more to infer one."""
    read = spark.read.option("header", header)
    return read.schema(schema).csv(path) if schema else read.option("inferSchema", True).csv(path)


def values(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def scannable(spark: SparkSession, name: str, schema: str, scan: Callable[[int], Iterator[tuple]], partitions: int = 1) -> DataFrame:
    """A table that a Python function yields, part by part: scan(0), scan(1), ... run as tasks, each row checked against the schema."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(i) for i in range(partitions)]

        def read(self, partition):
            yield from scan(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format(name).load()


class External:
    """A database behind JDBC. What is asked of it goes there as one SELECT: filter, columns, aggregates, order and limit."""

    def __init__(self, spark: SparkSession, url: str, quote: str = '"', paging: str = "limit", **options: str):
        self.spark, self.url, self.quote, self.paging, self.options = spark, url, quote, paging, options

    def _name(self, x: str) -> str:
        return ".".join(self.quote + p.replace(self.quote, self.quote * 2) + self.quote for p in x.split("."))

    def select(self, table: str, columns: list[str] | None = None, where: str | None = None, group: list[str] | None = None, aggregates: dict[str, str] | None = None, order: list[str] | None = None, limit: int | None = None, offset: int | None = None) -> str:
        """The text that goes to the database; `paging` is limit (LIMIT n OFFSET m) or fetch (OFFSET m ROWS FETCH NEXT n ROWS ONLY)."""
        shown = [self._name(c) for c in (columns or [])] + [self._name(c) for c in (group or [])] + [f"{e} AS {self._name(n)}" for n, e in (aggregates or {}).items()]
        out = f"SELECT {', '.join(shown) or '*'} FROM {self._name(table)}"
        out += f" WHERE {where}" if where else ""
        out += f" GROUP BY {', '.join(map(self._name, group))}" if group else ""
        out += f" ORDER BY {', '.join(order)}" if order else ""
        if self.paging == "limit":
            out += f" LIMIT {limit}" if limit is not None else ""
            out += f" OFFSET {offset}" if offset else ""
        elif limit is not None or offset:
            out += f" OFFSET {offset or 0} ROWS" + (f" FETCH NEXT {limit} ROWS ONLY" if limit is not None else "")
        return out

    def read(self, table: str, **parts) -> DataFrame:
        return self.query(self.select(table, **parts))

    def query(self, sql: str) -> DataFrame:
        return self.spark.read.format("jdbc").option("url", self.url).option("query", sql).options(**self.options).load()

    def table(self, name: str, partition: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1) -> DataFrame:
        """A relation whose filters, columns, limits and aggregates Spark pushes down; `partition` reads it by ranges in parallel."""
        read = self.spark.read.format("jdbc").option("url", self.url).option("dbtable", self._name(name)).options(**self.options)
        read = read.options(pushDownAggregate="true", pushDownLimit="true", pushDownOffset="true", pushDownTableSample="true")
        if partition:
            read = read.options(partitionColumn=partition, lowerBound=lower, upperBound=upper, numPartitions=parts)
        return read.load()
