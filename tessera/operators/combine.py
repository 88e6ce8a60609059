"""Several queries side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import cut


def numbered(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """df with running numbers from 1 in a total order, without one task for all rows: ranges are sorted side by side, and each begins
    where those before it end. The driver gets a count for each range."""
    rows = cut(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    counts = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    begins, at = {}, 0
    for p in sorted(counts):
        begins[p], at = at, at + counts[p]
    begin = F.element_at(F.create_map(*(F.lit(x) for p in sorted(begins) for x in (p, begins[p]))), part) if begins else F.lit(0)
    return rows.withColumn(name, (begin + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("__m")


def combine(queries: dict[str, tuple[DataFrame, list]]) -> DataFrame:
    """One map column (column name to value as string) per query, row i of each next to row i of the others.

    queries: name to (DataFrame, total order). There are as many rows as the longest has; where a query has none, null.
    """
    out = None
    for name, (df, order) in queries.items():
        value = F.create_map(*(x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))))
        rows = numbered(df, order, "__place").select(F.col("__place").alias("place"), value.alias(name))
        out = rows if out is None else out.join(rows, "place", "full")
    return out
