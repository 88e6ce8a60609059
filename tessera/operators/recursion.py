"""Iteration: WITH RECURSIVE with UNION [ALL]."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import cut


def repeat_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, limit: int = -1) -> DataFrame:
    """seed, and step(rows of the last round) again and again until a round leaves no new row.

    distinct (UNION): duplicates and rows that were there before are dropped, nulls being equal; otherwise (UNION ALL) all
    rows stay. limit is the most rounds after the seed: 0 the seed only, negative no limit. Each round is a folder of one
    table in the shared folder, which one anti-join looks into: plans stay short and a lost executor costs one round. The driver sees whether a round has rows.
    """
    names, spark = seed.columns, seed.sparkSession
    delta = cut(seed.distinct() if distinct else seed)
    paths, done = list(_folders(delta)), 0
    seen = lambda: spark.read.schema(delta.schema).parquet(*paths)
    while limit < 0 or done < limit:
        new = step(delta).toDF(*names)
        if distinct:
            old = seen().select([F.col(c).alias(f"__{c}") for c in names])
            new = new.distinct().join(old, _same(names), "left_anti")
        found = cut(new)
        if found.isEmpty():
            break
        delta = found.select([F.col(f.name).cast(f.dataType) for f in seed.schema.fields]) if found.schema != seed.schema else found
        paths += _folders(delta)
        done += 1
    return seen()


def _same(names: list[str]):
    test = F.lit(True)
    for c in names:
        test &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return test


def _folders(df: DataFrame) -> list[str]:
    return sorted({x.rpartition("/")[0] for x in df.inputFiles()})
