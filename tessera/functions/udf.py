"""User functions: scalar, aggregate (init, add, result) and table functions."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def scalar_function(f: Callable, returns: str) -> Callable:
    """A Python function of one value per argument, called in Arrow batches; nulls come as None."""

    def batches(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*(None if pd.isna(v) else v for v in row)) for row in zip(*columns, strict=True)], dtype=object)

    batches.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    return F.pandas_udf(batches, returns)


def aggregate_function(init: Callable[[], Any], add: Callable[[Any, Any], Any], result: Callable[[Any], Any], returns: str) -> Callable:
    """A fold over a group's values as an expression: for windows, and for groups beside other aggregates. Python is called for each group or
    frame, whose values it gets at once: keep these bounded. aggregate_by folds large numbers of groups, and large groups."""

    def fold(values: pd.Series) -> Any:
        state = init()
        for v in values:
            state = add(state, None if pd.isna(v) else v)
        return result(state)

    fold.__annotations__ = {"values": pd.Series, "return": {"double": float, "string": str}.get(returns, int)}
    return F.pandas_udf(fold, returns)


def aggregate_by(df: DataFrame, keys: list[str], value: str, name: str, init: Callable[[], Any], add: Callable[[Any, Any], Any], result: Callable[[Any], Any], returns: str, merge: Callable[[Any, Any], Any] | None = None) -> DataFrame:
    """A fold over each group's values, nulls as None, for many groups at a time: rows are sorted by key and go through Python in Arrow
    batches, with one state held. Values come in no order, as in any aggregate.

    With merge (of two states) every task folds its own rows first and only pickled states are shuffled, one for each task and
    group, so that a hot group isn't one task's; without, a group's rows meet in one task, which holds a single state of them.
    """
    kinds = [df.schema[k].dataType for k in keys]
    names = [f"k{i}" for i in range(len(keys))]
    plain = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(value).alias("v"))
    key_schema = T.StructType([T.StructField(n, t) for n, t in zip(names, kinds, strict=True)])

    def folded(batches: Iterator, start: Callable[[], Any], step: Callable, end: Callable, target: pa.Schema) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *key, v in zip(*columns, strict=True):
                if key != now:
                    if now is not None:
                        out.append((*now, end(state)))
                        if len(out) >= 8192:
                            yield _batch(out, target)
                            out = []
                    now, state = key, start()
                state = step(state, v)
        if now is not None:
            out.append((*now, end(state)))
        if out:
            yield _batch(out, target)

    def arrow(schema: T.StructType) -> pa.Schema:
        return to_arrow_schema(schema)

    last = T.StructType([*key_schema.fields, T.StructField("r", T._parse_datatype_string(returns))])
    if merge is not None:
        middle = T.StructType([*key_schema.fields, T.StructField("v", T.BinaryType())])
        into, done = arrow(middle), arrow(last)
        partial = plain.sortWithinPartitions(*names).mapInArrow(lambda b: folded(b, init, add, lambda s: pickle.dumps(s, 5), into), middle)
        again = lambda s, v: pickle.loads(v) if s is None else merge(s, pickle.loads(v))
        rows = partial.repartition(*names) if names else partial.coalesce(1)
        out = rows.sortWithinPartitions(*names).mapInArrow(lambda b: folded(b, lambda: None, again, result, done), last)
    else:
        done = arrow(last)
        rows = plain.repartition(*names) if names else plain.coalesce(1)
        out = rows.sortWithinPartitions(*names).mapInArrow(lambda b: folded(b, init, add, result, done), last)
    return out.toDF(*keys, name)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def table_function(rows: Callable[..., Iterator[tuple]], returns: str) -> Callable:
    """A function from values to rows, to stand in FROM or after LATERAL."""

    class Table:
        def eval(self, *args):
            yield from rows(*args)

    return F.udtf(Table, returnType=returns)


def numbers(spark: SparkSession, n: int, name: str = "n"):
    """1 to n, without Python."""
    return spark.range(1, n + 1).withColumnRenamed("id", name)
