"""Set operations with an order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def merge_union(inputs: list[DataFrame], order: list, distinct: bool = False, fetch: int | None = None, offset: int = 0) -> DataFrame:
    """The inputs as one, in order, at most `fetch` rows after `offset`.

    With a fetch each input gives its first offset + fetch rows only (a top-k per input, which holds no more than that), before the
    union sorts them again.
    """
    rows = [df.distinct() if distinct else df for df in inputs]
    if fetch is not None:
        rows = [df.orderBy(*order).limit(offset + fetch) for df in rows]
    out = reduce(DataFrame.union, rows)
    out = (out.distinct() if distinct else out).orderBy(*order)
    out = out.offset(offset) if offset else out
    return out if fetch is None else out.limit(fetch)
