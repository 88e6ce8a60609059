"""Row pattern matching with patterns that are a sequence of symbols."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A function of at(column, offset), or a text with names in it, and which column and offset each of them stands for.
Define = Callable[[Callable[[str, int], Column]], Column] | tuple[str, dict[str, tuple[str, int]]]


def match_sequence(df: DataFrame, partition: list[str], order: list, symbols: list[str], define: dict[str, Define], measures: dict[str, tuple[str, str]]) -> DataFrame:
    """ONE ROW PER MATCH of PATTERN (symbols...), after a match going on past its last row.

    define[symbol] gets at(column, offset): that column of the symbol's own row (0) or of rows before (-1: PREV) and after it. measures: name
    to (symbol, column). Conditions are leads and lags over one window; matches that would overlap one before them
    are dropped by taking the first, and the next that begins behind it, within a partition.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    n = len(symbols)

    def column(name: str, place: int) -> Column:
        return F.lead(name, place).over(w) if place > 0 else F.lag(name, -place).over(w) if place < 0 else F.col(name)

    named, texts = {}, {}
    for i, s in enumerate(symbols):
        if isinstance(define.get(s), tuple):
            texts[s], places = define[s]
            for name, (c, offset) in places.items():
                named[f"__s{i}{name}"] = column(c, i + offset)
                texts[s] = texts[s].replace(f"`{name}`", f"`__s{i}{name}`")
    df = df.withColumns(named) if named else df
    ok = F.lead(F.lit(1), n - 1).over(w).isNotNull() if n > 1 else F.lit(True)
    for i, s in enumerate(symbols):
        if s in define:
            ok &= F.coalesce(F.expr(texts[s]) if s in texts else define[s](lambda c, offset, i=i: column(c, i + offset)), F.lit(False))
    values = {name: column(c, symbols.index(s)) for name, (s, c) in measures.items()}
    out = df.withColumns({**{f"__m_{k}": v for k, v in values.items()}, "__rn": F.row_number().over(w), "__ok": ok}).where("__ok")
    if n > 1:
        # starts closer than n rows overlap: go through each chain of them from its first, in one array per chain
        gap = F.col("__rn") - F.lag("__rn").over(Window.partitionBy(*partition).orderBy("__rn"))
        chain = F.sum(F.when(gap.isNull() | (gap >= n), 1).otherwise(0)).over(Window.partitionBy(*partition).orderBy("__rn").rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("__chain", chain)
        out = out.withColumn("__starts", F.array_sort(F.collect_list("__rn").over(Window.partitionBy(*partition, "__chain"))))
        taken = F.aggregate("__starts", F.array().cast("array<int>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= n), F.concat(acc, F.array(x))).otherwise(acc))
        out = out.where(F.array_contains(taken, F.col("__rn")))
    return out.select(*partition, *(F.col(f"__m_{k}").alias(k) for k in measures))
