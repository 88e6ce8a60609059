"""Columns whose type is known at run time only, as Spark's variant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def number(v: Column | str) -> Column:
    """The value as a decimal; a value that isn't a number is an error, as in arithmetic."""
    v = F.col(v) if isinstance(v, str) else v
    kind = F.schema_of_variant(v)
    bad = v.isNotNull() & ~kind.isin("VOID") & ~(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"))
    return F.when(bad, F.raise_error(F.concat(F.lit("no arithmetic for a value of type "), kind)).cast("decimal(38,6)")).otherwise(F.try_variant_get(v, "$", "decimal(38,6)"))


def text(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _over(x: Column, w: WindowSpec | None) -> Column:
    return x if w is None else x.over(w)


def any_sum(v, over: WindowSpec | None = None) -> Column:
    return _over(F.sum(number(v)), over)


def any_avg(v, over: WindowSpec | None = None) -> Column:
    return _over(F.avg(number(v)), over)


def _extreme(pick, v, over: WindowSpec | None = None) -> Column:
    """Numbers compare as decimals, strings as strings; a mix of both is an error. The answer is text, as both may be."""
    v = F.col(v) if isinstance(v, str) else v
    kind = F.schema_of_variant(v)
    is_text = F.when(v.isNotNull() & (kind != "VOID"), kind == "STRING")
    most, least = _over(F.max(is_text), over), _over(F.min(is_text), over)
    num = _over(pick(F.when(kind != "STRING", F.try_variant_get(v, "$", "decimal(38,6)"))), over)
    plain = F.regexp_replace(num.cast("string"), r"\.?0+$", "")
    shown = F.when(num == 0, "0").otherwise(F.when(num.cast("string").contains("."), plain).otherwise(num.cast("string")))
    return F.when(most & ~least, F.raise_error(F.lit("values of mixed types don't compare")).cast("string")).when(most, _over(pick(text(v)), over)).otherwise(shown)


def any_min(v, over: WindowSpec | None = None) -> Column:
    return _extreme(F.min, v, over)


def any_max(v, over: WindowSpec | None = None) -> Column:
    return _extreme(F.max, v, over)


#: ANY_VALUE of a dynamic column is its largest.
any_value = any_max
