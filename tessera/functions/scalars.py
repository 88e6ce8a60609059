"""Scalar and aggregate functions with the standard's results where Spark's differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def int_sum(x: Column | str) -> Column:
    """SUM of an INTEGER column as an INTEGER; beyond that range an error (Spark widens to BIGINT)."""
    return F.sum(_c(x)).cast("int")


def int_avg(x: Column | str) -> Column:
    """AVG of an INTEGER column as an INTEGER, cut towards zero; null over no values."""
    total, n = F.sum(_c(x)), F.count(_c(x))
    return F.when(n > 0, F.call_function("div", total, F.greatest(n, F.lit(1)))).cast("int")


def pad_char(x: Column | str, n: int) -> Column:
    """CAST(x AS CHAR(n)): cut or blank-padded to n characters."""
    return F.rpad(_c(x), n, " ")


def _path(path: str) -> str:
    mode, _, rest = path.partition(" ")
    return rest if mode in ("lax", "strict") else path


def _is_nested(x: Column | str, path: str) -> Column:
    """Whether the value at path is an object or an array, whatever its text begins with; null where there is none."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(_c(x)), _path(path), "variant")).rlike("^(OBJECT|ARRAY)")


def json_value(x: Column | str, path: str) -> Column:
    """The scalar at path as text; null where there is none, or an object or array."""
    return F.when(~_is_nested(x, path), F.get_json_object(_c(x), _path(path)))


def json_query(x: Column | str, path: str) -> Column:
    """The object or array at path as text; null for scalars."""
    return F.when(_is_nested(x, path), F.get_json_object(_c(x), _path(path)))


def json_exists(x: Column | str, path: str) -> Column:
    """Whether path leads anywhere, a JSON null included; null for null."""
    got = F.try_variant_get(F.try_parse_json(_c(x)), _path(path), "variant")
    return F.when(_c(x).isNotNull(), got.isNotNull())


def posix_match(x: Column | str, pattern: str, negated: bool = False, case_sensitive: bool = True) -> Column:
    """x ~ pattern, ~*, !~, !~*: a match anywhere in x."""
    hit = _c(x).rlike(pattern if case_sensitive else f"(?i){pattern}")
    return ~hit if negated else hit


def unsigned(x: Column | str, bits: int) -> Column:
    """CAST to an unsigned integer of 8, 16, 32 or 64 bits, as the next wider type Spark has; out of range is an error."""
    kind = {8: "smallint", 16: "int", 32: "bigint", 64: "decimal(20,0)"}[bits]
    v = _c(x).cast("decimal(38,0)")
    return F.when((v >= 0) & (v <= F.lit(str((1 << bits) - 1)).cast("decimal(38,0)")), v.cast(kind)).when(v.isNotNull(), F.raise_error(F.lit(f"out of range for {bits} unsigned bits")).cast(kind))
