"""Collections: whole inputs as arrays, multisets or maps, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collect_array(df: DataFrame, order: list | None = None, by: list[str] | None = None, name: str = "items") -> DataFrame:
    """All rows (of each group `by`) as one array; nulls stay, and `order` gives the elements' order. One row even over nothing, without groups.

    collect_list drops nulls, so elements are wrapped while they are collected. An array is one value: its size is its group's.
    """
    rest = [c for c in df.columns if c not in (by or [])]
    value = F.struct(*rest) if len(rest) > 1 else F.col(rest[0])
    wrapped = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order or [])), value.alias("v"))
    items = F.collect_list(wrapped)
    items = F.array_sort(items) if order else items
    out = F.transform(items, lambda x: x["v"]).alias(name)
    return df.groupBy(*(by or [])).agg(out)


def collect_multiset(df: DataFrame, by: list[str] | None = None, name: str = "items") -> DataFrame:
    """A bag as an array in the elements' own order, so that equal bags are equal arrays."""
    value = [F.col(c) for c in df.columns if c not in (by or [])]
    return collect_array(df, value, by, name)


def collect_map(df: DataFrame, name: str = "items") -> DataFrame:
    """A map from the first column to the second; of rows with one key the last in order of the value stays."""
    k, v = df.columns[:2]
    last = df.groupBy(k).agg(F.max(F.struct(F.col(v).isNotNull().alias("known"), F.col(v).alias("v"))).alias("x"))
    return last.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(k).alias("k"), F.col("x.v").alias("v"))))).alias(name))


def unnest(df: DataFrame, columns: list[str], ordinality: str | None = None, keep: list[str] | None = None, outer: bool = False) -> DataFrame:
    """Rows of df for each element of an array or map column, or of several: then every combination (a flat product).

    A null or empty collection gives no row (outer: one with nulls). Arrays of structs become columns, an array of arrays is taken apart by
    one level, a map gives key and value. ordinality names a column that counts from 1 the elements, or the combinations of
    a row.
    """
    kept = keep if keep is not None else [c for c in df.columns if c not in columns]
    out, made, places = df, [], []
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType
        explode = F.posexplode_outer if outer else F.posexplode
        if isinstance(kind, T.MapType):
            out = out.select("*", explode(c).alias(f"__p{i}", f"__k{i}", f"__v{i}"))
            made += [F.col(f"__k{i}").alias(f"{c}_key"), F.col(f"__v{i}").alias(f"{c}_value")]
        else:
            out = out.select("*", explode(c).alias(f"__p{i}", f"__e{i}"))
            fields = kind.elementType.fieldNames() if isinstance(kind.elementType, T.StructType) else None
            made += [F.col(f"__e{i}").getField(f).alias(f) for f in fields] if fields else [F.col(f"__e{i}").alias(c)]
        places.append((c, f"__p{i}"))
    if ordinality:
        n = F.lit(0).cast("long")
        for c, p in places:
            n = n * F.size(c) + F.col(p)
        made.append((n + 1).alias(ordinality))
    return out.select(*kept, *made)
