"""Window frames with an exclusion clause, which Spark's windows don't have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_OTHERS, CURRENT_ROW, GROUP, TIES = "no others", "current row", "group", "ties"


def exclude_window(df: DataFrame, partition: list[str], order: list[Column], value: str, aggregates: dict[str, str], exclude: str, start: int | None = None, end: int | None = 0, tie: list[str] | None = None) -> DataFrame:
    """df with aggregates (name: sum, count, avg, min or max of value) over a ROWS frame, less what `exclude` names.

    start and end are row offsets (negative before, None unbounded). Peers are rows equal on `order`; `tie` orders them
    where frames must be definite.

    What is left of a frame lies on either side of the excluded rows, and each side is a frame of Spark's own where it is unbounded: up to
    the row or after it, or, by the rank that peers share, up to the peer group or after it. Only a side of the group with
    a bounded offset is an array, of that many rows at most. So memory and time don't grow with the partition's frames.
    """
    if exclude not in (NO_OTHERS, CURRENT_ROW, GROUP, TIES):
        raise ValueError(f"unknown exclusion {exclude!r}")
    full = [*order, *(F.col(c) for c in tie or [])]
    rows = Window.partitionBy(*partition).orderBy(*full)
    peers = Window.partitionBy(*partition).orderBy(*order)
    groups = Window.partitionBy(*partition).orderBy("__first")
    out = df.withColumns({"__rn": F.row_number().over(rows), "__first": F.rank().over(peers)})
    v, low, high = F.col(value), Window.unboundedPreceding, Window.unboundedFollowing
    own_in = (start is None or start <= 0) and (end is None or end >= 0)
    sides: list[tuple[Column | None, object]] = []  # (condition, window or array of values)
    if exclude == NO_OTHERS:
        sides.append((None, rows.rowsBetween(low if start is None else start, high if end is None else end)))
    elif exclude == CURRENT_ROW:
        if start is None or start < 0:
            sides.append((None, rows.rowsBetween(low if start is None else start, -1 if end is None else min(end, -1))))
        if end is None or end > 0:
            sides.append((None, rows.rowsBetween(1 if start is None else max(start, 1), high if end is None else end)))
    else:
        out = out.withColumn("__last", F.max("__rn").over(Window.partitionBy(*partition, "__first")))
        held = lambda a, b: F.transform(F.filter(F.collect_list(F.struct(F.col("__first").alias("p"), v.alias("v"))).over(rows.rowsBetween(a, b)), lambda x: x["p"] != F.col("__first")), lambda x: x["v"])
        if start is None:
            before_group = None if end is None or end >= 0 else F.col("__rn") + end >= F.col("__first") - 1
            sides.append((before_group, groups.rangeBetween(low, -1)))
            if before_group is not None:  # the frame ends before the group does begin
                sides.append((~before_group, rows.rowsBetween(low, end)))
        elif start < 0:
            sides.append((None, held(start, -1 if end is None else min(end, -1))))
        if end is None:
            after_group = None if start is None or start <= 0 else F.col("__rn") + start <= F.col("__last") + 1
            sides.append((after_group, groups.rangeBetween(1, high)))
            if after_group is not None:
                sides.append((~after_group, rows.rowsBetween(start, high)))
        elif end > 0:
            sides.append((None, held(1 if start is None else max(start, 1), end)))
    own = F.when(F.lit(exclude == TIES and own_in), v)

    def parts(kind: str) -> list[Column]:
        """One value for each side, null where it has none."""
        found = []
        for condition, side in sides:
            if isinstance(side, Column):
                known = F.filter(side, lambda x: x.isNotNull())
                made = {"count": F.size(known).cast("long"), "min": F.array_min(known), "max": F.array_max(known)}
                if kind == "sum":
                    zero = F.lit(0).cast(df.select(F.sum(value).alias("x")).schema["x"].dataType)
                    x = F.when(F.size(known) > 0, F.aggregate(known, zero, lambda a, y: (a + y).cast(df.select(F.sum(value).alias("x")).schema["x"].dataType)))
                else:
                    x = made[kind]
            else:
                x = getattr(F, kind)(v).over(side)
            found.append(x if condition is None else F.when(condition, x))
        return [*found, {"count": F.when(own.isNotNull(), 1).otherwise(0).cast("long")}.get(kind, own)]

    def added(kind: str) -> Column:
        total = None
        for x in parts(kind):
            x = F.coalesce(x, F.lit(0))
            total = x if total is None else total + x
        return total

    made = {}
    for name, kind in aggregates.items():
        if kind == "count":
            made[name] = added("count").cast("long")
        elif kind == "sum":
            made[name] = F.when(added("count") > 0, added("sum"))
        elif kind == "avg":
            made[name] = F.when(added("count") > 0, added("sum") / added("count"))
        elif kind in ("min", "max"):
            made[name] = (F.least if kind == "min" else F.greatest)(*parts(kind), F.lit(None).cast(df.schema[value].dataType))
        else:
            raise ValueError(f"unknown aggregate {kind!r}")
    return out.withColumns(made).select(*df.columns, *made)
