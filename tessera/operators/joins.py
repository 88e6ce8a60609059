"""Joins that Spark lacks or answers differently: as-of joins and three-valued mark joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.lineage import cut


def null_safe_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi-join where nulls are equal (IS NOT DISTINCT FROM). Hashes and sorts like any equi-join."""
    cond = None
    for a, b in pairs:
        c = left[a].eqNullSafe(right[b])
        cond = c if cond is None else cond & c
    return left.join(right, cond, how)


def asof_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], on: tuple[str, str], op: str = "<=", how: str = "inner", prefix: str = "r_", first: list[str] | None = None) -> DataFrame:
    """Each left row with the nearest right row of equal keys for which `right.on op left.on` holds, op one of <=, <, >=, >.

    Columns of right come prefixed. A null key or time matches nothing; how="left" keeps such rows with nulls. Of
    right rows with equal key and time the first in order of the columns `first` (all columns, if not given) is taken: "first
    seen" has no meaning in a distributed table.

    The two sides are united and a window carries the last right row forward within a key: one shuffle on the key and one
    sort, whatever the match ratio, instead of a join on the key alone whose output is quadratic in its rows.
    """
    if op not in ("<=", "<", ">=", ">"):
        raise ValueError(f"unknown match condition {op!r}")
    if how not in ("inner", "left"):
        raise ValueError(f"an as-of join is inner or left, not {how!r}")
    back, strict = op[0] == "<", len(op) == 1
    names = [f"k{i}" for i in range(len(keys))]
    lrow = F.struct(*(left[c].alias(f"c{i}") for i, c in enumerate(left.columns)))
    rrow = F.struct(*(right[c].alias(f"c{i}") for i, c in enumerate(right.columns)))
    tie = F.struct(*(right[c] for c in (first or right.columns)))
    lkeys, rkeys = [left[a].alias(n) for (a, _), n in zip(keys, names, strict=True)], [right[b].alias(n) for (_, b), n in zip(keys, names, strict=True)]
    able = right[on[1]].isNotNull()
    for _, b in keys:
        able &= right[b].isNotNull()
    # the right rows of a time stand before the left rows that may see them, the tie's first one nearest
    seen = 2 if strict else 0
    whole = left[on[0]].isNotNull()
    for a, _ in keys:
        whole &= left[a].isNotNull()
    sides = left.where(whole).select(*lkeys, left[on[0]].alias("at"), F.lit(1).alias("side"), F.lit(None).cast(_type(right, tie)).alias("tie"), lrow.alias("l"), F.lit(None).cast(_type(right, rrow)).alias("r"))
    others = right.where(able).select(*rkeys, right[on[1]].alias("at"), F.lit(seen).alias("side"), tie.alias("tie"), F.lit(None).cast(_type(left, lrow)).alias("l"), rrow.alias("r"))
    both = sides.unionByName(others)
    at = F.col("at").asc_nulls_first() if back else F.col("at").desc_nulls_first()
    w = Window.partitionBy(*names).orderBy(at, "side", F.col("tie").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("m", F.last("r", ignorenulls=True).over(w)).where("side = 1")
    out = out.select("l", "m")
    if how == "inner":
        out = out.where("m IS NOT NULL")
    else:  # rows that can't match never go to the window, where all nulls of a key would meet in one task
        out = out.unionByName(left.where(~whole).select(lrow.alias("l"), F.lit(None).cast(_type(right, rrow)).alias("m")))
    return out.select(*(F.col(f"l.c{i}").alias(c) for i, c in enumerate(left.columns)), *(F.col(f"m.c{i}").alias(prefix + c) for i, c in enumerate(right.columns)))


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, keys: list[tuple[str, str]] | None = None, width: float | None = None, how: str = "inner") -> DataFrame:
    """Rows of left with each row of right for which low <= point < high (and equal keys), by cells of `width` on the line: right rows
    stand in each cell that they reach into, and a left row looks into its own, so that it is an equi-join on (keys, cell). width defaults to
    about the average length of the intervals. how: inner or left. Nulls match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"a range join is inner or left, not {how!r}")
    if width is None:
        width = right.select(F.avg(F.col(high).cast("double") - F.col(low).cast("double"))).first()[0] or 1.0
    cell = lambda c: F.floor(c.cast("double") / F.lit(float(width)))
    reach = right.where(F.col(low) < F.col(high))
    reach = reach.withColumn("__cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    reach = reach.select(*(F.col(c).alias(f"__r_{c}") for c in right.columns), "__cell")
    own = left.withColumn("__own", cell(F.col(point)))
    test = (F.col("__own") == F.col("__cell")) & (F.col(point) >= F.col(f"__r_{low}")) & (F.col(point) < F.col(f"__r_{high}"))
    for a, b in keys or []:
        test &= F.col(a) == F.col(f"__r_{b}")
    return own.join(reach, test, how).select(*left.columns, *(F.col(f"__r_{c}").alias(c if c not in left.columns else f"r_{c}") for c in right.columns))


def _type(df: DataFrame, column: Column):
    return df.select(column.alias("x")).schema["x"].dataType


def mark_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], mark: str = "mark") -> DataFrame:
    """left with a three-valued flag: does its row equal some row of right on the pairs, as SQL's IN says?

    True where it does; null where it doesn't but some comparison is unknown; else false, and false for an
    empty right side. Spark answers false for unknown where IN is projected.

    One pair: a join with the distinct keys of right, and two facts about right (has it rows, has it a null). Several
    pairs: rows of right with nulls match part of the key; they are grouped by which columns are null and
    joined on the others, one join for each such pattern.
    """
    lcols, rcols = [a for a, _ in pairs], [b for _, b in pairs]
    keys = right.select(*(F.col(b).alias(f"__r{i}") for i, b in enumerate(rcols))).distinct()
    full = keys.dropna()
    if len(pairs) == 1:
        facts = keys.agg(F.count(F.lit(1)).alias("__n"), F.max(F.col("__r0").isNull()).alias("__null"))
        out = left.join(full.withColumn("__hit", F.lit(True)), left[lcols[0]] == F.col("__r0"), "left").join(F.broadcast(facts))
        value = F.when(F.col("__hit"), True).when(F.col("__n") == 0, False).when(F.col(lcols[0]).isNull() | F.col("__null"), F.lit(None)).otherwise(False)
        return out.select(*(left[c] for c in left.columns), value.cast("boolean").alias(mark))
    n = len(pairs)
    out = cut(left.withColumn("__id", F.monotonically_increasing_id()))  # read several times below: ids must stay
    known = [F.col(c).isNotNull() for c in lcols]
    # a pair of rows is unknown if every pair of values is equal or has a null: join on the columns known on both sides
    hits = out.where(_all(known)).join(full, _all([F.col(c) == F.col(f"__r{i}") for i, c in enumerate(lcols)]), "left_semi").select("__id", F.lit(True).alias("__hit"))
    maybe = out.select("__id").limit(0)
    # only patterns of nulls that are there: one join for each pair of them, usually few
    theirs = {r[0] for r in keys.select(_pattern([F.col(f"__r{i}") for i in range(n)])).distinct().collect()}
    ours = {r[0] for r in out.select(_pattern([F.col(c) for c in lcols])).distinct().collect()}
    for pattern in sorted(theirs):
        rnull = [bool(pattern >> i & 1) for i in range(n)]
        some = keys.where(_all([F.col(f"__r{i}").isNull() if z else F.col(f"__r{i}").isNotNull() for i, z in enumerate(rnull)]))
        for lpattern in sorted(ours):
            lnull = [bool(lpattern >> i & 1) for i in range(n)]
            if not (pattern | lpattern):
                continue
            own = out.where(_all([~k if z else k for k, z in zip(known, lnull, strict=True)]))
            shared = [i for i in range(n) if not rnull[i] and not lnull[i]]
            found = own.join(some, _all([F.col(lcols[i]) == F.col(f"__r{i}") for i in shared]), "left_semi") if shared else own.join(F.broadcast(some.select(F.lit(1).alias("__one")).limit(1)), F.lit(True), "left_semi")
            maybe = maybe.unionByName(found.select("__id"))
    maybe = maybe.distinct().withColumn("__maybe", F.lit(True))
    value = F.when(F.col("__hit"), True).when(F.col("__maybe"), F.lit(None)).otherwise(False).cast("boolean")
    return out.join(hits, "__id", "left").join(maybe, "__id", "left").select(*(F.col(c) for c in left.columns), value.alias(mark))


def _pattern(columns: list[Column]) -> Column:
    """Which of the columns are null, as bits."""
    bits = F.lit(0)
    for i, c in enumerate(columns):
        bits = bits + F.when(c.isNull(), 1 << i).otherwise(0)
    return bits


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out &= c
    return out
