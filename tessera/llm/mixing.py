"""Mixing sources to target weights by entropy balancing: tilted rates of documents, rounded to whole copies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BLANK, cut, forget

#: A document is taken this many times at most.
MOST = 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long")


def targets(hist: DataFrame, weights: tuple[int, ...], share: float) -> DataFrame:
    """hist(_source, _size, _n) to one row per source: _s (rank by code point, null last), _total, _target, _mean.

    Sources share `share` of all sizes by weight. A target stops at MOST times its source's size; what lies above goes to
    the rest by weight. In order of how soon a source is full, each prefix of full sources leaves one level for
    the rest; a source is full if its level reaches it.
    """
    per = hist.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("_total"), F.sum("_n").alias("_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))
    per = per.withColumn("_s", rank).withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("_s") - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = F.col("_total") * float(MOST)
    order = Window.orderBy(cap / F.col("_w"), "_s")
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy()
    per = per.withColumn("_level", (F.sum("_total").over(everything) * share - before) / left)
    full = cap / F.col("_w") <= F.col("_level")
    level = F.max(F.when(~full, F.struct(-F.col("_rank"), F.col("_level")))).over(everything)["_level"]
    per = per.withColumn("_rank", F.row_number().over(order)).withColumn("_full", full).withColumn("_at", level)
    return per.select("_s", "_source", "_total", F.when(F.col("_full"), cap).otherwise(F.least(cap, F.col("_at") * F.col("_w"))).alias("_target"), F.greatest(F.col("_total") / F.col("_docs"), F.lit(1e-9)).alias("_mean"))


def _rate(tilt: Column) -> Column:
    """Copies of a document, between 0 and MOST: exponential in tilt times size where small."""
    ends = F.when(F.col("_target") >= F.col("_total") * float(MOST), float(MOST)).when(F.col("_target") <= 0, 0.0)
    return ends.otherwise(MOST / (1 + F.exp(F.least(F.lit(700.0), -tilt * F.col("_size") / F.col("_mean")))))


def tilts(hist: DataFrame, sources: DataFrame, rounds: int = 100) -> DataFrame:
    """sources with _tilt: the dual variable of each source's constraint on words.

    Entropy balancing with rates r in [0, MOST] (bounded, so logistic: exponential in tilt * size as long as they are
    small) has r = MOST / (1 + exp(-tilt * size)); the convex dual's gradient is
    the source's expected words less its target. Each round is one Newton step for all sources, a partially aggregated sum
    over distinct (source, size); a step that leaves the bracket found so far is halved into it. The bracket alone would be
    down to rounding in 80 rounds; not to have settled in `rounds` is an error.
    """
    state = cut(sources.withColumns({"_tilt": F.lit(0.0), "_low": F.lit(-1e7), "_high": F.lit(1e7), "_off": F.lit(1.0)}))
    keys = hist.join(sources.select("_s", "_source"), hist._source.eqNullSafe(sources._source)).select("_s", "_size", "_n")
    keys = cut(keys)
    for _ in range(rounds):
        r = _rate(F.col("_tilt"))
        words = F.col("_n") * F.col("_size")
        sums = keys.join(state, "_s").groupBy("_s").agg(F.sum(words * r).alias("_got"), F.sum(words * F.col("_size") / F.col("_mean") * r * (1 - r / MOST)).alias("_slope"))
        off = F.col("_got") - F.col("_target")
        step = F.col("_tilt") - F.try_divide(off, F.col("_slope"))
        new = state.join(sums, "_s").withColumns({"_high": F.when(off > 0, F.col("_tilt")).otherwise(F.col("_high")), "_low": F.when(off <= 0, F.col("_tilt")).otherwise(F.col("_low"))})
        inside = step.isNotNull() & ~F.isnan(step) & (step > F.col("_low")) & (step < F.col("_high"))
        new = new.withColumns({"_tilt": F.when(F.abs(off) <= 1e-9 * F.col("_target"), F.col("_tilt")).when(inside, step).otherwise((F.col("_low") + F.col("_high")) / 2), "_off": F.abs(off) / F.greatest(F.col("_target"), F.lit(1.0))})
        old, state = state, cut(new.select(state.columns))
        forget(old)
        far = state.where((F.col("_off") > 1e-9) & (F.col("_high") - F.col("_low") > 1e-12 * F.abs("_tilt"))).limit(1).count()
        if not far:
            break
    else:
        raise RuntimeError(f"the sources' tilts did not settle in {rounds} Newton rounds")
    return state.withColumn("_tilt", F.round("_tilt", 9))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size", keep: tuple[str, ...] = (), weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """doc_id, source, size, the columns of keep, and source_size long, target double (both of the row's source), copies
    int (0 to 2), taken long (copies times size). docs should be a table of narrow rows: it is read several times.

    A null source is a source of its own, last in order; a null size is 0, and such rows take nothing; an empty table stays
    empty. Rates fall or rise with size as the source's tilt says. Rounding is systematic over rows ordered by (source, size): running
    sums of rates step over whole numbers. What words are then still missing or too many is made up by one copy
    more or less of the source's smallest documents, so that a source ends within half of such a document's size.
    Ties and repeated rows are in order of doc_id. Running sums go in cells of about max(256, sqrt(rows)) rows of
    one source and size; the sums over cells have one row for each cell.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("_source"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"), *keep)
    hist = cut(rows.groupBy("_source", "_size").agg(F.count("*").alias("_n")))
    cell = max(256, math.isqrt(hist.agg(F.sum("_n")).first()[0] or 0))
    sources = cut(targets(hist, weights, share))
    state = tilts(hist, sources)
    by_size = hist.join(state, hist._source.eqNullSafe(state._source)).select(hist._source.alias("_from"), F.col("_size").alias("_of"), "_s", "_total", "_target", _rate(F.col("_tilt")).alias("_rate"), F.ceil(F.col("_n") / cell).alias("_salts"))
    rows = rows.join(by_size, rows._source.eqNullSafe(by_size._from) & (rows._size == by_size._of)).drop("_from", "_of")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), "_salts"))
    key = ["_s", "_size", "_salt"]
    before = Window.partitionBy("_s").orderBy("_size", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_begin")
    cells = rows.groupBy(key).agg((F.count("*") * F.max("_rate")).alias("_sum")).select(*key, begin)
    rows = rows.withColumn("_j", F.row_number().over(Window.partitionBy(key).orderBy("doc_id"))).join(cells, key)
    upto = lambda j: F.floor(F.col("_begin") + j * F.col("_rate") + 0.5)
    copies = F.least(F.lit(MOST), upto(F.col("_j")) - upto(F.col("_j") - 1)).cast("int")
    rows = cut(rows.withColumn("copies", copies).drop("_rate", "_salts", "_j", "_begin"))
    # what each source is off by goes to its cells, not to its rows: rows are never dealt by source
    off = rows.groupBy("_s").agg((F.max("_target") - F.sum(F.col("copies") * F.col("_size"))).alias("_off"))
    can_more, can_less = (F.col("_size") > 0) & (F.col("copies") < MOST), (F.col("_size") > 0) & (F.col("copies") > 0)
    words = lambda can: F.sum(can.cast("long")) * F.col("_size")
    cells = rows.groupBy(key).agg(words(can_more).alias("_more"), words(can_less).alias("_less")).join(off, "_s")
    cells = cells.withColumn("_sum", F.when(F.col("_off") > 0, F.col("_more")).otherwise(F.col("_less"))).select(*key, "_off", begin)
    number = lambda can: F.row_number().over(Window.partitionBy(*key, can).orderBy("doc_id"))
    rows = rows.withColumns({"_m": number(can_more), "_l": number(can_less)}).join(cells, key)
    free, j = F.when(F.col("_off") > 0, can_more).otherwise(can_less), F.when(F.col("_off") > 0, F.col("_m")).otherwise(F.col("_l"))
    flip = free & (F.col("_begin") + (j - 0.5) * F.col("_size") <= F.abs("_off"))
    copies = F.col("copies") + F.when(flip, F.signum("_off").cast("int")).otherwise(0)
    return rows.select("doc_id", F.col("_source").alias("source"), F.col("_size").alias("size"), *keep, F.col("_total").alias("source_size"), F.col("_target").alias("target"), copies.alias("copies"), (copies * F.col("_size")).alias("taken"))


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    docs = cut(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return mix(docs).drop("source")
