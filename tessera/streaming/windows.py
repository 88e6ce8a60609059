"""Window table functions: each row with the bounds of its tumbling, hopping or session window.

tumble and hop are projections, so they run on streams too; there a watermark and an aggregate over window_start bound
the state. session annotates rows of a table; streams group by Spark's own session_window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumble(df: DataFrame, time: str, size: str, offset: str | None = None) -> DataFrame:
    """df with window_start and window_end of windows of `size`, shifted by `offset`. A null time gives no row."""
    w = F.window(time, size, startTime=offset) if offset else F.window(time, size)
    return df.withColumn("__w", w).select(*df.columns, F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"))


def hop(df: DataFrame, time: str, slide: str, size: str, offset: str | None = None) -> DataFrame:
    """One row for each window of `size` that a row lies in; windows begin every `slide`."""
    w = F.window(time, size, slide, offset) if offset else F.window(time, size, slide)
    return df.withColumn("__w", w).select(*df.columns, F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"))


def session(df: DataFrame, time: str, keys: list[str], gap: str) -> DataFrame:
    """df with the bounds of each row's session: rows of a key less than `gap` apart, from the first to the last plus the gap.

    A row exactly one gap after the one before begins a session, as sessions exclude their ends. One shuffle on the keys; both windows
    use its order.
    """
    step: Column = F.expr(f"INTERVAL {gap}")
    w = Window.partitionBy(*keys).orderBy(time)
    new = F.coalesce(F.col(time) >= F.lag(time).over(w) + step, F.lit(True))
    out = df.where(F.col(time).isNotNull()).withColumn("__new", new).withColumn("__s", F.sum(F.col("__new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*keys, "__s")
    return out.withColumns({"window_start": F.min(time).over(own), "window_end": F.max(time).over(own) + step}).select(*df.columns, "window_start", "window_end")


def windowed_counts(stream: DataFrame, time: str, size: str, keys: list[str], late: str) -> DataFrame:
    """Counts per tumbling window and keys of a stream (or a table), with rows later than `late` dropped from streams."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def upserted(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a stream of aggregates whose changed rows are appended to a table with the number of their batch. Each batch brings only what it
    changed, written by the executors; a batch that is run again after a failure replaces its own folder."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key in a table that upserted() wrote."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__last"))
    return last.select(*keys, *(F.col(f"__last.{c}").alias(c) for c in rest))
