"""Order MinHash fingerprints of whole texts, and how like they are to those of edited and of other texts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import n_partitions
from tessera.llm.langid import code_points

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class OrderMinHash:
    """Fingerprints of `slots` tuples, each of the `keep` smallest of a share of the text's k-mers, in text order.

    K-mers are k code points (a shorter text is one k-mer) and carry the number of the occurrence, so that repeats
    count. Their hash both deals them to slots and orders them there: one permutation serves all slots, as in
    one-permutation MinHash, where slots that no k-mer reaches stay empty.
    """

    def __init__(self, k: int = 16, keep: int = 2, bits: int = 6):
        self.k, self.keep, self.bits = k, keep, bits
        self.slots = 1 << bits

    def _kmers(self, points: np.ndarray) -> np.ndarray:
        """A polynomial hash of each k-mer, put together from those of 1, 2, 4, ... code points: memory is that of the text, and none stays."""
        k, width = min(self.k, len(points)), 1
        power, done = points.astype(_U) + _U(1), None  # hashes of `width` points, and of as many as the lower bits of k say
        have = 0
        while True:
            if k & width:
                if done is None:
                    done = power
                else:  # the lower bits' points stand behind these
                    done = power[: len(power) - have] * _U(pow(_BASE, have, 1 << 64)) + done[width:]
                have += width
            if have == k:
                return mixed(done)
            power, width = power[:-width] * _U(pow(_BASE, width, 1 << 64)) + power[width:], 2 * width

    def tuples(self, points: np.ndarray) -> np.ndarray:
        """A 32-bit hash of each slot's tuple; 0 where a slot is empty."""
        out = np.zeros(self.slots, dtype=np.uint32)
        if not len(points):
            return out
        h = self._kmers(points)
        order = np.argsort(h, kind="stable")
        ranked = h[order]
        repeat = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
        if len(repeat):
            run = np.concatenate([[True], np.diff(repeat) > 1])
            first = np.flatnonzero(run)
            number = np.arange(len(repeat)) - np.repeat(first, np.diff(np.append(first, len(repeat)))) + 1
            h[order[repeat]] += number.astype(_U) * _U(0xD6E8FEB86659FD93)
        g = mixed(h)
        order = np.argsort(g)
        ranked = g[order]
        begin = np.searchsorted(ranked, np.arange(self.slots, dtype=_U) << _U(64 - self.bits))
        size = np.minimum(np.diff(np.append(begin, len(g))), self.keep)
        value, where = np.zeros((self.slots, self.keep), dtype=_U), np.full((self.slots, self.keep), np.iinfo(np.int64).max)
        for j in range(self.keep):
            has = np.flatnonzero(size > j)
            value[has, j], where[has, j] = ranked[begin[has] + j], order[begin[has] + j]
        in_order = np.take_along_axis(value, np.argsort(where, axis=1, kind="stable"), axis=1)
        joined = np.zeros(self.slots, dtype=_U)
        for j in range(self.keep):
            joined = mixed(joined * _U(31) + in_order[:, j] + _U(j))
        out[:] = np.where(size > 0, (joined >> _U(32)) | _U(1), _U(0)).astype(np.uint32)
        return out

    @staticmethod
    def text(tuples: np.ndarray) -> str:
        return tuples.astype(">u4").tobytes().hex()

    @staticmethod
    def likeness(a: np.ndarray, b: np.ndarray) -> float:
        """Slots with equal tuples, of those that either has; 1 where neither has any."""
        either = int(((a != 0) | (b != 0)).sum())
        return float(((a == b) & (a != 0)).sum() / either) if either else 1.0


def _at_least(bounds: list[int], x: Column) -> Column:
    """How many of the sorted bounds are x or more, by chunks of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    chunk = math.isqrt(len(bounds)) + 1
    as_array = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
    starts = bounds[::chunk]
    before = len(starts) - F.size(F.filter(as_array(starts), lambda b: b >= x))  # chunks that begin below x
    inside = F.slice(as_array(bounds), F.greatest(F.lit(1), (before - 1) * chunk + 1), chunk)
    part = F.when(before > 0, F.size(F.filter(inside, lambda b: b >= x))).otherwise(0)
    return F.greatest(F.lit(0), len(bounds) - before * chunk) + part


def fingerprints(docs: DataFrame, method: OrderMinHash | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: doc_id, n_chars (code points), edited_sha256 of the edited text, the fingerprint of either,
    and near_edited and near_next (0 to 1): how like the row's fingerprint is to the edited text's and the next row's.

    Rows are in order of doc_id descending, nulls last, then of text; the row after the last is the first, so the row of
    a one-row table follows itself. Edited: the last n_chars // 2 code points give way to as many from the next
    row's start, or all it has. A null text counts as empty; texts without a k-mer are like each other (1) and unlike all
    others (0). Repeated rows follow each other; other columns are left out.

    One shuffle of the text: rows go by ranges of doc_id whose bounds are approximate quantiles, as many as there are
    shuffle partitions, and the first row of each range is sent along to the range before it.
    """
    method = method or OrderMinHash()
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = n_partitions(spark)
    bounds = sorted({int(x) for x in rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)} if n > 1 else set())
    above = _at_least(bounds, F.col("doc_id"))
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(above))
    heads = {r["part"]: r["first"] for r in rows.select("part", "doc_id").groupBy("part").agg(F.max("doc_id").alias("first")).collect()}
    parts = sorted(heads)
    before = [(heads[p], parts[i - 1]) for i, p in enumerate(parts)]
    to = spark.createDataFrame(before, "first long, to int")
    first = rows.where(F.col("doc_id").isin([x for x, _ in before if x is not None]) | (F.col("doc_id").isNull() if any(x is None for x, _ in before) else F.lit(False)))
    first = first.groupBy("doc_id").agg(F.min("text").alias("text"))
    tails = first.join(F.broadcast(to), F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text", F.col("to").alias("part"), F.lit(True).alias("tail"))
    dealt = rows.withColumn("tail", F.lit(False)).unionByName(tails).repartitionById(len(bounds) + 2, F.col("part").cast("int"))
    dealt = dealt.sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for whole in batches:
            out = []
            for row in zip(*(whole.column(whole.schema.get_field_index(x)).to_pylist() for x in ("doc_id", "text", "part", "tail")), strict=True):
                points = code_points(row[1])
                tuples = method.tuples(points)
                if last is not None:
                    out.append(follow(last, row, points, tuples))
                last = None if row[3] else (row, points, tuples)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(SCHEMA), SCHEMA.types, strict=True)], schema=SCHEMA)

    def follow(last, row, points, tuples):
        (i, whole, _, _), own, mine = last
        half = len(own) // 2
        text = whole[: len(own) - half] + row[1][:half]
        changed = method.tuples(np.concatenate([own[: len(own) - half], points[:half]]))
        return i, len(own), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), method.text(mine), method.text(changed), method.likeness(mine, changed), method.likeness(mine, tuples)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def op6_order_minhash(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return fingerprints(table(spark, sf_dir, "documents"))
