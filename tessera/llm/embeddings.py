"""Embedding near-duplicates through an inverted multi-index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, cut, n_partitions, roots


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """At most k centres of the rows of x."""
    rng = np.random.default_rng(seed)
    centres = np.unique(x[rng.permutation(len(x))[:k]], axis=0)
    for _ in range(rounds):
        of = _distances(x, centres).argmin(axis=1)
        sums, n = np.zeros_like(centres), np.bincount(of, minlength=len(centres))
        np.add.at(sums, of, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :])


class MultiIndex:
    """One codebook per half of a unit vector; a cell of the product grid is a pair of centres.

    limit is how far a search goes, as a squared distance: the `recall` quantile of how far off the own cells are of vectors at the cosine
    `least`, drawn about the sample's vectors in random directions, and of the sample's own links; but no link can be
    further than 2 - 2 * least.
    """

    def __init__(self, x: np.ndarray, k: int, least: float, recall: float, seed: int = 11):
        half = x.shape[1] // 2
        self.books = [k_means(x[:, :half], k), k_means(x[:, half:], k)]
        self.between = [np.sqrt(_distances(b, b)) for b in self.books]
        away = np.random.default_rng(seed).normal(size=x.shape)
        away -= (away * x).sum(axis=1)[:, None] * x
        away /= np.maximum(_norm(away), 1e-300)[:, None] if len(x) else 1
        off = [self._off(x, least * x + math.sqrt(1 - least * least) * away)]
        for a in range(0, len(x), 1024):
            i, j = np.nonzero(x[a : a + 1024] @ x.T >= least)
            apart = i + a != j
            off.append(np.quantile(self._off(x[i[apart] + a], x[j[apart]]), [recall]) if apart.any() else np.zeros(1))
        self.limit = min(2 - 2 * least, max(np.quantile(off[0], recall), *(float(o[0]) for o in off[1:]))) + 1e-9

    def _bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """In each half: each row's own centre, and the least squared distance to where each centre is the nearest."""
        half = x.shape[1] // 2
        own, bounds = [], []
        for part, book, between in zip((x[:, :half], x[:, half:]), self.books, self.between, strict=True):
            d = _distances(part, book)
            near = d.argmin(axis=1)
            own.append(near)
            gap = (d - d[np.arange(len(x)), near][:, None]) / (2 * np.where(between[near] > 0, between[near], np.inf))
            bounds.append(np.maximum(0, gap) ** 2)
        return own, bounds

    def _off(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How far the cell of each row of y is from the row of x."""
        (a, b), (own, _) = self._bounds(x)[1], self._bounds(y)
        row = np.arange(len(x))
        return a[row, own[0]] + b[row, own[1]]

    def look(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's own cell, and (row, cell) of all cells to visit.

        In each half, a vector in another centre's cell is at least as far away as the plane between the two centres; squares of
        the halves add up. Each row has its two sequences of centres by that bound, and goes through pairs of them
        nearest first (a pair is reached after those before it in either sequence) until the sum exceeds the limit.
        """
        own, bounds = self._bounds(x)
        order = [np.argsort(b, axis=1, kind="stable") for b in bounds]
        ranked = [np.take_along_axis(b, o, axis=1) for b, o in zip(bounds, order, strict=True)]
        width, rows, cells, limit = len(self.books[1]), [], [], self.limit
        for i in range(ranked[0].shape[1]):  # the i-th centre of the first sequence, as far along the second as the sum allows
            going = np.flatnonzero(ranked[0][:, i] <= limit)
            if not len(going):
                break
            reach = (ranked[0][going, i][:, None] + ranked[1][going] <= limit).sum(axis=1)
            row = np.repeat(going, reach)
            j = np.arange(len(row)) - np.repeat(np.cumsum(reach) - reach, reach)
            rows.append(row)
            cells.append(order[0][row, i] * width + order[1][row, j])
        return own[0] * width + own[1], np.concatenate(rows), np.concatenate(cells)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1))


def _lists(column: pa.Array) -> list[np.ndarray]:
    whole, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
    return np.split(whole, ends[1:-1] - ends[0])


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 and of two components at least, so that there are two halves."""
    x = x / _norm(x)[:, None]
    return x if x.shape[1] > 1 else np.hstack([x, np.zeros_like(x)])


def _norm(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))


def _exact(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum((a * b).tolist()) / math.sqrt(math.fsum((a * a).tolist()) * math.fsum((b * b).tolist()))


#: Vectors of a cell in one part, about.
PART = 2048


def near_vectors(vectors: DataFrame, least: float = 0.93, recall: float = 0.9995, sample: int = 8192, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of vectors: vec_id, n_links long (other rows linked directly), component_id long (smallest vec_id
    reachable by links, itself included), kept boolean (vec_id = component_id).

    Rows link if their labels are equal and not null, their vectors equally long, and the cosine is `least` or more in double
    precision. Vectors that are null, empty or zero, or hold a null or a component that isn't finite, link with nothing and are kept.
    A null vec_id never names a component (null where there is no other). Repeated vectors of a label are one vector with a multiplicity, so
    that they count as links without being compared. Other columns are left out; an empty table gives none.

    Codebooks and the search limit for the target `recall` are fitted on about `sample` vectors for each length of
    vector; all vectors are indexed. There are about as many centres a half as make PART vectors a cell, but at most an eighth of the sample. Each
    vector visits the nearest cells up to the limit and is compared there with all vectors at home. Cells are cut into parts of about PART vectors, and visits to
    each part are one tile. Tiles return counts of links and a spanning forest, not pairs. A link that is found from one end only
    counts at both.
    """
    spark = vectors.sparkSession
    # components travel as they are: single precision is made double where cosines are taken
    vector = F.col(embedding) if vectors.schema[embedding].dataType.simpleString() == "array<float>" else F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), vector.alias("v"))
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = cut(rows.withColumn("key", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("label", F.size("v"), F.transform("v", lambda x: x.cast("double") + 0.0)))))
    distinct = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    distinct = cut(distinct.withColumn("dim", F.size("v")))
    sizes = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    indexes = {}
    for dim, n in sorted(sizes.items()):
        part = distinct.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, sample / n)))).select("v")
        x = np.array([r["v"] for r in part.limit(2 * sample).collect()], dtype=np.float64)
        indexes[dim] = MultiIndex(_unit(x), max(2, min(sample // 8, round(math.sqrt(n / PART)))), least, recall)
    sent = spark.sparkContext.broadcast(indexes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                for a in range(0, own.num_rows, 4096):
                    part = own.slice(a, 4096)
                    home, row, cell = sent.value[dim].look(_matrix(part.column(2)))
                    n = part.num_rows
                    visits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)), pa.array(cell[np.argsort(row, kind="stable")], pa.int64()))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(home, pa.int64()), visits], names=["key", "home", "visits"])

    cells = cut(distinct.select("key", "dim", "v").mapInArrow(assign, "key long, home long, visits array<long>"))
    placed = distinct.join(cells, "key")
    place = ["label", "dim", "cell"]
    homes = placed.select("key", "n", "v", "label", "dim", F.col("home").alias("cell"), F.col("visits").alias("ways"))
    parts = cut(homes.groupBy(place).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    homes = homes.join(parts, place).withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int")).withColumn("visitor", F.lit(False))
    visits = placed.select("key", "n", "v", "label", "dim", F.explode("visits").alias("cell"), F.array("home").alias("ways")).join(parts, place).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("visitor", F.lit(True))
    tile = F.xxhash64(*place, "part")
    both = homes.unionByName(visits).select(tile.alias("tile"), "visitor", "dim", "key", "n", "v", "ways")
    dealt = both.repartition(n_partitions(spark), "tile").sortWithinPartitions("tile", "visitor")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, at_home = None, []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            visitor = batch.column(1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(ids) != 0) | (visitor[1:] != visitor[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if ids[a] != tile:
                    tile, at_home, block = ids[a], [], None
                part = batch.slice(a, b - a)
                own = (part.column(3).to_numpy(), part.column(4).to_numpy(), _matrix(part.column(5)), _lists(part.column(6)))
                if not visitor[a]:
                    at_home.append(own)
                    continue
                if not at_home:
                    continue
                if block is None:
                    block = [np.concatenate(c) if isinstance(c[0], np.ndarray) else sum(c, []) for c in zip(*at_home, strict=True)]
                for c in range(0, len(own[0]), 1024):
                    yield from meet(block, [o[c : c + 1024] for o in own])

    def meet(block, guests):
        (hk, hn, hv, ways), (gk, gn, gv, cells) = block, guests
        cosine = gv @ hv.T
        close = cosine >= least
        for g, h in zip(*np.nonzero(np.abs(cosine - least) < 1e-9), strict=True):  # the same answer from either side
            a, b = (gv[g], hv[h]) if gk[g] < hk[h] else (hv[h], gv[g])
            close[g, h] = _exact(a, b) >= least
        close &= gk[:, None] != hk[None, :]
        if not close.any():
            return
        counts = close @ hn.astype(np.int64)
        g, h = np.nonzero(close)
        # who is at home counts a guest here unless it visits the guest's cell, where it will
        wide = np.concatenate(ways)
        known = np.repeat(np.arange(len(ways)), [len(w) for w in ways]) << 32 | wide
        alone = ~np.isin(h << 32 | np.concatenate(cells)[g], known)
        back_at, back = np.unique(h[alone], return_inverse=True)
        back_n = np.bincount(back, weights=gn[g[alone]], minlength=len(back_at)).astype(np.int64)
        keys, place = np.unique(np.concatenate([gk, hk]), return_inverse=True)
        root = roots(len(keys), place[: len(gk)][g], place[len(gk) :][h])
        up = np.flatnonzero(root != np.arange(len(keys)))
        some = np.flatnonzero(counts)
        a, n = np.concatenate([gk[some], hk[back_at], keys[up]]), np.concatenate([counts[some], back_n, np.zeros(len(up), np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n), pa.concat_arrays([pa.nulls(len(a) - len(up), pa.int64()), pa.array(keys[root[up]], pa.int64())])], names=["a", "links", "b"])

    met = cut(dealt.mapInArrow(compare, "a long, links long, b long"))
    root = components(met.where(F.col("b").isNotNull()).select("a", "b"))
    links = met.where(F.col("b").isNull()).groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    of = cut(distinct.select("key", "first", "n").join(root, F.col("key") == F.col("node"), "left").join(links, "key", "left").select("key", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "key").alias("root")))
    least_id = of.groupBy("root").agg(F.min("first").alias("component"))
    of = of.join(least_id, "root").select("key", "n_links", "component")
    out = rows.join(of, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a AS n, a AS r FROM l UNION SELECT reach.n, l.b FROM reach JOIN l ON l.a = reach.r),
c AS (SELECT n, min(r) AS component FROM reach GROUP BY n),
k AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.n = vec_id LEFT JOIN k ON k.a = vec_id
"""


def op10_embedding_groups(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return near_vectors(table(spark, sf_dir, "embeddings"))
