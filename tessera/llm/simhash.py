"""SimHash near-duplicates: exact all-pairs search in tiles, and the groups that the links make."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import beside, components, cut, n_partitions, roots

RADIUS = 3
_U = np.uint64


def simhash(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Of the whole text: words are runs of anything but space and \\x09-\\x0D, A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    h = xxhash.xxh64_intdigest
    hashes = [h(joined[a : b - 1], seed) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :].tolist(), strict=False)]
    over = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[i : i + (1 << 14)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        over += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * over > len(hashes), bitorder="little").view("<u8")[0])


def with_simhash(docs: DataFrame, text: str = "text", into: str = "simhash") -> DataFrame:
    """docs and into: the 64 fingerprint bits as a long. A null text counts as empty: 0."""
    kept = docs.drop(into) if into != text else docs
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([simhash(t.as_py() or "") for t in batch.column(at)], dtype=_U).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], names=[*batch.schema.names, "m0"])

    return beside(kept, {into: "long"}, run)


#: Fingerprints in one tile of a bucket, about; blocks that a hot bucket's open bits are cut into; what makes a tile.
TILE, FINER = 1024, 6
KEY = ["j", "i", "v", "c"]


def _choices(bits: int, blocks: int) -> list[int]:
    """Masks of all but RADIUS of so many blocks of the set bits, for each choice."""
    places = [b for b in range(64) if bits >> b & 1]
    edges = [round(len(places) * k / blocks) for k in range(blocks + 1)]
    parts = [sum(1 << b for b in places[a:e]) for a, e in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(kept) for kept in itertools.combinations(parts, blocks - RADIUS)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _banded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(x, j, i, v) at home in their own range c of population counts and visiting the one below; and n of each tile in which some may meet."""
    band = F.floor(F.bit_count("x") / (RADIUS + 1)).cast("int")
    both = F.array(F.struct(band.alias("c"), F.lit(True).alias("home")), F.struct((band - 1).alias("c"), F.lit(False).alias("home")))
    rows = rows.select("x", "j", "i", "v", F.explode(both).alias("t")).select("x", "j", "i", "v", "t.*")
    counts = rows.groupBy(KEY).agg(F.count("*").alias("n"), F.count(F.when(F.col("home"), 1)).alias("homes")).where("n > 1 and homes > 0")
    return rows, counts.select(*KEY, "n")


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile key columns, side, x), those of a tile together. Exclusive-or and bit counts of all pairs in a tile,
    shift by shift over all tiles of a batch at once; links come as a spanning forest, at most one for each row."""

    def forest(key, side, home, x):
        if not len(x):
            return
        group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        size = np.bincount(group)[group]
        found_i, found_j = [], []
        at = np.flatnonzero(size > 1)
        shift = 1
        while len(at):
            at = at[at + shift < len(x)]
            at = at[group[at] == group[at + shift]]
            other = at + shift
            # tiles of two parts compare across them; visitors meet at home
            pair = (home[at] | home[other]) & ((side[at] != side[other]) | (side[at] == 2))
            near = np.bitwise_count(x[at] ^ x[other]) <= RADIUS
            hit = at[pair & near]
            if len(hit):
                found_i.append(hit)
                found_j.append(hit + shift)
            if sum(map(len, found_i)) > 1 << 20:
                found_i, found_j = thin(found_i, found_j, len(x))
            shift += 1
        if found_i:
            i, j = thin(found_i, found_j, len(x))
            yield pa.RecordBatch.from_arrays([pa.array(x[i[0]].view(np.int64)), pa.array(x[j[0]].view(np.int64))], names=["a", "b"])

    def thin(i, j, n):
        root = roots(n, np.concatenate(i), np.concatenate(j))
        low = np.flatnonzero(root != np.arange(n))
        return [low], [root[low]]

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, side, home, x = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("key", "side", "home", "x"))
        now = [key, side, home.astype(bool), x.astype(np.int64).view(_U)]
        if held is not None:
            now = [np.concatenate(p) for p in zip(held, now, strict=True)]
        begins = np.flatnonzero(np.diff(now[0])) + 1
        last = int(begins[-1]) if len(begins) else 0  # where the tile begins that may go on in the next batch
        yield from forest(*(c[:last] for c in now))
        held = [c[last:] for c in now]
    if held is not None:
        yield from forest(*held)


def links(prints: DataFrame, n: int) -> DataFrame:
    """A spanning forest (a, b) of the links between the n distinct fingerprints x: all pairs at RADIUS bits or fewer.

    The 64 bits are cut into blocks; RADIUS bits touch at most RADIUS of them, so two linked fingerprints agree
    in some choice of all but RADIUS blocks, and each such choice is a bucket. There are as many blocks as make chance
    company in a bucket rare (one in sixteen) for n fingerprints; the answer is the same for any number. In a bucket a tile holds a range of population counts
    wider than RADIUS, at home, and as visitors those of the range above: tiles further apart are never compared.

    A bucket with more than TILE rows in a tile is hot: its rows are dealt anew by choices of all but RADIUS of FINER blocks of the bits that
    the bucket leaves open, one row for each choice, so that only those meet which agree in more bits. As many as then are
    still more than TILE (half the open bits stay open, 16 of 64 for hundreds of millions of fingerprints) are cut into parts, each two of which
    meet in a tile of their own.
    """
    blocks = next(b for b in itertools.count(RADIUS + 1) if 16 * n <= 1 << 64 * (b - RADIUS) // b or b == 12)
    masks = _choices((1 << 64) - 1, blocks)
    bucket = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col("x").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(masks)))).alias("bucket")
    rows, counts = _banded(prints.select("x", bucket).select("x", F.lit(-1).alias("j"), "bucket.i", "bucket.v"))
    counts = cut(counts)
    cold = rows.join(counts.where(F.col("n") <= TILE), KEY)
    # in a hot bucket the bits that are not chosen are cut into blocks again: its pairs agree in some choice of those too
    finer = F.array(*(F.array(*(F.lit(_signed(m | f)) for f in _choices(~m & (1 << 64) - 1, FINER))) for m in masks))
    hot = rows.where("home").join(counts.where(F.col("n") > TILE).select("i", "v").distinct(), ["i", "v"], "left_semi").select("x", "i").distinct()
    again = hot.select("x", "i", F.posexplode(F.element_at(finer, F.col("i") + 1)).alias("j", "mask")).select("x", "j", "i", F.col("x").bitwiseAND(F.col("mask")).alias("v"))
    again, finer_counts = _banded(again)
    again = again.join(cut(finer_counts), KEY)
    rows = cold.unionByName(again).withColumn("parts", F.ceil(F.col("n") / TILE).cast("int")).drop("n")
    part = F.pmod(F.xxhash64("x"), "parts").cast("int")
    rows = rows.withColumn("own", part).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    one, two = F.least("own", "with"), F.greatest("own", "with")
    rows = rows.select(F.xxhash64(*KEY, one, two).alias("key"), F.when(one == two, 2).when(F.col("own") == one, 0).otherwise(1).alias("side"), "home", "x")
    dealt = rows.repartition(n_partitions(prints.sparkSession), "key").sortWithinPartitions("key", "x")
    return dealt.mapInArrow(_tile_links, "a long, b long")


def near_groups(rows: DataFrame) -> DataFrame:
    """rows(doc_id, x) to (x, component_id): for each distinct fingerprint the smallest doc_id that its links reach.

    component_id is null where no doc_id is known there. All distinct fingerprints take part; the graph's nodes are
    fingerprints, so copies cost no link.
    """
    first = cut(rows.groupBy("x").agg(F.min("doc_id").alias("first")))
    root = components(links(first.select("x"), first.count()))
    of = cut(first.join(root, F.col("x") == F.col("node"), "left").select("x", "first", F.coalesce("root", "x").alias("root")))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    return of.join(least, "root").select("x", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint string (16 lowercase hex digits), component_id (the smallest doc_id
    reachable by links of at most RADIUS differing bits, itself included).

    A null or empty text has fingerprint zero and is linked like any other. A null doc_id never names a component (null
    where a component has no other). Repeated rows are kept; other columns are left out; an empty table gives none.
    """
    rows = cut(with_simhash(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), into="x").select("doc_id", "x"))
    found = rows.join(near_groups(rows), "x")
    return found.select("doc_id", F.lower(F.lpad(F.hex("x"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash_groups(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
