"""Suffix-array dedup: bytes that an earlier document has too, found by two-stage suffix sorting of what may repeat.

A string of LENGTH bytes has an anchor: the leftmost of its k-byte pieces with the smallest hash. Neighbouring strings
with the same anchor make a segment, so equal strings lie in segments with equal anchors. Anchors only say which strings may be
equal; whether they are is settled by suffix arrays and their common prefixes alone: one for all that a batch of documents may have twice,
and then, of the strings that are a batch's first, one for all segments of an anchor that several batches have.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, n_partitions
from tessera.llm.ordermin import _BASE, _UNBASE, _powers, mixed

_U = np.uint64
LENGTH, ANCHOR = 50, 24
#: Bytes of text that are hashed at once, and bytes of segments that make one suffix array, about.
STRETCH, SORTED = 1 << 20, 1 << 20
#: Segments of one anchor, a batch's first ones, beyond which each of their strings is dealt by its own hash instead of the anchor.
HOT = 4096
#: Parts, by anchor, in which segments' texts are sent and sorted one after the other: each takes that much less disk.
PASSES = 2
_PLACE = 22
_POWERS: list[np.ndarray] = []
#: Numbers of two bytes, three bytes, ... begin here.
_BYTES = _U(1) << np.arange(8, 64, 8, dtype=_U)


def _two_powers() -> list[np.ndarray]:
    if not _POWERS:
        n = STRETCH + 2 * LENGTH + 1
        _POWERS.extend([_powers(_BASE, n), _powers(_UNBASE, n)])
    return _POWERS


def _words(text: np.ndarray, after: int) -> np.ndarray:
    """The eight bytes from each place of text and of `after` bytes of zeros behind it, as numbers in the order of the bytes."""
    n = len(text) + after
    raw = np.zeros(n + 16, np.uint8)
    raw[: len(text)] = text
    out = np.empty(n, _U)
    for k in range(min(8, n)):
        out[k::8] = raw[k : k + (n - k + 7) // 8 * 8].view(">u8")
    return out


def two_stage_sort(text: np.ndarray, depth: int = 56, wanted: np.ndarray | None = None, words: np.ndarray | None = None) -> np.ndarray:
    """Places of text's suffixes in order of their first `depth` bytes at least: of all, or of those that are marked in wanted and
    the few that these are placed by. words: _words() of text and at least depth + 13 more, if at hand.

    Suffixes that are smaller than their successors are sorted directly. They end each first byte's bucket; a scan from the smallest
    up puts each other suffix, when its successor is reached, at the front of its own bucket. The scan goes by
    buckets, with all that one bucket holds so far at once.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    step = np.sign(np.diff(text.astype(np.int16), append=np.int16(-1)))
    where = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n))
    rising = step[np.minimum.accumulate(where[::-1])[::-1]] > 0
    del where, step
    # what is asked for, and behind it all up to the next suffix that is sorted directly
    needed = np.ones(n, bool) if wanted is None else _up_to(wanted, rising)
    falling = needed & ~rising
    sizes = np.bincount(text[needed], minlength=256)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    direct = _sort_directly(_words(text, depth + 13) if words is None else words, np.flatnonzero(needed & rising).astype(np.int32), depth)
    first_of = np.concatenate([[0], np.cumsum(np.bincount(text[direct], minlength=256))])
    order = np.empty(int(ends[-1]), dtype=np.int32)
    front = begins.copy()

    def induce(done: np.ndarray) -> None:
        before = done[done > 0] - 1
        before = before[falling[before]]
        if not len(before):
            return
        byte = text[before]
        stable = np.argsort(byte, kind="stable")
        before, byte = before[stable], byte[stable]
        count = np.bincount(byte, minlength=256)
        order[front[byte] + np.arange(len(byte)) - np.repeat(np.cumsum(count) - count, count)] = before
        np.add(front, count, out=front)

    induce(np.array([n]))
    for c in np.flatnonzero(sizes).tolist():
        at = begins[c]
        while at < front[c]:
            upto = front[c]
            induce(order[at:upto])
            at = upto
        own = direct[first_of[c] : first_of[c + 1]]
        order[ends[c] - len(own) : ends[c]] = own
        induce(own)
    return order


def _up_to(wanted: np.ndarray, rising: np.ndarray) -> np.ndarray:
    """wanted, and from each of these on all places to the first that is rising."""
    place = np.arange(len(wanted), dtype=np.int32)
    last = np.maximum.accumulate(np.where(wanted, place, np.int32(-1)))
    stop = np.maximum.accumulate(np.where(rising, place, np.int32(-1)))
    return last > np.concatenate([np.array([-1], np.int32), stop[:-1]])


def _sort_directly(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """places in order of what stands there, five bytes a round. Only what is still tied goes on, unless all that is tied together is equal
    to the last byte, which is looked at after a few rounds: then any order of them is one."""
    if not len(places):
        return places
    k = words[places] >> _U(24)
    order, k = _by_key(k, 40)
    places = places[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    settled = np.zeros(len(places), bool)
    for level in range(1, -(-depth // 5)):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied & ~settled)
        if level in (3, 6) and len(at):
            same = _equal(words, places[at], depth) | new[at]
            first = np.flatnonzero(new[at])
            whole = np.logical_and.reduceat(same, first)
            settled[at] = np.repeat(whole, np.diff(np.append(first, len(at))))
            at = at[~settled[at]]
        if not len(at):
            break
        group = np.cumsum(new[at])  # those of a group are neighbours: the first of each is marked
        k = words[places[at] + 5 * level] >> _U(24)
        by_key, ranked = _by_key(k, 40)
        rank = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        bits = [int(x).bit_length() for x in (group[-1], rank[-1])]
        whole = np.empty(len(at), _U)
        whole[by_key] = rank.astype(_U)
        whole |= group.astype(_U) << _U(bits[1])
        order, whole = _by_key(whole, sum(bits))
        places[at] = places[at[order]]
        new[at[1:]] |= whole[1:] != whole[:-1]
    return places


def _equal(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Whether what stands at each place is, for depth bytes at least, what stands at the one before it in places."""
    out = np.ones(len(places), bool)
    out[0] = False
    for a in range(0, depth, 8):
        some = words[places + a]
        out[1:] &= some[1:] == some[:-1]
    return out


def _by_key(k: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys of so many bits, and the keys in order: with the places in the low bits, if there is room, as sorting numbers is
    several times faster than sorting places."""
    own = (len(k) - 1).bit_length()
    if bits + own > 64:
        order = np.argsort(k, kind="stable")
        return order, k[order]
    both = k << _U(own) | np.arange(len(k), dtype=_U)
    both.sort()
    return (both & _U((1 << own) - 1)).astype(np.int32), both >> _U(own)


def common_prefixes(words: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix of order shares with the one before it, `most` at most; words of a text that has most bytes after each."""
    out = np.zeros(len(order), dtype=np.int64)
    same = np.ones(max(0, len(order) - 1), bool)
    for a in range(0, most, 8):
        some = words[order + a]
        apart = some[1:] ^ some[:-1]
        ends = np.flatnonzero(same & (apart != 0))
        out[ends + 1] += 7 - np.searchsorted(_BYTES, apart[ends], side="right")
        same &= apart == 0
        out[1:] += 8 * same
    return np.minimum(out, most)


def segments(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Segments of all texts: doc (place in texts), start, n (strings) and anchor (a 48-bit hash)."""
    up, down = _two_powers()
    parts: list[dict[str, np.ndarray]] = []
    pieces: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        nonlocal size
        if not pieces:
            return
        text = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        lengths = np.array([len(p[2]) for p in pieces])
        begin = np.cumsum(lengths) - lengths
        of = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        n = len(text)
        total = np.zeros(n + 1, dtype=_U)
        np.cumsum((text.astype(_U) + _U(1)) * up[:n], out=total[1:])
        h = mixed((total[ANCHOR:] - total[:-ANCHOR]) * down[: n - ANCHOR + 1])
        low = (h & ~_U((1 << _PLACE) - 1)) | np.arange(len(h), dtype=_U)
        span, have = LENGTH - ANCHOR + 1, 1
        while have < span:
            more = min(have, span - have)
            low = np.minimum(low[:-more], low[more:])
            have += more
        at = np.flatnonzero(of[: n - LENGTH + 1] == of[LENGTH - 1 :])
        anchor = (low[at] & _U((1 << _PLACE) - 1)).astype(np.int64)
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(at) != 1)])
        first = np.flatnonzero(new)
        s = at[first]
        count = np.diff(np.append(first, len(at)))
        doc, offset = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
        parts.append({"doc": doc[of[s]], "start": (s - begin[of[s]] + offset[of[s]]).astype(np.int64), "n": count.astype(np.int64), "anchor": h[anchor[first]] >> _U(16)})
        pieces.clear()
        size = 0

    for i, t in enumerate(texts):
        for a in range(0, len(t) - LENGTH + 1, STRETCH):
            p = t[a : a + STRETCH + LENGTH - 1]
            if size + len(p) > STRETCH + LENGTH:
                flush()
            pieces.append((i, a, p))
            size += len(p)
    flush()
    names = ("doc", "start", "n", "anchor")
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in names}


def earlier(text: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of the strings of LENGTH bytes that begin at `at` in text, which are also those of a document smaller than their own."""
    where = np.full(len(text), -1, dtype=np.int32)
    where[at] = np.arange(len(at), dtype=np.int32)
    words = _words(text, 72)
    order = two_stage_sort(text, wanted=where >= 0, words=words)
    order = order[where[order] >= 0]
    owner = doc[where[order]]
    first = np.flatnonzero(common_prefixes(words, order, LENGTH) < LENGTH)
    least = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, len(order)))) if len(order) else owner
    out = np.zeros(len(at), dtype=bool)
    out[where[order]] = owner > least
    return out


def _short(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _long(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


ROWS = "bucket int, kind int, doc_id long, text string, data binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("data", pa.binary())])
#: Kinds of rows: segments by anchor, repeats by document, segments to fetch by document, fetched segments by anchor, documents.
SEGMENTS, REPEATS, WANTED, FETCHED, DOCUMENT = range(5)


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array([r[2] for r in rows], pa.binary())], schema=_SCHEMA)


def _split(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    edges = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[a]), [c[a:b] for c in columns]


def _by_document(kind: int, n: int, ids: np.ndarray, marks: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    return [(b, kind, pickle.dumps(c, 5)) for b, c in _split(ids % n, ids, marks, *columns)]


def _mark(text: bytes) -> int:
    """Tells rows with the same doc_id and different texts apart."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=4).digest(), "little")


def _strings(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts, starts + 1, ... of n strings each."""
    return np.repeat(starts, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _merged(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of strings that follow each other as one."""
    order = np.lexsort((start, doc))
    doc, start, n = doc[order], start[order], n[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1])]) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return doc[first], start[first], np.add.reduceat(n, first) if len(first) else n


def _runs(of: np.ndarray, place: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of some strings, by segment and place, those that begin a run of neighbours within a segment, and how many each run has."""
    new = np.concatenate([[True], (np.diff(of[some]) != 0) | (np.diff(place[some]) != 1)]) if len(some) else np.zeros(0, bool)
    return some[new], np.diff(np.append(np.flatnonzero(new), len(some)))


def _late(ids: np.ndarray, texts: list[bytes], s: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Strings that a smaller document of the batch has too, as doc, start and n of runs; s is left with the others."""
    order = np.argsort(s["anchor"], kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(s["anchor"][order]) != 0]))
    owner = ids[s["doc"][order]]
    several = np.empty(len(order), bool)
    several[order] = np.repeat(np.minimum.reduceat(owner, first) < np.maximum.reduceat(owner, first), np.diff(np.append(first, len(order))))
    at = np.flatnonzero(several)
    at = at[np.lexsort((s["start"][at], s["doc"][at]))]
    doc, start, n, anchor = (s[k][at] for k in ("doc", "start", "n", "anchor"))
    run_doc, run_start, run_n = _merged(doc, start, n)
    if int((run_n + LENGTH - 1).sum()) > 2 * SORTED and len(ids) > 1:  # two arrays of half the documents; what both have is settled by anchor
        half = len(ids) // 2
        parts = []
        for low, high in ((0, half), (half, len(ids))):
            inside = (s["doc"] >= low) & (s["doc"] < high)
            part = {k: v[inside] for k, v in s.items()}
            part["doc"] = part["doc"] - low
            found = _late(ids[low:high], texts[low:high], part) if inside.any() else (np.zeros(0, np.int64),) * 3
            part["doc"] = part["doc"] + low
            parts.append((part, (found[0] + low, found[1], found[2])))
        for k in s:
            s[k] = np.concatenate([p[0][k] for p in parts])
        return tuple(np.concatenate([p[1][i] for p in parts]) for i in range(3))
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    text = np.frombuffer(b"".join(texts[d][a : a + c + LENGTH - 1] for d, a, c in zip(run_doc.tolist(), run_start.tolist(), run_n.tolist(), strict=True)), np.uint8)
    length = run_n + LENGTH - 1
    late = earlier(text, _strings(np.cumsum(length) - length, run_n), np.repeat(ids[run_doc], run_n))
    # back to segments: what is left of each, in runs
    of, place = np.repeat(np.arange(len(at)), n), _strings(start, n)
    head, count = _runs(of, place, np.flatnonzero(~late))
    left = {"doc": doc[of[head]], "start": place[head], "n": count, "anchor": anchor[of[head]]}
    for k in s:
        s[k] = np.concatenate([s[k][~several], left[k]])
    head, count = _runs(of, place, np.flatnonzero(late))
    return _merged(doc[of[head]], place[head], count)


def _find(n: int):
    """Documents to segments by anchor; repeats within a batch are settled at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            marks = np.array([_mark(t) for t in texts], dtype=np.int64)
            s = segments(texts)
            if not len(s["doc"]):
                continue
            doc, start, count = _late(ids, texts, s)
            out = _by_document(REPEATS, n, ids[doc], marks[doc], start, count)
            for b, (doc, start, count, anchor) in _split((s["anchor"] % _U(n)).astype(np.int64), s["doc"], s["start"], s["n"], s["anchor"]):
                order = np.lexsort((start, doc))
                doc = doc[order]
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                data = (ids[doc[first]], marks[doc[first]].astype(np.uint32), np.diff(np.append(first, len(doc))).astype(np.uint32), start[order].astype(np.uint32), count[order].astype(np.uint8), _short(anchor[order]))
                out.append((b, SEGMENTS, pickle.dumps(data, 5)))
            if out:
                yield _rows(out)

    return run


def _compare(n: int, passes: int = 1):
    """Segments of a bucket of anchors to those that must be sorted: whose anchor several documents have. They are dealt to passes by bucket."""

    def settle(held: list[tuple], bucket: int) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        runs = [x[2].astype(np.int64) for x in held]
        anchor = np.concatenate([_long(x[5]) for x in held])
        ids = np.concatenate([np.repeat(x[0], r) for x, r in zip(held, runs, strict=True)])
        order = np.argsort(anchor, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], np.diff(anchor[order]) != 0]))
        sizes = np.diff(np.append(begin, len(ids)))
        several = np.minimum.reduceat(ids[order], begin) < np.maximum.reduceat(ids[order], begin)
        want = order[np.repeat(several, sizes)]
        hot = np.repeat(sizes > HOT, sizes)[np.repeat(several, sizes)]
        marks = np.concatenate([np.repeat(x[1].astype(np.int64), r) for x, r in zip(held, runs, strict=True)])[want]
        start, count = (np.concatenate([x[i] for x in held])[want].astype(np.int64) for i in (3, 4))
        held.clear()
        out = _by_document(WANTED + 10 * (bucket % passes), n, ids[want], marks, start, count, anchor[want], hot)
        if out:
            yield _rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            passed = batch.filter(pa.array(batch.column(1).to_numpy() == REPEATS))
            if passed.num_rows:
                yield passed
            for b, kind, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4)), strict=True):
                if kind == SEGMENTS:
                    if b != bucket:
                        yield from settle(held, bucket)
                        bucket = b
                    held.append(pickle.loads(data))
        yield from settle(held, bucket)

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, bytes | None, list[np.ndarray]]]:
    """Rows sorted by bucket with a bucket's data before its documents: each document with its own part of the data."""
    bucket, held, ready = None, [], None
    for batch in batches:
        for b, kind, doc_id, text, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket:
                bucket, held, ready = b, [], None
            if kind != DOCUMENT:
                held.append(pickle.loads(data))
                continue
            if ready is None:
                ready = [np.concatenate(c) for c in zip(*held, strict=True)]
                if ready:
                    order = np.argsort(ready[0], kind="stable")
                    ready = [c[order] for c in ready]
            raw = None if text is None else text.encode("utf-8", "surrogatepass")
            if not ready or doc_id is None or not raw:
                yield doc_id, raw, []
                continue
            a, e = np.searchsorted(ready[0], [doc_id, doc_id + 1])
            own = [c[a:e] for c in ready[1:]]
            if a < e:
                mine = own[0] == _mark(raw)
                own = [c[mine] for c in own[1:]]
            yield doc_id, raw, own if a < e else []


def _fetch(n: int):
    """Documents and the segments wanted of them to those segments' texts, by anchor; hot ones string by string, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal size
            if not held:
                return None
            doc, start, count, route = (np.concatenate([h[i] for h in held]) for i in range(4))
            mark, texts = np.concatenate([h[4] for h in held]), [t for h in held for t in h[5]]
            held.clear()
            size = 0
            out = []
            for b, (k,) in _split((route % _U(n)).astype(np.int64), np.arange(len(doc))):
                data = (doc[k], mark[k], start[k].astype(np.uint32), count[k].astype(np.uint8), _short(route[k]), b"".join(texts[i] for i in k.tolist()))
                out.append((b, FETCHED, pickle.dumps(data, 5)))
            return _rows(out)

        for doc_id, raw, own in _documents(batches):
            if not own or not len(own[0]):
                continue
            start, count, anchor, hot = own
            route = anchor
            if hot.any():
                single = _strings(start[hot], count[hot])
                hashes = np.array([int.from_bytes(hashlib.blake2b(raw[i : i + LENGTH], digest_size=6).digest(), "little") for i in single.tolist()], dtype=_U)
                start, count, route = np.concatenate([start[~hot], single]), np.concatenate([count[~hot], np.ones(len(single), np.int64)]), np.concatenate([anchor[~hot], hashes])
            texts = [raw[a : a + c + LENGTH - 1] for a, c in zip(start.tolist(), count.tolist(), strict=True)]
            held.append((np.full(len(start), doc_id), start, count, route, np.full(len(start), _mark(raw)), texts))
            size += sum(map(len, texts))
            if size > 1 << 24:
                yield flush()
        if (last := flush()) is not None:
            yield last

    return run


def _sort(n: int):
    """Segments by anchor to the repeats among them, one suffix array for about SORTED bytes of whole anchors."""

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        doc, mark, start, count = (np.concatenate([h[i].astype(np.int64) for h in held]) for i in range(4))
        route, text = np.concatenate([_long(h[4]) for h in held]), np.frombuffer(b"".join(h[5] for h in held), np.uint8)
        held.clear()
        length = count + LENGTH - 1
        begin = np.cumsum(length) - length
        order = np.argsort(route, kind="stable")
        doc, mark, start, count, route, length, begin = (c[order] for c in (doc, mark, start, count, route, length, begin))
        upto = np.cumsum(length)
        a = 0
        while a < len(doc):
            b = int(np.searchsorted(upto, upto[a] - length[a] + SORTED, side="right"))
            b = max(a + 1, min(b, len(doc)))
            b = int(np.searchsorted(route, route[b - 1], side="right"))
            part, a0, a = slice(a, b), a, b
            chosen = text[_strings(begin[part], length[part])]
            at = _strings(np.cumsum(length[part]) - length[part], count[part])
            late = earlier(chosen, at, np.repeat(doc[part], count[part]))
            row, places = np.repeat(np.arange(a0, b), count[part]), _strings(start[part], count[part])
            head, n_strings = _runs(row, places, np.flatnonzero(late))
            if len(head):  # neighbouring strings of a text as one run
                row, places = row[head], places[head]
                by = np.lexsort((mark[row], doc[row]))
                new = np.concatenate([[True], (np.diff(doc[row[by]]) != 0) | (np.diff(mark[row[by]]) != 0)])
                of = np.empty(len(row), np.int64)
                of[by] = np.cumsum(new) - 1
                text_of = row[by[new]]
                own, places, n_strings = _merged(of, places, n_strings)
                yield _rows(_by_document(REPEATS, n, doc[text_of[own]], mark[text_of[own]], places, n_strings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if b != bucket:
                    yield from settle(held)
                    bucket = b
                held.append(pickle.loads(data))
        yield from settle(held)

    return run


def removed_runs(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of bytes that strings at start, start + 1, ... (n of them) cover."""
    order = np.argsort(start, kind="stable")
    a, b = start[order], np.maximum.accumulate(start[order] + n[order] + LENGTH - 1)
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for doc_id, raw, own in _documents(batches):
        raw = raw or b""
        spans: list[list[int]] = []
        if own and len(own[0]):
            begin, end = removed_runs(*own)
            spans = [list(x) for x in zip(begin.tolist(), end.tolist(), strict=True)]
        kept, last = hashlib.sha256(), 0
        for a, b in spans:
            kept.update(raw[last:a])
            last = b
        kept.update(raw[last:])
        out.append((doc_id, len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), spans))
        if len(out) >= 4096:
            yield pa.RecordBatch.from_pylist([dict(zip(_RESULT.names, r, strict=True)) for r in out], schema=_RESULT)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(_RESULT.names, r, strict=True)) for r in out], schema=_RESULT)


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans long, kept_sha256 string, and spans (begin and end, exclusive,
    of each maximal removed run of bytes).

    Each byte of the text in UTF-8 goes that is covered by a string of LENGTH bytes which also starts in a document with a smaller doc_id;
    strings are judged on the input and don't cross documents. A null text counts as empty. Rows with a null doc_id lose
    nothing and take nothing from others; rows with the same doc_id take nothing from each other, so repeated rows get the
    same result. Texts of any length are hashed in stretches; other columns are left out.

    The text is read for the segments by anchor (hashes alone move; what a batch of documents has twice is settled before, in one suffix
    array), in each of PASSES for the texts of the segments whose anchor several batches have, and for the removal; the latter shuffle it. Buckets grow
    in number with the bytes of text. A third of all documents with one passage share its anchors, which in each batch is one
    segment; an anchor with more than HOT of them is dealt string by string, by the strings' own hashes. The result is the same on each way.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = _prime(max(2, n_partitions(spark), total >> 25))
    able = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    found = able.mapInArrow(_find(n), ROWS).repartitionById(n, "bucket").mapInArrow(_compare(n, PASSES), ROWS)
    found = cut(found)
    repeats = [found.where(F.col("kind") == REPEATS)]
    place = F.coalesce(F.pmod("doc_id", F.lit(n)), F.lit(0)).cast("int")
    as_rows = lambda df: df.select(place.alias("bucket"), F.lit(DOCUMENT).alias("kind"), "doc_id", "text", F.lit(None).cast("binary").alias("data"))
    meet = lambda df, data: as_rows(df).unionByName(data).repartitionById(n, "bucket").sortWithinPartitions("bucket", "kind")
    for k in range(PASSES):
        wanted = found.where(F.col("kind") == WANTED + 10 * k).withColumn("kind", F.lit(WANTED))
        repeats.append(cut(meet(able, wanted).mapInArrow(_fetch(n), ROWS).repartitionById(n, "bucket").mapInArrow(_sort(n), ROWS)))
    return meet(rows, reduce(DataFrame.unionByName, repeats)).mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(generate_series(0, len(h) // 2 - 50)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
late AS (SELECT w.doc_id, w.i FROM w JOIN m USING (s) WHERE w.doc_id > m.first),
n AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM late),
r AS (SELECT doc_id, min(i) AS b, max(i) + 50 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM n) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a, b AS z FROM r
  UNION ALL SELECT r.doc_id, max(e), any_value(len(h) // 2) FROM r JOIN d USING (doc_id) GROUP BY r.doc_id),
k AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(e - b) AS gone, count(*) AS spans FROM r GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op1_suffix_array(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return repeated_bytes(table(spark, sf_dir, "documents")).drop("spans")
