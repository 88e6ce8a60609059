"""Byte-level BPE encoding and decoding with two tiers: a minimal perfect hash of the vocabulary, then a heap over linked bytes."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from tessera.llm.common import beside

_M = (1 << 64) - 1


def _place(h, d, n):
    """Slot of the hash h under the displacement d; the same for Python's integers and numpy's."""
    if isinstance(h, int):
        x = ((h ^ (d * 0x9E3779B97F4A7C15 & _M)) * 0xD6E8FEB86659FD93) & _M
        return (x >> 32) % n
    x = (h ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(32)) % np.uint64(n)


class PerfectHash:
    """A minimal perfect hash (hash and displace): n keys in n slots, one displacement for each bucket of about four keys.

    get(key) is the value of key, or None: the slot's own key is compared, so strings outside the set are never taken
    for members.
    """

    def __init__(self, items: dict[bytes, int]):
        self.n, keys = max(1, len(items)), list(items)
        self.n_buckets = self.n // 4 + 1
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        of = (h % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(self.n_buckets + 1))
        free = np.ones(self.n, dtype=bool)
        self.shift = [0] * self.n_buckets
        self.keys: list[bytes | None] = [None] * self.n
        self.values = [-1] * self.n
        singles = []
        for b in np.argsort(-np.diff(starts), kind="stable").tolist():
            members = order[starts[b] : starts[b + 1]]
            if len(members) == 1:
                singles.append((b, int(members[0])))
            elif len(members):
                self._settle(b, members, h[members], free, keys, items)
        for (b, m), slot in zip(singles, np.flatnonzero(free).tolist(), strict=False):  # a lone key takes any free slot
            self.shift[b] = -1 - slot
            self.keys[slot], self.values[slot] = keys[m], items[keys[m]]

    def _settle(self, b, members, h, free, keys, items):
        first, step = 0, 64
        while True:
            d = np.arange(first, first + step, dtype=np.uint64)
            slots = _place(h[None, :], d[:, None], self.n).astype(np.int64)
            in_order = np.sort(slots, axis=1)
            ok = free[slots].all(axis=1) & (in_order[:, 1:] != in_order[:, :-1]).all(axis=1)
            if ok.any():
                k = int(ok.argmax())
                self.shift[b] = first + k
                for m, slot in zip(members.tolist(), slots[k].tolist(), strict=True):
                    free[slot], self.keys[slot], self.values[slot] = False, keys[m], items[keys[m]]
                return
            first, step = first + step, min(step * 2, 1 << 16)

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.n_buckets]
        slot = -1 - d if d < 0 else _place(h, d, self.n)
        return self.values[slot] if self.keys[slot] == key else None


class _Memo(dict):
    """Ids (decimals with a space between) of pre-tokens, looked up here and made where they are missing. Once half of the entries that may be held
    are new, they become the old half and the old half goes: what keeps coming back stays, at most `most` are held."""

    def __init__(self, make, most: int, longest: int):
        self.make, self.half, self.longest, self.old = make, max(1, most // 2), longest, {}

    def __missing__(self, t: str) -> str:
        ids = self.old.get(t)
        if ids is None:
            ids = self.make(t)
        if len(t) <= self.longest:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[t] = ids
        return ids


class Codec:
    """Ranks (token bytes to id) and a pattern of pre-tokens, as an encoder and decoder."""

    #: Distinct pre-tokens whose ids a task remembers, at most (beyond, those that came up longest ago go first), and characters of the longest of them:
    #: about 200 MB at most, and some 40 MB for usual texts.
    REMEMBERED, LONGEST = 1 << 18, 32

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.whole, self.pattern = ranks, PerfectHash(ranks), pattern
        self._start()

    def _start(self):
        ranks = self.ranks
        self._find = regex.compile(self.pattern).findall
        self._byte = [ranks[bytes([x])] for x in range(256)]
        # by the left id: the right id to what both merge to; the last, of no token, merges with nothing
        self._right: list[dict[int, int]] = [{} for _ in range(max(ranks.values()) + 2)]
        for t, r in ranks.items():
            for i in range(1, len(t)):
                if t[:i] in ranks and t[i:] in ranks:
                    self._right[ranks[t[:i]]][ranks[t[i:]]] = r
        self._tokens = {r: t for t, r in ranks.items()}
        self._decimals = {r: str(r) for r in self._tokens}
        self._by_decimals = {str(r): t for r, t in self._tokens.items()}
        self._seen = _Memo(self._ids, self.REMEMBERED, self.LONGEST)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def word(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if (i := self.whole.get(piece)) is not None:
            return [i]
        return self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until no pair is in the vocabulary.

        The heap holds rank and place of pairs of neighbours, as rank * n + place; want[i] is the entry that the pair at i has now, so
        that entries of pairs which are gone are passed over. Behind the last byte, and before the first, is an id of no token.
        """
        byte, right = self._byte, self._right
        n, none = len(piece), len(right) - 1
        ids = [byte[x] for x in piece]
        ids.append(none)
        after, before, want, heap = list(range(1, n + 1)), list(range(-1, n)), [-1] * (n + 1), []
        for i in range(n - 1):
            if (r := right[ids[i]].get(ids[i + 1])) is not None:
                want[i] = x = r * n + i
                heap.append(x)
        heapq.heapify(heap)
        push, pop, replace = heapq.heappush, heapq.heappop, heapq.heapreplace
        while heap:
            x = heap[0]
            i = x % n
            if want[i] != x:
                pop(heap)
                continue
            r = x // n
            j = after[i]
            after[i] = k = after[j]
            before[k] = i
            ids[i], ids[j], want[j] = r, none, -1
            if (q := right[r].get(ids[k])) is not None:
                want[i] = q = q * n + i
                replace(heap, q)
            else:
                want[i] = -1
                pop(heap)
            h = before[i]
            if (q := right[ids[h]].get(r)) is not None:
                want[h] = q = q * n + h
                push(heap, q)
            else:
                want[h] = -1
        return [x for x in ids if x != none]

    def _ids(self, t: str) -> str:
        return " ".join(map(self._decimals.__getitem__, self.word(t.encode("utf-8", "surrogatepass"))))

    def encode_text(self, text: str) -> str:
        """Ids as decimals with a space between."""
        return " ".join(map(self._seen.__getitem__, self._find(text)))

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.encode_text(text).split()))

    def decode(self, ids) -> bytes:
        return b"".join(map(self._tokens.__getitem__, ids))

    def decode_decimals(self, ids: list[str]) -> bytes:
        """The same of ids as decimals."""
        return b"".join(map(self._by_decimals.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def bpe_encode(docs: DataFrame, codec: Codec, text: str = "text", digest: bool = False, ids: bool = False) -> DataFrame:
    """docs and, of each row's whole text, n_tokens long, and either ids array<int>, decoded string or, with digest,
    ids_sha256 and decoded_sha256 string (lowercase hex of the ids as decimals joined by one space, and of the bytes
    that decoding those ids gives); with digest and ids, ids array<int> before the digests.

    A null text counts as empty (no tokens, the digests of nothing). Repeated rows give repeated rows, an empty table an
    empty one; columns of docs of the same names are replaced. Rows go through Python in Arrow batches with no shuffle.
    The codec goes to the executors as one broadcast: its size is that of the vocabulary, whatever the input.
    """
    sent = docs.sparkSession.sparkContext.broadcast(codec)
    types = {"n_tokens": "long", **({"ids": "array<int>"} if ids or not digest else {}), **({"ids_sha256": "string", "decoded_sha256": "string"} if digest else {"decoded": "string"})}
    made, arrow = list(types), {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}
    kept = docs.drop(*(x for x in made if x != text))
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = sent.value
        for batch in batches:
            out = {x: [] for x in made}
            for t in batch.column(at):
                joined = codec.encode_text(t.as_py() or "")
                found = joined.split(" ") if joined else []
                raw = codec.decode_decimals(found)
                out["n_tokens"].append(len(found))
                if "ids" in out:
                    out["ids"].append(np.array(list(map(int, found)), dtype=np.int32))
                if digest:
                    out["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
                else:
                    out["decoded"].append(raw.decode("utf-8", "replace"))
            new = [pa.array(out[x], arrow[t]) for x, t in types.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(f"m{i}" for i in range(len(made)))])

    return beside(kept, types, run)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.common import table

    codec = Codec(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), codec, digest=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
