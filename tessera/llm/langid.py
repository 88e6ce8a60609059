"""Language identification by cross-parsing: how few phrases of a language's text does a document consist of?"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import beside

_CODES = 0x110000
_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(_CODES)), dtype=bool, count=_CODES))
    return _LETTERS[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def normalised(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of anything but letters as one space."""
    points = code_points(text.lower())
    letter = _is_letter()[points]
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return points[keep]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings of text; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new, p = len(moves), last
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


class _Packed:
    """Sparse transitions of many automata in two flat arrays (a double array): a state is the place `base` where its row begins, the
    move by code c stands at base + c, and is the state's own if `owner` says so. Rows overlap wherever their moves don't; no two
    states have one base. The arrays are about as long as there are moves, however many codes there are."""

    def __init__(self, width: int):
        self.width, self.used, self.taken, self.low = width, bytearray(width), bytearray(2 * width), 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _room(self, slot: int) -> None:
        if slot + 2 * self.width >= len(self.used):
            more = len(self.used) + 2 * self.width + 4096
            self.used.extend(bytes(more))
            self.taken.extend(bytes(more))

    def add(self, moves: list[dict[int, int]]) -> tuple[int, dict[int, int]]:
        """Pack one automaton; its start state, and the state that each first code leads to."""
        width, base = self.width, [0] * len(moves)
        rows = sorted((s for s, m in enumerate(moves) if len(m) > 1), key=lambda s: (-len(moves[s]), s))
        low = self.low
        for s in rows:
            codes = sorted(moves[s])
            first, tries, slot = codes[0], 0, self.used.find(0, low)
            rest = [c - first for c in codes[1:]]
            while True:
                self._room(slot)
                used = self.used
                if not self.taken[slot - first + width] and not any(used[slot + d] for d in rest):
                    break
                tries += 1
                if tries == 64:  # the slots here are all but full
                    low, tries = slot, 0
                slot = used.find(0, slot + 1)
            base[s] = slot - first
            self.taken[slot - first + width] = 1
            for d in (0, *rest):
                used[slot + d] = 1
        slot, left = self.used.find(0, self.low), []
        single = [(s, next(iter(m))) for s, m in enumerate(moves) if len(m) == 1]
        for s, c in single:
            for k, x in enumerate(left):
                if not self.taken[x - c + width]:
                    at = left.pop(k)
                    break
            else:
                while True:
                    self._room(slot)
                    at, slot = slot, self.used.find(0, slot + 1)
                    if not self.taken[at - c + width]:
                        break
                    if len(left) < 8:
                        left.append(at)
            base[s] = at - c
            self.taken[at - c + width] = self.used[at] = 1
        for s, m in enumerate(moves):
            if not m:
                free = self.taken.find(0, width)
                base[s] = free - width
                self.taken[free] = 1
        self._room(max(base) + width)
        while self.low < len(self.used) and self.used[self.low]:
            self.low = self.used.find(0, self.low)
        n = [len(m) for m in moves]
        owners = np.repeat(np.array(base, np.int64), n)
        codes = np.fromiter((c for m in moves for c in m), np.int64, sum(n))
        to = np.array(base, np.int64)[np.fromiter((t for m in moves for t in m.values()), np.int64, sum(n))]
        self.parts.append((owners + codes, owners.astype(np.int32), to.astype(np.int32)))
        return base[0], {c: base[t] for c, t in moves[0].items()}

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """owner and target of each slot, shifted by width, as bases may be negative."""
        size = max((int(p[0].max(initial=0)) for p in self.parts), default=0) + 3 * self.width + 1
        size = max(size, len(self.taken) - self.taken[::-1].find(1) + 2 * self.width if 1 in self.taken else 0)
        owner, target = np.full(size, np.iinfo(np.int32).min, np.int32), np.zeros(size, np.int32)
        for at, own, to in self.parts:
            owner[at + self.width], target[at + self.width] = own + self.width, to + self.width
        return owner, target


class Languages:
    """One suffix automaton of labelled text per language; many texts run through them in step.

    A phrase is the longest match that begins where the one before it ended; a character that the language's text has nowhere
    begins a phrase, which goes on with the longest match behind it. Every character of any language's text is a symbol of its own; only
    characters that no language has are one. A whole text is parsed as one: all languages see the same characters, so
    fewest phrases are fewest for each character.

    Stretches of SPAN characters run side by side, first as if a phrase began at each; then each goes on from where the one
    before it really ended until both ways meet in one state, from where on they are the same. The count is
    that of one run through the text.
    """

    SPAN = 512
    #: Stretches that run in step, and rounds in which late changes go on to the next stretch before they are followed one by one.
    LANES, ROUNDS = 1 << 12, 8

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        norm = {k: normalised(v) for k, v in texts.items()}
        self.known = np.unique(np.concatenate([*norm.values(), np.array([32], np.uint32)]))
        self.width, self.pad = len(self.known) + 2, len(self.known) + 1
        self._map()
        packed, self.start, first = _Packed(self.width), [], []
        for name in self.names:
            start, after = packed.add(suffix_automaton(self.code[norm[name]].tolist()))
            self.start.append(start + self.width)
            row = np.full(self.width, start + self.width, np.int32)
            row[list(after)] = np.array(list(after.values()), np.int32) + self.width if after else start
            first.append(row)
        self.owner, self.target = packed.arrays()
        self.first = first

    def _map(self) -> None:
        self.code = np.full(_CODES, len(self.known), dtype=np.int32)  # what no language has
        self.code[self.known] = np.arange(len(self.known))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "code"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._map()

    def phrases(self, codes: np.ndarray) -> np.ndarray:
        """codes: rows of symbols, each a text of its own with pad behind it. Phrases of each in each language."""
        lengths = (codes != self.pad).sum(axis=1)
        return self._parse(codes.astype(np.int32), lengths, np.ones(len(codes), bool))

    def _parse(self, codes: np.ndarray, lengths: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Phrases that begin in each stretch; stretches that are no head go on with the one before."""
        out = np.zeros((len(codes), len(self.names)), dtype=np.int64)
        for j in range(len(self.names)):
            carry = self.start[j]
            for a in range(0, len(codes), self.LANES):
                part = slice(a, a + self.LANES)
                out[part, j], carry = self._together(j, codes[part], lengths[part], head[part], carry)
        return out

    def _step(self, j: int, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = state + c
        fail = self.owner[at] != state
        return np.where(fail, self.first[j][c], self.target[at]).astype(np.int64), fail

    def _together(self, j: int, codes: np.ndarray, lengths: np.ndarray, head: np.ndarray, carry: int) -> tuple[np.ndarray, int]:
        """Counts of one chunk of stretches, and the state at its end; carry is the state before its first stretch."""
        n = len(codes)
        order = np.argsort(-lengths, kind="stable")
        lane = np.empty(n, np.int64)
        lane[order] = np.arange(n)
        symbols = np.ascontiguousarray(codes[order].T)
        long = lengths[order]
        span = int(long[0]) if n else 0
        active = np.searchsorted(-long, -np.arange(span), side="left")  # lanes longer than t
        seen = np.zeros((span, n), np.int32)
        total = np.zeros((span, n), np.int16 if self.SPAN < 1 << 15 else np.int32)
        state, count, end = np.full(n, self.start[j], np.int64), np.zeros(n, np.int32), np.full(n, self.start[j], np.int64)
        for t in range(span):
            m = active[t]
            if t == 0:
                state[:m], fail = self.first[j][symbols[0, :m]], True
            else:
                state[:m], fail = self._step(j, state[:m], symbols[t, :m])
            count[:m] += fail
            seen[t, :m], total[t, :m] = state[:m], count[:m]
        counts, ends = count[lane].astype(np.int64), state[lane]
        whole = counts.copy()
        todo = np.flatnonzero(~head & (lengths > 0))
        rounds = 0
        while len(todo):
            rounds += 1
            if rounds > self.ROUNDS:
                self._one_by_one(j, int(todo[0]), codes, lengths, head, seen, total, lane, whole, counts, ends, carry)
                break
            entry = np.where(todo > 0, ends[np.maximum(todo - 1, 0)], carry)
            row, lanes, state, fails = todo, lane[todo], entry.astype(np.int64), np.zeros(len(todo), np.int64)
            changed = []
            for t in range(span):
                going = long[lanes] > t
                if not going.all():
                    ended = ~going
                    counts[row[ended]] = fails[ended]
                    moved = ends[row[ended]] != state[ended]
                    ends[row[ended]] = state[ended]
                    changed.append(row[ended][moved])
                    row, lanes, state, fails = row[going], lanes[going], state[going], fails[going]
                if not len(row):
                    break
                state, fail = self._step(j, state, symbols[t, lanes])
                fails += fail
                met = seen[t, lanes] == state
                if met.any():
                    done = row[met]
                    counts[done] = fails[met] + whole[done] - total[t, lanes[met]]
                    final = seen[lengths[done] - 1, lanes[met]].astype(np.int64)
                    moved = ends[done] != final
                    ends[done] = final
                    changed.append(done[moved])
                    stay = ~met
                    row, lanes, state, fails = row[stay], lanes[stay], state[stay], fails[stay]
            if len(row):
                counts[row] = fails
                moved = ends[row] != state
                ends[row] = state
                changed.append(row[moved])
            after = np.unique(np.concatenate(changed)) + 1 if changed else np.zeros(0, np.int64)
            after = after[after < n]
            todo = after[~head[after] & (lengths[after] > 0)]
        return counts, int(ends[-1]) if n else carry

    def _one_by_one(self, j, row, codes, lengths, head, seen, total, lane, whole, counts, ends, carry) -> None:
        """What _together's rounds do, in order from `row`, for texts in which the ways hardly ever meet."""
        owner, target, first = self.owner, self.target, self.first[j]
        for i in range(row, len(codes)):
            if head[i] or not lengths[i]:
                continue
            state, fails = int(ends[i - 1]) if i else carry, 0
            for t, c in enumerate(codes[i, : lengths[i]].tolist()):
                if owner[state + c] == state:
                    state = int(target[state + c])
                else:
                    state, fails = int(first[c]), fails + 1
                if seen[t, lane[i]] == state:
                    counts[i], ends[i] = fails + whole[i] - total[t, lane[i]], seen[lengths[i] - 1, lane[i]]
                    break
            else:
                counts[i], ends[i] = fails, state

    def counts(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (normalised code points) in each language."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        n = -(-lengths // self.SPAN)
        owner = np.repeat(np.arange(len(texts)), n)
        codes = np.full((int(n.sum()), self.SPAN), self.pad, dtype=np.int32)
        if len(codes):
            within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            long = np.minimum(self.SPAN, lengths[owner] - within * self.SPAN)
            codes[np.arange(self.SPAN)[None, :] < long[:, None]] = self.code[np.concatenate(texts)]
            per = self._parse(codes, long, within == 0)
            out = np.zeros((len(texts), len(self.names)), np.int64)
            np.add.at(out, owner, per)
            return out
        return np.zeros((len(texts), len(self.names)), np.int64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        points, at, size = [], [], 0

        def settle():
            nonlocal size
            for i, total in zip(at, self.counts(points), strict=True):
                order = np.argsort(total, kind="stable")
                names[i] = self.names[order[0]]
                scores[i] = float(1 - total[order[0]] / total[order[1]]) if len(order) > 1 else 1.0
            points.clear()
            at.clear()
            size = 0

        for i, t in enumerate(texts if self.names else []):
            p = normalised(t) if t else np.zeros(0, np.uint32)
            if not (p != 32).any():
                continue
            points.append(p)
            at.append(i)
            size += len(p)
            if size >= self.SPAN * self.LANES:
                settle()
        settle()
        return names, scores


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_chars: int = 24_576, excerpt: int = 512) -> Languages:
    """Fit Languages on a bounded sample of the rows with a text and a lang: for each language about sample_chars
    characters, in excerpts of at most `excerpt` characters from rows that a hash of doc_id picks. These two parameters bound
    what comes to the driver and what is broadcast; the number of languages is that of the labels.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.col(doc_id).cast("string")).alias("h"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Languages({})
    wanted = sample_chars // excerpt
    share = F.create_map(*(x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, 4 * wanted / n)))))
    place = F.pmod("h", F.lit(1 << 20)).cast("double") / (1 << 20)
    begin = F.pmod(F.shiftright("h", 20), F.greatest(F.lit(1), F.char_length("t") - excerpt)).cast("int") + 1
    picked = rows.where(place <= share[F.col("l")]).select("l", "h", F.substring("t", begin, F.lit(excerpt)).alias("t")).collect()
    texts: dict[str, str] = {}
    for r in sorted(picked, key=lambda r: (r["h"], r["t"])):
        if len(texts.setdefault(r["l"], "")) < sample_chars:
            texts[r["l"]] += r["t"] + "\n"
    return Languages({k: v for k, v in texts.items() if v.strip()})


def identify(docs: DataFrame, languages: Languages, text: str = "text") -> DataFrame:
    """docs and lang_pred string, score double (0 to 1: by what part the best language needs fewer phrases than the next).

    Predictions see the whole text alone. A null text and a text without a letter give `und` and 0; so does every
    text where nothing was learned. Ties go to the first language by code point. Repeated rows give the same twice;
    columns of these names are replaced. One pass in Arrow batches, no shuffle. What is broadcast is about ten to fifteen bytes for each
    move of the automata, of which a language has at most three for each character of its sample: under a megabyte with `learn`'s bounds.
    """
    sent = docs.sparkSession.sparkContext.broadcast(languages)
    kept = docs.drop(*(x for x in ("lang_pred", "score") if x != text))
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = sent.value
        for whole in batches:
            for a in range(0, max(1, whole.num_rows), 2048):
                batch = whole.slice(a, 2048)
                names, scores = languages.predict(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "m0", "m1"])

    return beside(kept, {"lang_pred": "string", "score": "double"}, run)


def held_out(doc_id: str = "doc_id"):
    """Rows that are kept for testing: crc32 of doc_id as text is 2 modulo 4; a null doc_id isn't."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    docs = table(spark, sf_dir, "documents")
    languages = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), languages).select("doc_id", "held_out", "lang_pred", "score")
