"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, embeddings, langid, licenses, lines, mixing, ordermin, pii, simhash, suffixes
from tessera.llm.common import components, roots
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, words: int = 400) -> str:
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(2, 9))) for _ in range(words)]
    return " ".join(r.choice(pool) for _ in range(n))


def corpus() -> list[tuple]:
    shared = prose(99, 70)
    texts = [prose(i, 60 + 20 * i) for i in range(8)]
    out = [(i, t, "ab"[i % 2], f"s{i % 3}") for i, t in enumerate(texts)]
    out += [
        (20, texts[0], "a", "s0"),  # a copy
        (21, texts[1].replace(texts[1].split()[5], "changed", 1), "b", "s1"),  # a near copy
        (22, texts[2] + "\n" + shared, "a", None),
        (23, shared + " " + texts[3][:40], None, "s2"),
        (24, None, None, None),
        (25, "", "b", "s1"),
        (26, "x", "a", "s1"),
        (27, "a" * 700, "a", "s0"),
        (28, "line one\nline two\n" * 30, "b", "s0"),
        (29, "head\nline one\nline two\ntail " + "日本語 😀 " * 20, "b", "s2"),
        (30, "\n\n \t", "b", "s2"),
        (31, prose(5, 4000), "a", "s1"),
        (31, prose(5, 4000), "a", "s1"),  # a repeated row
        (32, "\x1c\u0085 +1 (214) 555-7381 me@x.org 4111 1111 1111 1111 10.0.0.300 10.0.0.3", "a", "s0"),
        (None, texts[4], "a", "s1"),
        (None, "no id here", None, None),
    ]
    return [(a, t, lang, s, None if t is None else len(t)) for a, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


# ---- 1


def test_two_stage_sort():
    r = np.random.default_rng(1)
    for _ in range(60):
        t = r.integers(97, 97 + r.integers(1, 5), r.integers(0, 300)).astype(np.uint8)
        b = t.tobytes()
        assert [b[i:] for i in suffixes.two_stage_sort(t, depth=304)] == sorted(b[i:] for i in range(len(b)))


def repeated(rows):
    out, first = [], {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - 49) if i is not None else ():
            first[b[j : j + 50]] = min(i, first.get(b[j : j + 50], i))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49) if i is not None else ():
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot, stretch", [(4096, 1 << 22), (1, 1 << 22), (4096, 256)])
def test_repeated_bytes(docs, hot, stretch, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "STRETCH", stretch)
    suffixes._POWERS.clear()
    whole = suffixes.segments([(r[1] or "").encode() for r in corpus()])
    lengths = [len((r[1] or "").encode()) for r in corpus()]
    assert np.bincount(whole["doc"], weights=whole["n"], minlength=len(lengths)).tolist() == [max(0, n - 49) for n in lengths]
    same(suffixes.repeated_bytes(docs).drop("spans").collect(), repeated([(r[0], r[1]) for r in corpus()]))
    suffixes._POWERS.clear()


def test_hot_strings_are_sorted_one_by_one():
    text = prose(1, 60).encode()
    rows = [(i, 0, np.array([i]), text) for i in range(3)]
    assert len(rows) == 3
    late = suffixes.earlier(np.frombuffer(text * 2, np.uint8), np.array([0, len(text)]), np.array([5, 9]))
    assert late.tolist() == [False, True]


def test_repeated_bytes_of_nothing(empty):
    assert suffixes.repeated_bytes(empty).count() == 0


# ---- 2


def water(sizes, weights):
    total, out, level = 1.5 * sum(sizes), dict.fromkeys(range(len(sizes)), 0.0), set()
    while True:
        left = total - sum(2 * sizes[i] for i in level)
        open_ = [i for i in out if i not in level]
        w = sum(weights[i] for i in open_)
        for i in open_:
            out[i] = left * weights[i] / w
        over = [i for i in open_ if out[i] > 2 * sizes[i]]
        if not over:
            return out
        for i in over:
            level.add(i)
            out[i] = 2.0 * sizes[i]


def test_mix(spark, docs, empty):
    rows = [(i, f"s{i % 5}" if i % 11 else None, (i * 37) % 90) for i in range(900)] + [(1000 + i, "big", 400) for i in range(300)] + [(5000, "tiny", 3), (5001, "none", None)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(table).toPandas()
    assert len(got) == len(rows) and ((got.copies >= 0) & (got.copies <= 2)).all() and (got.taken == got.copies * got["size"]).all()
    names = sorted({r[1] for r in rows} - {None}) + [None]
    sizes = [sum(r[2] or 0 for r in rows if r[1] == n) for n in names]
    want = water(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))])
    for i, n in enumerate(names):
        part = got[got.source == n] if n is not None else got[got.source.isna()]
        assert part.source_size.unique().tolist() == [sizes[i]]
        assert part.target.iloc[0] == pytest.approx(want[i])
        assert abs(part.taken.sum() - want[i]) <= max(1, part["size"].max())
    again = mixing.mix(table).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    words = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    assert [r["size"] for r in words.where("doc_id IN (24, 25, 30, 28)").orderBy("doc_id").collect()] == [0, 0, 120, 0]
    assert mixing.mix(words).count() == len(corpus())
    assert mixing.mix(empty.withColumn("size", F.lit(1))).count() == 0


# ---- 3


def winnowed(rows):
    """Places that later repeats of two neighbouring lines cover."""
    def key(i, t):
        return (i is None, i if i is not None else 0)

    first = {}
    for i, t in rows:
        ls = [] if t is None else t.split("\n")
        for j in range(len(ls) - 1):
            k = tuple(ls[j : j + 2])
            first[k] = min(first.get(k, (key(i, t), j)), (key(i, t), j))
    out = []
    for i, t in rows:
        ls = [] if t is None else t.split("\n")
        gone = {x for j in range(len(ls) - 1) if (key(i, t), j) > first[tuple(ls[j : j + 2])] for x in (j, j + 1)}
        out.append((i, None if t is None else "\n".join(x for j, x in enumerate(ls) if j not in gone), len(ls), len(gone)))
    return out


def test_lines(docs, empty):
    rows = [(r[0], r[1]) for r in corpus()]
    same(lines.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed").collect(), winnowed(rows))
    assert lines.dedup_lines(empty).columns == [*empty.columns, "n_lines", "n_removed"] and lines.dedup_lines(empty).count() == 0
    clash = docs.withColumns({"n_lines": F.lit("x"), "h": F.lit(1), "row": F.lit(2)})
    assert lines.dedup_lines(clash).columns == [*docs.columns, "h", "row", "n_lines", "n_removed"]


# ---- 4


def test_suffix_automaton():
    text = "abracadabra"
    moves = langid.suffix_automaton([ord(c) for c in text])

    def holds(s):
        at = 0
        for c in s:
            at = moves[at].get(ord(c))
            if at is None:
                return False
        return True

    every = {text[i:j] for i in range(12) for j in range(i, 12)}
    assert all(holds(s) for s in every) and not any(holds(s) for s in ("ac" + "c", "rr", "abrab", "x"))


def test_phrases_by_brute_force():
    texts = {"a": prose(1, 300, 40), "b": prose(2, 300, 40)}
    model = langid.Languages(texts)
    probe = prose(1, 50, 40) + " Zz!? " + prose(2, 20, 40)
    points = langid.normalised(probe)
    codes = np.full((2, model.SPAN), model.pad, np.uint8)
    codes[0, : min(len(points), model.SPAN)] = model.code[points[: model.SPAN]]
    for j, name in enumerate(model.names):
        known = "".join(map(chr, langid.normalised(texts[name])))
        rest, n = "".join(map(chr, points[: model.SPAN])), 0
        while rest:
            k, begin = 1, int(rest[0] not in known)
            while k < len(rest) and rest[begin : k + 1] in known:
                k += 1
            rest, n = rest[k:], n + 1
        assert model.phrases(codes)[0, j] == n
    assert model.phrases(codes)[1].tolist() == [0, 0]


def test_language_id(spark, docs, empty):
    model = langid.learn(docs)
    assert model.names == ["a", "b"]
    got = langid.identify(docs.withColumn("score", F.lit("clash")), model)
    assert got.columns == [*docs.columns, "lang_pred", "score"] and got.count() == len(corpus())
    und = {r["doc_id"] for r in got.where("lang_pred = 'und'").collect()}
    assert und == {24, 25, 30}
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert langid.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.learn(empty)).collect()} == {"und"}
    out = langid.op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


# ---- 5


def test_bpe_matches_the_library(docs, empty, codec):
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    probes = [r[1] or "" for r in corpus()] + ["it's we'll \r\n\t x  \n ", "a" * 3000, "​　ﬁ", "<|endoftext|>"]
    for t in probes:
        assert codec.encode(t) == plain.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()
    rows = bpe.bpe_encode(docs.withColumn("ids", F.lit(1)), codec).collect()
    assert all(r["ids"] == plain.encode_ordinary(r["text"] or "") and r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["ids"]) for r in rows)
    digest = bpe.bpe_encode(docs, codec, digest=True).where("doc_id = 24").first()
    assert (digest["n_tokens"], digest["ids_sha256"]) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe.bpe_encode(empty, codec).count() == 0


def test_perfect_hash(codec):
    keys = list(codec.ranks.items())
    assert sorted(codec.whole.shift) and all(codec.whole.get(k) == v for k, v in keys[::37])
    assert codec.whole.n == len(keys) and None not in codec.whole.keys
    assert codec.whole.get(b"surely not a token of it") is None
    assert bpe.PerfectHash({}).get(b"x") is None


# ---- 6


def test_order_minhash(docs, empty):
    method = ordermin.OrderMinHash()
    rows = sorted(((r[0], r[1] or "") for r in corpus()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = (method.tuples(langid.code_points(x)) for x in (t, edited, after))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), method.text(a), method.text(b), method.likeness(a, b), method.likeness(a, c)))
    same(ordermin.fingerprints(docs).collect(), want)
    assert ordermin.fingerprints(empty).count() == 0
    one = ordermin.fingerprints(docs.where("doc_id = 3")).first()
    assert one["near_next"] == 1.0


def test_order_minhash_sees_order():
    m = ordermin.OrderMinHash(bits=4)
    a, b = prose(1, 200), prose(2, 200)
    x, y = (m.tuples(langid.code_points(t)) for t in (a + " " + b, b + " " + a))
    assert m.likeness(x, x) == 1.0 and 0.2 < m.likeness(x, y) < 0.95


# ---- 7


def plain_simhash(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    rows = [(r[0], plain_simhash(r[1])) for r in corpus()]
    x = np.array([p for _, p in rows], dtype=np.uint64)
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)
    root = roots(len(x), i, j)
    want = [(d, f"{p:016x}", min((rows[k][0] for k in np.flatnonzero(root == root[n]) if rows[k][0] is not None), default=None)) for n, (d, p) in enumerate(rows)]
    same(simhash.near_duplicates(docs).collect(), want)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("tile", [1024, 4])
def test_links_in_tiles(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    r = random.Random(3)
    seeds = [r.getrandbits(64) for _ in range(12)]
    prints = sorted({s ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 4))) & ((1 << 64) - 1) for s in seeds for _ in range(25)})
    x = np.array(prints, dtype=np.uint64)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "x long")
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)
    want = roots(len(x), i, j)
    at = {int(v): k for k, v in enumerate(x.view(np.int64))}
    found = [(at[e["a"]], at[e["b"]]) for e in simhash.links(df, len(x)).collect()]
    a, b = np.array(found).reshape(-1, 2).T
    assert all(bin(prints[p] ^ prints[q]).count("1") <= 64 for p, q in found)
    assert np.array_equal(roots(len(x), a, b), want)


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    a, b = np.array(edges).T
    root = roots(2000, a, b)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[n] == root[n] for n in got) and {n for e in edges for n in e if e[0] != e[1]} == set(got)


# ---- 8


def test_licenses(spark, docs, empty):
    scanner = licenses.Scanner()
    r = random.Random(2)
    texts = []
    for k in range(40):
        parts = [prose(k, r.randint(0, 120))]
        for name in r.sample(sorted(licenses.TEMPLATES), r.randint(0, 2)):
            notice = licenses.TEMPLATES[name].split()
            if r.random() < 0.4 and len(notice) > 30:
                notice[r.randrange(len(notice))] = "other"
            parts += [" ".join(notice), prose(k + 100, r.randint(1, 60))]
        texts.append(" ".join(parts))

    def brute(t):
        w = licenses.words(t)
        have = set(zip(*(w[i:] for i in range(5)), strict=False))
        return {n for n, s in zip(scanner.names, scanner.sets, strict=True) if len(s & have) >= 0.8 * len(s)}

    for t in texts:
        assert {m[0] for m in scanner.scan(t)} == brute(t)
    noted = spark.createDataFrame([(1, "Foo. Released under the MIT License. Bar."), (1, "Foo. Released under the MIT License. Bar."), (2, None)], "doc_id long, text string")
    assert [tuple(x) for x in licenses.scan_licenses(noted).collect()] == [(1, "MIT", 1.0, 1, 6)] * 2
    assert licenses.scan_licenses(docs).count() == 0 and licenses.scan_licenses(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.Scanner({"x": "too short"})


# ---- 9

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def known(t):
    def fine(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    out = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, t or "") if fine(kind, m.group()))
    return ",".join(f"{list(BASE)[k]}:{s}:{e}" for s, k, e in out)


def test_known_identifiers(spark, docs, empty):
    more = ["a@b.c_d@e.f@g.h 1.2.3.4.5.6.7.8 +1 (214) 555-7381-", "0000001.2.3.256 4111 1111-1111 1111 é😀 4111111111111111 x@y..z a@b-c.d. ", "9" * 3000, "a" * 20000 + "@", " ".join(f"u{i}@h.io" for i in range(1500)), "+1" + "(" * 5000, "1.1.1.1" * 700]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    got = pii.find_pii(table).collect()
    want = [(r[0], hashlib.sha256(known(r[1]).encode()).hexdigest()) for r in corpus()] + [(100 + i, hashlib.sha256(known(t).encode()).hexdigest()) for i, t in enumerate(more)]
    same([(r["doc_id"], r["base_sha256"]) for r in got], want)
    assert pii.find_pii(empty).count() == 0


def test_contexts_discover_more(spark):
    r = random.Random(4)
    rows = [(i, f"{prose(i, 9)} reach me via user{i}@host{i}.org now {prose(i + 50, 9)}") for i in range(30)]
    rows += [(100 + i, f"{prose(i, 5)} reach me via user{i}(at)host{r.randint(1, 9)} now {prose(i, 5)}") for i in range(5)]
    rows += [(200 + i, f"{prose(i, 5)} in the year {1900 + i} it {prose(i, 5)}") for i in range(20)]
    got = {x["doc_id"]: x for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        if 100 <= i < 200:
            kind, s, e = got[i]["spans"].split(":")
            assert kind == "email" and "(at)host" in t[int(s) : int(e)] and got[i]["n_email"] == 0
        else:
            assert got[i]["spans"] == known(t)


# ---- 10


def test_embeddings(spark):
    r = np.random.default_rng(8)
    rows = []
    for c in range(12):
        centre = r.normal(size=16)
        rows += [(len(rows) + k, (centre + r.normal(size=16) * 0.12).astype(float).tolist(), c % 3) for k in range(15)]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, rows[0][1], 1), (503, rows[0][1], None), (504, None, 0), (505, [0.0] * 16, 0), (506, [float("nan")] + [1.0] * 15, 0), (507, [None] + [1.0] * 15, 0), (508, [], 0), (509, [2.0], 0), (510, [3.0], 0), (511, [1e-300] * 16, 0), (512, [1e300] * 16, 0), (None, rows[3][1], 0), (513, [-1.0], 0)]
    got = {x["vec_id"]: tuple(x)[1:] for x in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}

    def fine(v, label):
        return label is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = [np.array(v) / np.abs(v).max() if fine(v, lab) else None for _, v, lab in rows]
    unit = [None if v is None else v / np.linalg.norm(v) for v in unit]
    i, j = zip(*((a, b) for a in range(len(rows)) for b in range(len(rows)) if a != b and unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93), strict=True)
    root = roots(len(rows), np.array(i), np.array(j))
    for n, (vec, _, _) in enumerate(rows):
        component = min((rows[k][0] for k in np.flatnonzero(root == root[n]) if rows[k][0] is not None), default=None)
        assert got[vec] == (i.count(n), component, vec is not None and vec == component), vec
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_recall_of_the_index():
    r = np.random.default_rng(2)
    x = r.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = embeddings.MultiIndex(x, 12, 0.93, 0.999)
    near = 0.93 * x + np.sqrt(1 - 0.93**2) * (lambda u: u / np.linalg.norm(u, axis=1)[:, None])(r.normal(size=x.shape) - 0)
    near /= np.linalg.norm(near, axis=1)[:, None]
    close = (x * near).sum(axis=1) >= 0.93
    home = index.look(near)[0]
    _, row, cell = index.look(x)
    visited = set(zip(row.tolist(), cell.tolist(), strict=True))
    found = [(k, int(home[k])) in visited for k in np.flatnonzero(close).tolist()]
    assert np.mean(found) >= 0.98 and len(visited) < 0.8 * len(x) * 144


# ---- pipeline


def test_pipeline_stages(spark, docs, codec):
    at = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, SF)
        at = spark.createDataFrame(at.collect(), at.schema)
        seen.append(name)
        if name == "language_id":
            same(at.collect(), before.where("doc_id IS NULL OR doc_id NOT IN (24, 25, 30)").collect())
        if name == "line_dedup":
            want = [(i, t) for i, t, n, gone in winnowed([(r["doc_id"], r["text"]) for r in before.collect()]) if gone == 0 or gone < n]
            same([(r["doc_id"], r["text"]) for r in at.collect()], want)
        if name == "near_dedup":
            groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(before).collect() if r["doc_id"] is not None}
            assert {r["doc_id"] for r in at.collect() if r["doc_id"] is not None} == {k for k, v in groups.items() if k == v}
        if name == "mix_sources":
            assert 0 < at.count() <= 2 * before.count() and at.columns == docs.columns
    assert seen == ["language_id", "line_dedup", "near_dedup", "mix_sources", "encode"]
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(at.columns) and at.count() > 0
    for r in at.collect():
        assert len(r["ids_sha256"]) == 64


def test_pipeline_encodes(spark, docs, codec):
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    got = corpus_pipeline.encode(spark, docs, SF)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    want = []
    for i, t, lang, source, _ in corpus():
        ids = plain.encode_ordinary(t or "")
        want.append((i, lang, source, len(ids), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same(got.collect(), want)


def test_pipeline_mixes_rows(spark):
    rows = [(i, prose(i, 20 + i % 30), "a", f"s{i % 3}", 1) for i in range(40)]
    rows += [row for row in rows[:20] for _ in range(3)] + [(None, prose(90, 25), "b", "s0", 2)] * 5
    before = spark.createDataFrame(rows, SCHEMA)
    after = corpus_pipeline.mix_sources(spark, before, SF).collect()
    words = [len(t.split()) for _, t, *_ in rows]
    sizes = [sum(n for n, row in zip(words, rows, strict=True) if row[3] == f"s{k}") for k in range(3)]
    for k, want in water(sizes, [3, 1, 2]).items():
        assert abs(sum(len(r["text"].split()) for r in after if r["source"] == f"s{k}") - want) <= 50, k
    assert {tuple(r) for r in after} <= set(rows)


def test_pipeline_keeps_one_row_of_a_group(spark):
    texts = [prose(i, 80) for i in range(6)]
    rows = [(3, texts[0], "a"), (1, texts[0], "a"), (None, texts[0], "a")]  # null id in a group with ids
    rows += [(None, texts[1], "a"), (None, texts[1], "b"), (None, texts[2], "a")]  # copies without ids, one alone
    rows += [(1, texts[3], "a"), (0, texts[3], "a")]  # an id that stays elsewhere
    rows += [(7, texts[4], "a")] * 3 + [(8, texts[4] + " x", "a")]  # repeated rows
    rows += [(9, texts[5], "a"), (9, texts[4], "c")]  # one id in two groups
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], SCHEMA)
    prints = [plain_simhash(t) for _, t, _ in rows]
    i, j = zip(*((a, b) for a in range(len(rows)) for b in range(len(rows)) if a != b and (prints[a] ^ prints[b]).bit_count() <= 3), strict=True)
    root = roots(len(rows), np.array(i), np.array(j)).tolist()
    groups = {k: [row for row, of in zip(rows, root, strict=True) if of == k] for k in root}
    got = [(r["doc_id"], r["text"], r["lang"]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    assert len(got) == len(groups)
    for members in groups.values():
        kept = [row for row in got if row in members]
        assert len(kept) == 1 and kept[0][0] == min((m[0] for m in members if m[0] is not None), default=None), members
