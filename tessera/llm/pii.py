"""Personal data: identifiers of known form, and others that stand where those stand. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BLANK, cut, forget

KINDS = ("email", "ip", "card", "phone")

#: The kinds' patterns as contract regular expressions that can't backtrack into long runs: possessive where what follows
#: is disjoint, and begun only where a run begins (or where the last match ended), since later starts in it match no more.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be an identifier of one of the kinds in another form: a row of words made of digits and their signs, or else a word that holds a digit,
#: or a sign between letters (as me(at)host or me[at]host; apostrophes and hyphens alone are no such signs). The kinds have no form without both.
CANDIDATE = (
    rf"(?<![^{BLANK}])(?:[0-9(+][0-9().+/-]*+(?:\x20[0-9(][0-9().+/-]*+)++(?![^{BLANK}.,;:!?])"
    rf"|[^0-9{BLANK}]*+[0-9][^{BLANK}]*+"
    rf"|[\p{{L}}][\p{{L}}'-]*+[^\p{{L}}0-9'{BLANK}-]++[\p{{L}}][^{BLANK}]*+)"
)
#: Words of context on each side.
REACH = 2
_CHUNK = 256


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = F.reverse(_digits(m))
    return F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda total, i: total + F.when(i % 2 == 1, digits.substr(i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), digits.substr(i, F.lit(1)).cast("int") + 1)),
        lambda total: total % 10 == 0,
    )


def _holds(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(m)).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _places(text: Column, pattern: str) -> Column:
    """Matches of pattern in order, as (s, e, m, l, r): start and end in code points, the match, and the words on both sides of it, whole.

    Starts are running sums over the pieces between matches; sums go by chunks, so that they cost little for
    thousands of matches too.
    """
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    n = F.size(matches)
    one = F.zip_with(
        F.slice(pieces, 1, n),
        F.zip_with(matches, F.slice(pieces, 2, n), lambda m, r: F.struct(m.alias("m"), F.substring_index(r, " ", REACH + 1).alias("r"))),
        lambda p, x: F.struct(F.char_length(p).alias("before"), F.char_length(x["m"]).alias("long"), x["m"].alias("m"), F.substring_index(p, " ", -REACH - 1).alias("l"), x["r"].alias("r")),
    )
    place = "struct<s:int,e:int,m:string,l:string,r:string>"

    def run(chunk):
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{place}>").alias("out"))
        return F.aggregate(
            chunk,
            start,
            lambda acc, x: F.struct(
                (acc["at"] + x["before"] + x["long"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["before"]).alias("s"), (acc["at"] + x["before"] + x["long"]).alias("e"), x["m"].alias("m"), x["l"].alias("l"), x["r"].alias("r")))).alias("out"),
            ),
        )

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / _CHUNK).cast("int")), lambda c: run(F.slice(one, c * _CHUNK + 1, _CHUNK)))
    shifted = F.aggregate(
        chunks,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{place}>>").alias("out")),
        lambda acc, c: F.struct(
            (acc["at"] + c["at"]).alias("at"),
            F.concat(acc["out"], F.array(F.transform(c["out"], lambda x: F.struct((x["s"] + acc["at"]).alias("s"), (x["e"] + acc["at"]).alias("e"), x["m"].alias("m"), x["l"].alias("l"), x["r"].alias("r"))))).alias("out"),
        ),
        lambda acc: F.flatten(acc["out"]),
    )
    return F.when(n == 0, F.array().cast(f"array<{place}>")).otherwise(shifted)


def _kept(i: int, kind: str) -> Column:
    return F.transform(F.filter(kind, lambda x: _holds(kind, x["m"])), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"), x["m"].alias("m"), x["l"].alias("l"), x["r"].alias("r")))


def _count(i: int, kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["k"] == i)).cast("long").alias(f"n_{kind}")


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _words(side: str) -> Column:
    """Words of the text on one side of an instance, lower-cased; the word that touches the instance is cut off."""
    touching = rf"[^{BLANK}]*+$" if side == "l" else rf"^[^{BLANK}]*+"
    return F.filter(F.split(F.lower(F.regexp_replace(side, touching, "")), rf"[{BLANK}]+"), lambda x: x != "")


def _shape(m: Column) -> Column:
    """Character classes of an instance: runs of letters as a, of digits as their number, signs as they are; no others at its ends."""
    inner = F.regexp_replace(F.regexp_replace(m, r"^[^\p{L}\p{N}]++", ""), r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    return F.regexp_replace(F.regexp_replace(inner, r"\p{L}++", "a"), "[0-9]", "9")


def _contexts() -> Column:
    """Lexical patterns of an instance: the word before it, the word after it, both, two words on one side, and the shape of
    the instance with the word on either side. Long words make long patterns, which are known by their SHA-256."""
    left, right, shape = F.reverse(_words("l")), _words("r"), _shape(F.col("m"))
    l1, l2, r1, r2 = (F.try_element_at(side, F.lit(k)) for side in (left, right) for k in (1, 2))
    named = {"L": [l1], "R": [r1], "B": [l1, r1], "LL": [l2, l1], "RR": [r1, r2], "LS": [l1, shape], "RS": [r1, shape]}
    every = [F.concat(F.lit(k), *(x for w in words for x in (F.lit(" "), w))) for k, words in named.items()]
    return F.transform(F.array_compact(F.array(*every)), lambda p: F.unhex(F.sha2(p, 256)))


def discover(instances: DataFrame, support: int = 3, sure: float = 0.9) -> DataFrame:
    """instances(core, k, m, l, r), k the kind of a seed or null, to (core, k): instances without a kind that are of kind k.

    The graph has an edge where an instance stands in a lexical pattern. Each round scores a pattern for a kind
    by the share of its distinct instances that are of that kind (by their scores), if at least `support` of them are; and an
    instance that is no seed by how sure its patterns make it together, patterns of a share below one half left out. Scores only rise; rounds
    go on until none does by a thousandth. Scores of `sure` or more are discoveries. All sums are partially aggregated over
    written tables, so that a frequent pattern is a skewed join that Spark can split.
    """
    edges = cut(instances.select("core", "k", F.explode(_contexts()).alias("p")).groupBy("p", "core").agg(F.min("k").alias("k")))
    seeds = cut(instances.where(F.col("k").isNotNull()).groupBy("core").agg(F.min("k").alias("k")))
    sizes = cut(edges.groupBy("p").agg(F.count("*").alias("n")))
    scores = cut(seeds.withColumn("score", F.lit(1.0)))
    was = None
    while True:
        of = edges.select("p", "core").join(scores, "core").groupBy("p", "k").agg(F.sum("score").alias("of")).where(F.col("of") >= support - 1e-6)
        patterns = cut(of.join(sizes, "p").select("p", F.col("k").alias("kind"), (F.col("of") / F.col("n")).alias("share")).where("share >= 0.5"))
        new = edges.where(F.col("k").isNull()).join(patterns, "p").groupBy("core", F.col("kind").alias("k")).agg(F.round(1 - F.exp(F.sum(F.log1p(-0.99 * F.col("share")))), 3).alias("score"))
        now = cut(new.join(seeds.select("core"), "core", "left_anti").unionByName(seeds.withColumn("score", F.lit(1.0))))
        forget(scores, patterns)
        scores = now
        is_now = scores.agg(F.count("*"), F.sum(F.xxhash64("core", "k", "score").cast("decimal(38,0)"))).first()
        if is_now == was:
            break
        was = is_now
    forget(edges, sizes)
    best = scores.join(seeds.select("core"), "core", "left_anti").where(F.col("score") >= sure)
    return cut(best.groupBy("core").agg(F.min_by("k", F.struct(-F.col("score"), "k")).alias("k")))


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (long; identifiers of known form), base_sha256 (of
    those, as kind:start:end in order, comma-joined) and spans (those and the discovered ones, likewise). Places are code
    points of the whole text, ends exclusive.

    Known forms are the leftmost matches of each kind that don't overlap, less those that fail the kind's test: seeds. Words with a digit or a
    sign between letters, and rows of words of digits (CANDIDATE), are candidates unless they overlap a seed, and discover() finds those that stand
    in the seeds' contexts, REACH words to either side. A candidate of letters alone is none: no kind has such a form. A null
    text counts as empty. Rows equal in doc_id and text get equal results; other columns are left out. The
    text is read once and never shuffled; what moves are identifiers and candidates with the words about them, whole. Candidates are told apart by
    a SHA-256 of what is between their outer signs, lower-cased; those of one text lie in one row.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("row"), *(_places(F.col("text"), PATTERNS[k]).alias(k) for k in KINDS), _places(F.col("text"), CANDIDATE).alias("candidates"))
    kept = [_kept(i, k) for i, k in enumerate(KINDS)]
    found = cut(rows.select("doc_id", "row", F.flatten(F.array(*kept)).alias("base"), "candidates"))
    core = F.unhex(F.sha2(F.lower(F.regexp_replace(F.regexp_replace("m", r"^[^\p{L}\p{N}]++", ""), r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")), 256)).alias("core")
    one = found.dropDuplicates(["doc_id", "row"])
    both = one.select("doc_id", "row", F.explode(F.concat(F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["m"].alias("m"), x["l"].alias("l"), x["r"].alias("r"))), F.transform("candidates", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(None).cast("int").alias("k"), x["m"].alias("m"), x["l"].alias("l"), x["r"].alias("r"))))).alias("x")).select("doc_id", "row", "x.*")
    order = Window.partitionBy("doc_id", "row").orderBy("s", F.col("k").isNull())
    seed = F.col("k").isNotNull()
    ended = F.max(F.when(seed, F.col("e"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    begins = F.min(F.when(seed, F.col("s"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    free = seed | (F.coalesce(ended <= F.col("s"), F.lit(True)) & F.coalesce(begins >= F.col("e"), F.lit(True)))
    instances = cut(both.withColumn("free", free).where("free").select("doc_id", "row", "s", "e", "k", core, "m", "l", "r"))
    new = instances.where(F.col("k").isNull()).drop("k").join(discover(instances), "core")
    new = new.groupBy("doc_id", "row").agg(F.collect_set(F.struct("s", "k", "e")).alias("new")).select(F.col("doc_id").alias("of"), F.col("row").alias("of_row"), "new")
    joined = found.join(new, (found.row == new.of_row) & found.doc_id.eqNullSafe(new.of), "left")
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    every = F.concat(base, F.coalesce("new", F.array().cast("array<struct<s:int,k:int,e:int>>")))
    return joined.select("doc_id", *(_count(i, k) for i, k in enumerate(KINDS)), F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(every).alias("spans"))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return find_pii(table(spark, sf_dir, "documents"))
