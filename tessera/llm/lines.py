"""Line dedup: winnowed line hashes find runs of lines that were there before; later ones go. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Lines of the shortest run that counts as repeated, and of a winnowing window.
WINDOW = 2


def repeated_runs(docs: DataFrame, window: int = WINDOW, line_hash=F.xxhash64) -> DataFrame:
    """docs(doc_id, row, text), row a hash of the text, to (doc_id, row, begin, end, first_id, first_row, first_begin): each maximal run of
    lines (places counted from 0, end exclusive) that also stands at an earlier place, and that place.

    Winnowing: of each `window` neighbouring line hashes the smallest is a fingerprint, the rightmost if several are, so
    equal runs of `window` lines have an equal fingerprint at the same place. Fingerprints that occur once are
    dropped before anything is joined. The others bring the windows that they stand for, known by a SHA-256 of
    the lines themselves: line hashes only choose and drop fingerprints, and what collides there changes nothing. The first place
    of each such window is a partially aggregated minimum; later places are joined with it, position with position,
    and a match goes on both ways as long as its neighbours match the same document's neighbours: maximal runs on one
    diagonal. No two later places are ever paired with each other.
    """
    split = docs.select("doc_id", "row", F.split("text", "\n").alias("lines"))
    hashes = split.where(F.size("lines") >= window).withColumn("h", F.transform("lines", lambda x: line_hash(x)))
    starts = F.sequence(F.lit(0), F.size("h") - window)

    def place(i):
        """Where the window at i has its smallest hash, the rightmost."""
        back = F.reverse(F.slice("h", i + 1, window))
        return i + window - F.array_position(back, F.array_min(back)).cast("int")

    text = lambda i: F.sha2(F.array_join(F.slice("lines", i + 1, window), "\n"), 256)
    windows = F.transform(starts, lambda i: F.struct(i.alias("i"), F.element_at("h", place(i) + 1).alias("print"), F.unhex(text(i)).alias("k")))
    # windows of one fingerprint place together: one row for each place
    prints = hashes.select("doc_id", "row", F.explode(windows).alias("w")).select("doc_id", "row", "w.*")
    # written tables: a join with the aggregate itself would be dealt as that is, and its hot keys could not be split
    picked = hashes.select(F.explode(F.transform(F.array_distinct(F.transform(starts, place)), lambda p: F.element_at("h", p + 1))).alias("print"))
    often = cut(picked.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"))
    runs = cut(prints.join(often, "print").select("doc_id", "row", "i", "k"))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"), F.col("i").alias("i"))
    first = cut(runs.groupBy("k").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("k", "first"))
    later = runs.join(first, "k").where(order > F.col("first")).select("doc_id", "row", "i", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row"), F.col("first.i").alias("first_i"))
    diagonal = Window.partitionBy("doc_id", "row", "first_id", "first_row", F.col("i") - F.col("first_i")).orderBy("i")
    new = F.when(F.col("i") - F.lag("i").over(diagonal) == 1, 0).otherwise(1)
    islands = later.withColumn("new", new).withColumn("run", F.sum("new").over(diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    of = islands.groupBy("doc_id", "row", "first_id", "first_row", (F.col("i") - F.col("first_i")).alias("shift"), "run")
    out = of.agg(F.min("i").alias("begin"), (F.max("i") + window).alias("end"))
    return out.select("doc_id", "row", "begin", "end", "first_id", "first_row", (F.col("begin") - F.col("shift")).alias("first_begin"))


def repeated_lines(docs: DataFrame, window: int = WINDOW, line_hash=F.xxhash64) -> DataFrame:
    """docs(doc_id, row, text) to (doc_id, row, lines): the places, counted from 0 and sorted, of lines in a run that was there before.
    Only documents with such lines are returned."""
    runs = repeated_runs(docs, window, line_hash).groupBy("doc_id", "row").agg(F.collect_set(F.struct("begin", "end")).alias("runs"))
    every = F.flatten(F.transform("runs", lambda r: F.sequence(r["begin"], r["end"] - 1)))
    return runs.select("doc_id", "row", F.array_sort(F.array_distinct(every)).alias("lines"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text less the lines of later repeated runs, and n_lines, n_removed long.

    Lines are what line feeds separate, compared as they are (by SHA-256). A run has `window` lines at least: a line that
    repeats between different neighbours stays, however long it is, and so does a text of one line. Every run of `window` lines or more that also stands at an
    earlier place (by doc_id, nulls last, then place; the same document counts) goes wherever it is not the first; runs may overlap, and
    are judged on the input. Rows equal in doc_id and text are one document here and keep the same lines; documents
    with a null doc_id and different texts go by a hash of the text. A null text stays null with no lines; an empty text
    is one empty line. All rows and other columns stay, n_chars (code points) is renewed where it exists, and new columns
    replace those of the same names. Long texts are handled as arrays of line hashes; one join brings the
    places to the texts.
    """
    rows = docs.drop("n_lines", "n_removed").withColumn("__row", F.xxhash64(text))
    found = repeated_lines(rows.select(F.col(doc_id).alias("doc_id"), F.col("__row").alias("row"), F.col(text).alias("text")), window)
    found = found.select(F.col("doc_id").alias("__doc"), F.col("row").alias("__of"), F.col("lines").alias("__gone"))
    joined = rows.join(found, rows["__row"].eqNullSafe(F.col("__of")) & rows[doc_id].eqNullSafe(F.col("__doc")), "left")
    lines = F.split(text, "\n")
    # kept stretches lie between removed lines
    bounds = F.concat(F.array(F.lit(-1)), F.col("__gone"), F.array(F.size(lines)))
    gaps = F.zip_with(F.slice(bounds, 1, F.size("__gone") + 1), F.slice(bounds, 2, F.size("__gone") + 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(F.col("__lines"), g["a"] + 2, g["b"] - g["a"] - 1)))
    out = joined.withColumn("__lines", lines).withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    out = out.withColumns({"n_lines": count("__lines"), "n_removed": count("__gone")})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.char_length(text).cast("long")))
    return out.select(*(F.col(f"`{c}`") for c in docs.drop("n_lines", "n_removed").columns), "n_lines", "n_removed")


OP3_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, lines[i] AS a, lines[i + 1] AS b FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines) - 1)) AS i FROM l)),
f AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, i) AS k FROM w),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM f, (VALUES (0), (1)) v(o) WHERE k > 1),
u AS (SELECT doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS i FROM l),
k AS (SELECT u.doc_id, string_agg(line, chr(10) ORDER BY i) AS kept, count(*) AS n FROM u ANTI JOIN gone g ON u.doc_id = g.doc_id AND u.i = g.i GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(len(l.lines), 0)::BIGINT AS n_lines, (coalesce(len(l.lines), 0) - coalesce(k.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
