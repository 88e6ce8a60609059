"""A corpus pipeline: what each stage keeps is the next one's input.

Language ID drops documents without a language or in another than their label says, line dedup cuts repeated runs of lines, SimHash keeps one document of
each near-duplicate group, mixing drops or repeats documents until sources have their target weights, and the rest is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, lines, mixing, simhash
from tessera.llm.common import cut, forget, table

#: Columns that the stages work with; all others are carried along under names that can't clash with an operator's.
_OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _safe(docs: DataFrame) -> DataFrame:
    return docs.toDF(*(c if c in _OWN else f"__kept_{i}" for i, c in enumerate(docs.columns)))


def _back(docs: DataFrame, like: DataFrame) -> DataFrame:
    return docs.select(*(c if c in _OWN else f"__kept_{i}" for i, c in enumerate(like.columns))).toDF(*like.columns)


#: How sure a prediction must be (as langid.identify scores it), and how many characters long the text, to overrule a document's own label.
SURE, LONG = 0.25, 200


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that their label doesn't belie. Those go whose text has none (`und`: no text, or no letter in it), and those
    labelled with a learned language whose text, not too short to tell (LONG), is surely (SURE) in another one. A null or unknown label is no contradiction."""
    languages = langid.learn(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    found = langid.identify(_safe(docs), languages)
    known = F.col("lang").isin(languages.names) if languages.names else F.lit(False)
    wrong = F.coalesce(known & (F.col("lang") != F.col("lang_pred")) & (F.col("score") >= SURE) & (F.char_length("text") >= LONG), F.lit(False))
    return _back(found.where((F.col("lang_pred") != "und") & ~wrong), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later repeated runs; a document of which no line is left goes."""
    out = lines.dedup_lines(_safe(docs))
    return _back(out.where("n_removed < n_lines OR n_removed = 0"), docs)


def _rows(docs: DataFrame) -> DataFrame:
    """docs with __row and __more: two hashes of all columns, by which rows are known that are equal in each of them only. No text is
    written for it, and no id is needed."""
    return docs.withColumns({"__row": F.xxhash64(*docs.columns), "__more": F.xxhash64(F.lit("more"), *docs.columns)})


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that with the smallest doc_id, nulls last, and of several the first by the hashes of
    text and row. Null and repeated ids are rows like any other; of wholly equal rows one stays."""
    rows = _rows(_safe(docs))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", F.xxhash64("text").alias("of"), "__row", "__more")
    prints = cut(simhash.with_simhash(rows.select(order.alias("doc_id"), "text"), into="x").select("doc_id", "x"))
    kept = simhash.near_groups(prints).select("component_id.__row", "component_id.__more").distinct()
    return _back(rows.dropDuplicates(["__row", "__more"]).join(kept, ["__row", "__more"], "left_semi"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies of it: wholly equal rows get the copies of all of them together."""
    rows = _rows(_safe(docs))
    thin = cut(rows.select("doc_id", "source", "__row", "__more", mixing.n_words(F.col("text")).alias("size")))
    copies = mixing.mix(thin, keep=("__row", "__more")).where("copies > 0").groupBy("__row", "__more").agg(F.sum("copies").cast("int").alias("__copies"))
    taken = rows.dropDuplicates(["__row", "__more"]).join(cut(copies), ["__row", "__more"])
    return _back(taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the token ids of each document, with the digests of ids and of the text that they decode to."""
    import public_tokenizers

    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return bpe.bpe_encode(docs.select("doc_id", "lang", "source", "text"), codec, digest=True, ids=True).drop("text")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Stages that iterate or hash have no SQL; tests/llm hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    was = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
            if was is not None:
                forget(was)  # a stage's input isn't read again once its output is written
            was = docs
    return docs
