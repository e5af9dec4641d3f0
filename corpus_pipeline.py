"""A corpus from raw documents to packed training sequences.

Each stage takes what its predecessor kept and calls one operator of tidemark.llm; run() writes
every stage as Parquet in the shared folder and reads it back, so a lost executor costs at most a
stage.  All stages but the last return the columns of documents, with n_chars kept true to text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import linededup, neardup, packing, pii, toxicity
from tidemark.llm.common import Scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """operator's rows with the columns of docs; their names are out of its way meanwhile, so none can clash."""
    plain = {c: c if c in ("doc_id", "text") else f"column_{n}" for n, c in enumerate(docs.columns)}
    out = operator(docs.select(*(F.col(f"`{c}`").alias(p) for c, p in plain.items())))
    return out.select(*(F.col(p).alias(c) for c, p in plain.items()))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays under the threshold; the model learns from the labelled ones among them.

    Null and empty texts are not toxic and stay; rows that repeat are judged alike.
    """
    model = toxicity.fitted(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return _apart(docs, lambda own: toxicity.score(own, model).where(F.col("score") < toxicity.THRESHOLD))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those of which no word is left go.  Null texts stay."""

    def keep(own: DataFrame) -> DataFrame:
        bare = (F.size("removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
        return linededup.delete_lines(own).where(~F.coalesce(bare, F.lit(False)))

    return _counted(_apart(docs, keep))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates (five-word shingles, similarity 0.8 or more): the smallest doc_id.

    Of rows that repeat doc_id and text one stays.  Rows without an id cannot be told apart and all stay.
    """
    kept = neardup.near_duplicates(docs.select("doc_id", "text").where("doc_id is not null")).where("kept").select("doc_id").distinct()

    def one(own: DataFrame) -> DataFrame:
        found = own.join(kept.hint("merge"), "doc_id", "left_semi").withColumn("digest", F.xxhash64("text"))
        return found.dropDuplicates(["doc_id", "digest"]).drop("digest").unionByName(own.where("doc_id is null"))

    return _apart(docs, one)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and the terms that disclose it masked; no row goes, null texts stay null."""
    return _counted(_apart(docs, pii.sanitise))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens; a null text is its end token alone."""
    out = packing.pack_documents(docs)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: Tokenizers, kernels and signatures are beyond SQL: the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents.  An empty table gives an empty result; stages that are used up are deleted."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.save(name, stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = name
    return docs
