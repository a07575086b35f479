"""A corpus pipeline: quality rules, language, near-duplicates, mix and encoding, each over all that the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.bpe import bpe_decode, bpe_encode
from fieldloom.llm.language import language_filter
from fieldloom.llm.mixing import mix_rows
from fieldloom.llm.quality import quality_filter
from fieldloom.llm.simhash import similarity_dedup

#: Two of the stages (a trained classifier, XXH64 fingerprints) have no form in SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and the fences of their language and source.

    Each row by itself, whatever its id; null texts go, as they have fewer than 50 words. Columns as they are, in an empty table too.
    """
    return quality_filter(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network, trained on these documents' labels, recognises.

    Each row by itself, whatever its id; null and letterless texts go. Where there is no row to learn from, all others stay. Columns as
    they are.
    """
    return language_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, null ids last, then by a hash of the text.

    Linked are texts that share 0.8 of their five-word shingles, checked on whole texts. Rows with neither id nor text stay. Columns as
    they are.
    """
    return similarity_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents as often as they are taken, the last one of a source up to its budget.

    A null source is a source; null and wordless texts are never taken. Rows with equal ids are cut one by one. Columns as they are.
    """
    return mix_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's token ids and the digests of ids and decoded text, as ``op1_bpe`` has them.

    Returns doc_id, lang and source beside these, and leaves other columns out. Null texts are empty; each row keeps its own row.
    """
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = docs.select("doc_id", "lang", "source", bpe_encode(spark, F.col("text"), path).alias("ids"))
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(bpe_decode(spark, F.col("ids"), path), 256).alias("decoded_sha256"),
    )


STAGES = [("quality rules", quality), ("language ID", language), ("SimHash near-dedup", near_duplicates), ("mixing sources", mix), ("BPE encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
