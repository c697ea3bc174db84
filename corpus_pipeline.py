"""A corpus pipeline: filter by quality, drop near copies, cut repeated passages, drop benchmark leaks, encode.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), works on all of docs, and returns a
DataFrame with the columns of documents, which is written as Parquet and read again as the next one's docs. The
last stage returns the encoded documents. Each stage calls one operator with its production parameters.

Nulls, repeated rows and odd texts: see the operators. A null text counts as empty; after the third stage it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verity.llm import decontamination, near_copies, quality, sentencepiece_rounds, suffix_dedup
from verity.llm.common import remove, shared_dir, table


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (trained on the labels of docs) rejects go."""
    return quality.keep_good(docs, quality.learn_default(spark, docs, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (named by SimHash and its tries, then a five-word Jaccard of 0.8 or more) the document
    with the smallest id stays."""
    return near_copies.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that start in an earlier document are cut out; the first copy stays."""
    return suffix_dedup.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or a whole shorter item) go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    import public_tokenizers

    return sentencepiece_rounds.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", filter_quality),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("leaks", drop_leaks),
    ("encode", encode),
]

#: SQL cannot train a classifier, hash with XXH64 or encode; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is kept in the shared checkpoint folder until the next one has
    read it (the last of them until the caller has read the result)."""
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
