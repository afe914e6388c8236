"""From raw documents to tokens: four stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import bpe, jaccard, mixing, quality
from flowlens.llm.catalog import tokenizer_path
from flowlens.llm.common import ready, stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (operator 1)."""
    ready(spark)
    return quality.stage(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five words and a similarity of 0.8 (operator 10)."""
    ready(spark)
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix of their sources: repeated for each epoch, gone where the budget ends before them (operator 4)."""
    ready(spark)
    return mixing.stage(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts (operator 6)."""
    ready(spark)
    # The workers also hold what the stages before left them: fewer words are remembered than in a job of its own.
    return bpe.encode(docs, tokenizer_path(), remembered=100_000)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", tokens),
]

#: A fitted model is not SQL; tests hold run() against brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
