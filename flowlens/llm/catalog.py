"""Registered queries of this package: name -> (query, checking SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, fingerprints, html, jaccard, licences, mixing, quality, runs, sharding, topk, tries, urls
from .common import ready, table

#: The tokenizer of the registered query.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return quality.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.query(table(ready(spark), sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(ready(spark), sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(table(ready(spark), sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(ready(spark), sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(ready(spark), sf_dir, "documents"), tokenizer_path())


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(ready(spark), sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(ready(spark), sf_dir, "pages"))


def op9_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.query(table(ready(spark), sf_dir, "embeddings"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.query(table(ready(spark), sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.query(table(ready(spark), sf_dir, "conversations"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.query(table(ready(spark), sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.query(table(ready(spark), sf_dir, "documents"))


QUERIES = (
    op1_quality_classifier,
    op2_topk_search,
    op3_url_filter,
    op4_mixing,
    op5_sharding,
    op6_bpe,
    op7_licence_scan,
    op8_html_extraction,
    op9_ann_search,
    op10_jaccard_join,
    op11_prefix_trie,
    op12_fingerprints,
    op13_periodic_runs,
)
SQL = {"op2_topk_search": topk.SQL, "op4_mixing": mixing.SQL, "op7_licence_scan": licences.SQL, "op11_prefix_trie": tries.SQL, "op12_fingerprints": fingerprints.SQL}


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
