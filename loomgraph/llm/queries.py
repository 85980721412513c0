"""The queries of this package and their SQL twins, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import language_id, lexical, license_scan, line_dedup, mixing, near_dedup, nearest, packing, prefix_trie, quality_rules, suffix_dedup, toxicity, url_filter
from loomgraph.llm.common import table


#: Name of the vocabulary file of the packing query.
VOCABULARY = "word_bpe_49k.json"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.neighbours(table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = url_filter.labels_by_page(table(spark, sf_dir, "labels"))
    return url_filter.judge(table(spark, sf_dir, "pages"), labels)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_mixing, op2_near_dedup, op3_license_scan, op4_suffix_dedup, op5_quality_rules, op6_nearest, op7_line_dedup, op8_url_filter, op9_packing, op10_language_id, op11_toxicity, op12_lexical_search, op13_prefix_trie]
    return {f.__name__: f for f in found}


def oracles() -> dict[str, str]:
    return {"op3_license_scan": license_scan.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op8_url_filter": url_filter.ORACLE, "op12_lexical_search": lexical.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
