"""The queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import exact_dedup, html_wrapper, line_dedup, near_dedup, packing, quality, secret_scan, sentencepiece_viterbi, sharding, url_filter
from quillspan.llm.common import table

Plan = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.UrlModel(url_filter.seed_urls(spark))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), model)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), words=4)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encode_and_check(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=40)


QUERIES: dict[str, Plan] = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_quality_rules,
        op3_html_extraction,
        op4_best_fit_packing,
        op5_minhash_near_dedup,
        op6_secret_scan,
        op7_sentencepiece,
        op8_line_dedup,
        op9_exact_dedup,
        op10_sharding,
    )
}
ORACLES: dict[str, str] = {"op6_secret_scan": secret_scan.SQL, "op8_line_dedup": line_dedup.SQL, "op9_exact_dedup": exact_dedup.SQL}
