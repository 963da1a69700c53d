"""The registered queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import oracles
from .common import table


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import removals

    return removals(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import encode_documents, load_model

    return encode_documents(table(spark, sf_dir, "documents"), load_model(public_tokenizers.path("piece_bpe_32k.model")), digest=True)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .shards import load_vocabulary, training_order

    return training_order(table(spark, sf_dir, "documents"), load_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge_urls

    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align, load_json
    from .pieces import load_model

    return align(table(spark, sf_dir, "documents"), load_json(public_tokenizers.path("byte_bpe_50k.json")), load_model(public_tokenizers.path("piece_bpe_32k.model")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codebooks import compress

    return compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    return report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_nearest_neighbours, op2_simhash_near_dedup, op3_suffix_array_dedup, op4_sentencepiece, op5_source_mixing, op6_training_order, op7_quality_rules, op8_licence_scan, op9_html_extraction, op10_url_filters, op11_tokenizer_alignment, op12_vector_codes, op13_personal_data)
}

ORACLES: dict[str, str] = {"op7_quality_rules": oracles.OP7, "op10_url_filters": oracles.OP10, "op12_vector_codes": oracles.OP12}
