"""The registered queries of this package: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cluster import ship
from .oracles import ORACLES as ORACLES

def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_components

    found = near_components(_documents(spark, sf_dir))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed_words

    return mixed_words(_documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify, train

    docs = _documents(spark, sf_dir)
    model = train(docs.where(~held_out()))
    found = identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    found = exact_groups(_documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive, read_archives

    found = read_archives(archive(_pages(spark, sf_dir)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_base_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that SQL can say."""
    return op7_quality_rules(spark, sf_dir).drop("kept")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(_documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan

    return scan(_documents(spark, sf_dir)).select("doc_id", "n_candidates", "n_confirmed", F.array_join("families", ",").alias("families"), "licence", "confidence")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash_near_dedup, op2_mixing, op3_language_id, op4_exact_dedup, op5_warc, op6_token_counts, op7_quality_rules, op8_suffix_dedup, op9_packing, op10_licence_scan, quality_base_statistics)
}
