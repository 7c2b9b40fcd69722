"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles

#: Where the public tokenizer files are; a parameter of every operator that needs one.
VOCABULARY = "byte_bpe_50k"
PIECES = "piece_bpe_32k.model"


def _path(suffix: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY + suffix)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import groups

    return groups(_documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_documents(spark, sf_dir), _path(".json"), limit=1024)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_documents(spark, sf_dir), _path(".json"), capacity=2048)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(_documents(spark, sf_dir))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import score_held_out

    return score_held_out(_documents(spark, sf_dir))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import edited_pairs

    return edited_pairs(_documents(spark, sf_dir))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(_documents(spark, sf_dir), length=400)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest

    return digest(_documents(spark, sf_dir))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(_documents(spark, sf_dir), _path(".tiktoken"), public_tokenizers.PATTERN)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_alignment import align

    return align(_documents(spark, sf_dir), _path(".json"), public_tokenizers.path(PIECES))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import groups

    return groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_media_columns": op5_media_columns,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_order_minhash": op7_order_minhash,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_secret_scans": op9_secret_scans,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_filter_audit": op11_filter_audit,
    "op12_token_alignment": op12_token_alignment,
    "op13_vector_dedup": op13_vector_dedup,
}

#: DuckDB SQL for the queries that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op2_simhash_near_dedup": oracles.OP2,
    "op7_order_minhash": oracles.OP7,
    "op8_suffix_array_dedup": oracles.OP8,
    "op11_filter_audit": oracles.OP11,
    "op13_vector_dedup": oracles.OP13,
}
