"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, licences, media, minhash, mixing, packing, quality, quantizer, records, sharding, suffixes, toxicity, warc
from .common import documents


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_duplicates": lambda spark, sf_dir: minhash.digest(documents(spark, sf_dir)),
        "op2_best_fit_packing": lambda spark, sf_dir: packing.digest(documents(spark, sf_dir)),
        "op3_quality_outliers": lambda spark, sf_dir: quality.digest(documents(spark, sf_dir)),
        "op4_repeated_substrings": lambda spark, sf_dir: suffixes.digest(documents(spark, sf_dir)),
        "op5_license_notices": lambda spark, sf_dir: licences.digest(documents(spark, sf_dir)),
        "op6_toxicity_trees": lambda spark, sf_dir: toxicity.digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
        "op7_hash_tree_shards": lambda spark, sf_dir: sharding.digest(documents(spark, sf_dir)),
        "op8_mpeg_audio": lambda spark, sf_dir: media.digest(documents(spark, sf_dir)),
        "op9_systematic_mix": lambda spark, sf_dir: mixing.digest(documents(spark, sf_dir)),
        "op10_binary_records": lambda spark, sf_dir: records.digest(documents(spark, sf_dir)),
        "op11_warc_archives": lambda spark, sf_dir: warc.digest(spark.read.parquet(f"{sf_dir}/pages.parquet")),
        "op12_vector_codes": lambda spark, sf_dir: quantizer.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
        "op13_token_alignment": lambda spark, sf_dir: alignment.digest(documents(spark, sf_dir)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_hash_tree_shards": sharding.SQL,
        "op9_systematic_mix": mixing.SQL,
        "op11_warc_archives": warc.SQL,
        "op12_vector_codes": quantizer.SQL,
    }
