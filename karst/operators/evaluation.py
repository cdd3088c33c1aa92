"""Retrieval metrics over ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles


def recall_at(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query, recall: the share of a query's relevant items among its first k results. Both have query and item."""
    hits = results.filter(F.col("rank") <= k).join(relevant, ["query", "item"], "left_semi").groupBy("query").agg(F.count(F.lit(1)).alias("hits"))
    n = relevant.groupBy("query").agg(F.count_distinct("item").alias("n"))
    return n.join(hits, "query", "left").select("query", F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("recall"))


def reciprocal_rank(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """query, rr: one over the rank of the first relevant result, 0 without one."""
    first = results.join(relevant, ["query", "item"], "left_semi").groupBy("query").agg(F.min("rank").alias("first"))
    return relevant.select("query").distinct().join(first, "query", "left").select("query", F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"))


def nearest_rank(rows: DataFrame, value: str, share: float, by: list[str]) -> DataFrame:
    """The nearest-rank quantile: a value that occurs."""
    return quantiles(rows, value, [share], by, nearest=True).withColumnRenamed("q0", "quantile")


def verdicts(graded: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each verdict."""
    kinds = ("FACT", "LOW_CONFIDENCE", "CONFLICT", "UNKNOWN")
    return graded.groupBy(*by).agg(*[F.count_if(F.col("verdict") == k).alias(k.lower()) for k in kinds])
