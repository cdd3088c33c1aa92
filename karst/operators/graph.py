"""Bounded walks over edges (src, dst, rel_type)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karst.sources.shared import new_folder, put


def neighbours(edges: DataFrame, root: str, limit: int = 100) -> DataFrame:
    return edges.filter(F.col("src") == root).select("rel_type", "dst").orderBy("rel_type", "dst").limit(limit)


def walk(edges: DataFrame, roots: Sequence[str] | DataFrame, depth: int = 3, rel_types: Sequence[str] = (), fan_out: int = 200, limit: int = 600) -> DataFrame:
    """root, depth, src, rel_type, dst of the edges on paths from the roots that visit no node twice; of each root the first
    `limit` in this order. roots: names, or a table with a column root, as many as it has; null ones are left out.

    A path goes on along at most `fan_out` edges of a node, in order of rel_type and dst, counted after edges to visited
    nodes are dropped. Each hop is one join on src, whose paths are written, so that it is evaluated once and the next one
    is planned by its size; the paths of a hop are at most fan_out times those of the last.
    """
    if not 1 <= depth <= 3:
        raise ValueError("depth is 1 to 3")
    kept = edges.filter(F.col("rel_type").isin(list(rel_types))) if rel_types else edges
    kept = kept.select("src", "rel_type", "dst")
    spark = edges.sparkSession
    named = roots.select(F.col("root").cast("string")) if isinstance(roots, DataFrame) else spark.createDataFrame([(r,) for r in roots], "root string")
    front = named.filter("root IS NOT NULL").distinct().select("root", F.col("root").alias("at"), F.array("root").alias("path"))
    folder, found = new_folder(spark, "walk"), None
    for hop in range(1, depth + 1):
        step = front.join(kept, F.col("at") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        place = F.row_number().over(W.partitionBy("root", "path").orderBy("rel_type", "dst"))
        step = put(step.withColumn("__n", place).filter(F.col("__n") <= fan_out).drop("__n", "at"), f"{folder}/{hop}")
        rows = step.select("root", F.lit(hop).alias("depth"), "src", "rel_type", "dst")
        found = rows if found is None else found.unionByName(rows)
        front = step.select("root", F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"))
    order = ["depth", "src", "rel_type", "dst"]
    first = F.row_number().over(W.partitionBy("root").orderBy(*order))
    return found.distinct().withColumn("__n", first).filter(F.col("__n") <= limit).drop("__n").orderBy("root", *order)


def pruned(edges: DataFrame, document: str, allowed: DataFrame) -> DataFrame:
    """Edges without a document, and those whose document is allowed."""
    may = allowed.select(F.col("document_id").alias("__may")).distinct()
    return edges.join(may, F.col(document) == F.col("__may"), "left").filter(F.col(document).isNull() | F.col("__may").isNotNull()).drop("__may")
