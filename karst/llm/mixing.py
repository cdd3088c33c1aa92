"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words; its documents' expected copies are target / size of the source. The
documents of a source stand in order of size (then of a hash of doc_id and text), their expected copies are summed up
along it, one random offset is added, and a document is taken once for each integer that its step crosses. As
the order is by size, the words taken differ from the target by about one document at most.

Sums along a source never gather it in one task: documents are counted by size and by block of the hash, and only
those counts are summed up.

Null text has size 0. Null sources are a source of their own, the last in order. Rows with equal doc_id and size
are drawn each for itself. A source without words has target 0. An empty table gives an empty result. Extra
columns are kept by mix() and otherwise ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch, buckets, gapless

#: By position of the source in code point order, repeating.
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, rate from a table with one row for each source (source, source_size).

    Water-filling: sources are ranked by cap / weight, and the level is the first at which the next source's
    cap isn't below its share. Windows without a key see one row for each source here.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size").cast("double"))
    rank = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    s = (
        s.withColumn("at", F.row_number().over(rank))
        .withColumn("caps", F.coalesce(F.sum("cap").over(rank.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("w").over(rank.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("all", F.sum("source_size").over(everything) * share)
    )
    level = (F.col("all") - F.col("caps")) / F.col("rest")
    s = s.withColumn("open", F.when(F.col("cap") / F.col("w") >= level, F.struct("at", level.alias("level"))))
    s = s.withColumn("level", F.min("open").over(everything)["level"])
    target = F.least("cap", F.coalesce(F.col("w") * F.col("level"), F.col("cap")))
    return s.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def copies(rows: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """Adds source_size, target and copies to rows with doc_id, source, size, digest; rows must be the same on every read."""
    n = buckets(rows.sparkSession)
    source = rows.select("doc_id", "source", "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    target = targets(source, weights, share, most).select(F.col("source").alias("__source"), "source_size", "target", "rate")
    counts = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("__n"))
    smaller = F.sum("__n").over(W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1))  # a row for each size
    before = counts.select(F.col("source").alias("__of"), F.col("size").alias("__size"), F.coalesce(smaller, F.lit(0)).alias("__smaller"))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("digest")))
    block = F.floor(F.conv(F.substring("__draw", 1, 6), 16, 10).cast("long") * F.lit(n) / F.lit(1 << 24)).cast("int")
    ranked = gapless(rows.withColumn("__draw", draw), ["source", "size"], [F.col("__draw"), F.col("doc_id")], block, "__rank")
    ranked = ranked.join(before, F.col("source").eqNullSafe(F.col("__of")) & F.col("size").eqNullSafe(F.col("__size")))
    ranked = ranked.join(target, F.col("source").eqNullSafe(F.col("__source")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("source"), F.lit("")))), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))
    k = F.col("__rank") + F.col("__smaller")
    taken = F.floor(offset + F.col("rate") * (k + 1)) - F.floor(offset + F.col("rate") * k)
    return ranked.withColumn("copies", F.least(taken, F.ceil("rate"))).drop("__rank", "__smaller", "__draw", "__of", "__size", "__source", "rate")


def sized(docs: DataFrame) -> DataFrame:
    """Adds size (words) and digest (of the text), and drops the text."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumn("size", size).withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).drop("text")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    scratch = Scratch(docs.sparkSession, "mixing")
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}_") for i, c in enumerate(names)], F.col("text").cast("string").alias("text"), F.col("doc_id"), F.col("source").cast("string").alias("source"))
    kept = scratch.write(sized(inner).withColumn("uid", F.monotonically_increasing_id()), "rows")
    # ranks and draws move narrow rows; the documents' own columns are moved once, to meet their copies
    drawn = copies(kept.select("uid", "doc_id", "source", "size", "digest"), **options).filter("copies > 0").select(F.col("uid").alias("at"), F.col("copies").cast("int").alias("copies"))
    emitted = kept.join(drawn, F.col("uid") == F.col("at")).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return emitted.select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(names)])


def digest(docs: DataFrame, **options) -> DataFrame:
    """What op9 returns: each document's size, its source's size and target, and the words that the mix takes of it."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.write(sized(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))), "rows")
    return copies(rows, **options).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


#: The same draw in DuckDB's SQL.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s
), r AS (
  SELECT *, row_number() OVER o AS pos,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS caps,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)
), l AS (
  SELECT arg_min((total - caps) / rest, pos) AS level FROM r WHERE cap / w >= (total - caps) / rest
), t AS (
  SELECT source, source_size, least(cap, coalesce(w * level, cap)) AS target FROM r, l
), k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.source,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5('7:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.digest), d.doc_id NULLS FIRST) - 1 AS k,
    ('0x' || substr(md5('7/' || coalesce(d.source, '')), 1, 5))::BIGINT::DOUBLE / 1048576.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (least(floor(u + rate * (k + 1)) - floor(u + rate * k), ceil(rate)) * size)::BIGINT AS taken FROM k
"""
