"""Permission, compression, grading of claims and reconciliation with live values."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karst.functions.scores import AUTHORITIES, FACT, HORIZONS, agreement, confidence, freshness
from karst.functions.text import first_words, normal_value, token_count

from .folds import folded

KNOWN_SOURCES = ("confluence", "gitlab", "jira", "opensearch", "kibana", "cloudwatch", "kafka", "redis", "sqs_sns", "pgvector", "knowledge")


def permitted(rows: DataFrame, grants: DataFrame, documents: DataFrame, principals: Sequence[str], key: str = "document_id") -> DataFrame:
    """Rows whose live document one of the principals may read; no principals, no rows."""
    allowed = grants.filter(F.col("principal").isin(list(principals)) if principals else F.lit(False))
    readable = allowed.join(documents.filter("deleted_at IS NULL"), "document_id", "left_semi").select(F.col("document_id").alias("__may"))
    return rows.join(readable, F.col(key) == F.col("__may"), "left_semi")


def compressed(rows: DataFrame, order: Sequence[Column], by: str, each: int = 512, total: int = 2048) -> DataFrame:
    """Chunks cut to `each` words, taken in order while they fit into `total` words a query: one that doesn't fit is left
    out, later ones may still fit."""
    cut = rows.withColumn("text", first_words(F.col("text"), each))
    cut = cut.withColumn("token_count", F.coalesce(token_count(F.col("text")), F.lit(0)))  # a null text takes nothing

    def take(used, n):
        fits = used + n <= total
        return (used + n if fits else used), (fits,)

    return folded(cut, [by], order, ["token_count"], 0, take, "__fits boolean").filter("__fits").drop("__fits")


def evidenced(source: Column, document: Column, chunk: Column, uri: Column) -> Column:
    """A claim can be traced: a known source, and a document, chunk and address that aren't blank."""
    filled = lambda x: F.length(F.trim(F.coalesce(x.cast("string"), F.lit("")))) > 0
    return F.coalesce(source.isin(list(KNOWN_SOURCES)), F.lit(False)) & filled(document) & chunk.isNotNull() & filled(uri)


def graded(claims: DataFrame, now: datetime | Column, fact_type: str = "architecture") -> DataFrame:
    """Verdicts on claims (query, pos, text, heading_path, source_type, document_id, chunk_id, source_uri,
    source_updated_at, retrieval_score): query, first_pos, text, verdict, confidence, n_sources, n_values, positions, note.

    Untraceable claims are UNKNOWN, each for itself. Others with one subject (their heading, else their own text) are one:
    CONFLICT if two sources or more give two values or more, else FACT or LOW_CONFIDENCE by confidence. Scores are scaled
    over all claims of the query, so the lowest of unequal scores counts as 0.
    """
    score = F.coalesce(F.col("retrieval_score"), F.lit(0.0))
    bounds = claims.groupBy(F.col("query").alias("__q")).agg(F.min(score).alias("__low"), F.max(score).alias("__high"))
    low, high = F.col("__low"), F.col("__high")
    c = claims.join(bounds, F.col("query").eqNullSafe(F.col("__q"))).withColumn("__r", F.when(high <= low, F.lit(1.0)).otherwise((score - low) / (high - low)))
    c = c.withColumn("__ok", evidenced(F.col("source_type"), F.col("document_id"), F.col("chunk_id"), F.col("source_uri")))
    subject = F.when(F.length(F.trim(F.coalesce("heading_path", F.lit("")))) > 0, normal_value(F.col("heading_path"))).otherwise(F.concat(F.lit("self: "), normal_value(F.col("text"))))
    c = c.withColumn("__key", F.when(F.col("__ok"), subject).otherwise(F.concat(F.lit("unknown: "), F.col("pos"))))
    c = c.withColumn("__value", normal_value(F.col("text")))
    g = c.groupBy("query", "__key", "__ok").agg(
        F.min("pos").alias("first_pos"),
        F.min_by("text", "pos").alias("text"),
        F.max("__r").alias("__r"),
        F.max("source_updated_at").alias("__updated"),
        F.count_distinct("source_type", "document_id").alias("n_sources"),
        F.count_distinct("__value").alias("n_values"),
        F.array_join(F.array_sort(F.collect_set("__value")), " | ").alias("positions"),
    )
    horizon = F.lit(HORIZONS.get(fact_type)).cast("int")
    at = now if isinstance(now, Column) else F.lit(now)
    sure = confidence(F.col("__r"), agreement(F.col("n_sources")), freshness(F.col("__updated"), at, horizon))
    clash = F.col("__ok") & (F.col("n_values") >= 2) & (F.col("n_sources") >= 2)
    verdict = F.when(~F.col("__ok"), "UNKNOWN").when(clash, "CONFLICT").when(sure >= FACT, "FACT").otherwise("LOW_CONFIDENCE")
    source = AUTHORITIES.get(fact_type)
    return g.select(
        "query", "first_pos", "text", verdict.alias("verdict"), F.when(F.col("__ok") & ~clash, sure).alias("confidence"), F.when(F.col("__ok"), F.col("n_sources")).otherwise(0).alias("n_sources"), "n_values",
        F.when(clash, F.col("positions")).alias("positions"), F.when(clash, F.lit(f"{source} has the say on {fact_type}" if source else None)).alias("note"),
    )


def reconciled(snapshot: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Each snapshot value beside the live one: no live value is LOW_CONFIDENCE, equal ones FACT, others CONFLICT."""
    left = snapshot.select(key, F.col("value").alias("snapshot_value"))
    right = live.select(F.col(key).alias("__key"), F.col("value").alias("live_value"))
    same = normal_value(F.col("snapshot_value").cast("string")) == normal_value(F.col("live_value").cast("string"))
    return left.join(right, F.col(key) == F.col("__key"), "left").select(key, "snapshot_value", "live_value", F.when(F.col("live_value").isNull(), "LOW_CONFIDENCE").when(same, "FACT").otherwise("CONFLICT").alias("verdict"))


def reranked(rows: DataFrame, by: str, score: Column | None, order: Sequence[Column]) -> DataFrame:
    """Adds place (from 1) and rerank_status: by a score (any column, say a pandas UDF's; ties by the order given); in the order
    given where there is none, or where a row of the group has no score (null stands for a scorer that failed)."""
    over = W.partitionBy(by)
    if score is None:
        return rows.withColumn("place", F.row_number().over(over.orderBy(*order))).withColumn("rerank_status", F.lit("disabled"))
    scored = rows.withColumn("__s", score)
    failed = scored.groupBy(F.col(by).alias("__by")).agg(F.bool_or(F.col("__s").isNull()).alias("__failed"))
    both = scored.join(failed, F.col(by).eqNullSafe(F.col("__by"))).withColumn("__s", F.when(~F.col("__failed"), F.col("__s")))
    return both.withColumn("place", F.row_number().over(over.orderBy(F.col("__s").desc(), *order))).withColumn("rerank_status", F.when(F.col("__failed"), "disabled").otherwise("ok")).drop("__s", "__by", "__failed")


def provenance(claims: DataFrame) -> DataFrame:
    """query, subject, value, n, sources: for each subject that sources state differently, each value once, and where it stands."""
    ok = evidenced(F.col("source_type"), F.col("document_id"), F.col("chunk_id"), F.col("source_uri"))
    subject = F.coalesce(F.nullif(normal_value(F.col("heading_path")), F.lit("")), F.concat(F.lit("self: "), normal_value(F.col("text"))))
    c = claims.filter(ok).select("query", subject.alias("subject"), normal_value(F.col("text")).alias("value"), "source_type", "document_id", "source_uri", "pos")
    clash = c.groupBy(F.col("query").alias("q"), F.col("subject").alias("s")).agg(F.count_distinct("value").alias("v"), F.count_distinct("source_type", "document_id").alias("d")).filter("v >= 2 AND d >= 2")
    mine = c.join(clash, F.col("query").eqNullSafe(F.col("q")) & (F.col("subject") == F.col("s")), "left_semi")
    where = F.array_sort(F.collect_set(F.struct("pos", "source_type", "document_id", "source_uri")))
    return mine.groupBy("query", "subject", "value").agg(F.count(F.lit(1)).alias("n"), where.alias("sources"))


def citations(claims: DataFrame) -> DataFrame:
    """query, uri, source_type, document_id, first_pos: the traceable claims' addresses, each once, where it first stands."""
    ok = evidenced(F.col("source_type"), F.col("document_id"), F.col("chunk_id"), F.col("source_uri"))
    one = claims.filter(ok).groupBy("query", F.col("source_uri").alias("uri")).agg(F.min(F.struct("pos", "source_type", "document_id")).alias("c"))
    return one.select("query", "uri", "c.source_type", "c.document_id", F.col("c.pos").alias("first_pos"))


def snapshot_for(candidates: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """query, document_id, matched: for each live row (query and its key), the first candidate (query, rank, document_id, text)
    that names the key in any case, else the first of all. Nothing without candidates."""
    both = candidates.join(live.select(F.col("query").alias("__q"), F.lower(key).alias("__k")), F.col("query") == F.col("__q"))
    named = F.coalesce(F.lower("text").contains(F.col("__k")), F.lit(False))
    best = both.groupBy("query").agg(F.min(F.struct((~named).alias("other"), F.col("rank"), F.col("document_id"))).alias("b"))
    return best.select("query", F.col("b.document_id").alias("document_id"), (~F.col("b.other")).alias("matched"))


def authorities(stored: DataFrame | None, spark) -> DataFrame:
    """fact_type, source, horizon_hours: from a stored table of these; the defaults if there is none or it is empty."""
    rows = [(k, AUTHORITIES.get(k), HORIZONS.get(k)) for k in sorted({*AUTHORITIES, *HORIZONS})]
    defaults = spark.createDataFrame(rows, "fact_type string, source string, horizon_hours int")
    if stored is None:
        return defaults
    own = stored.select("fact_type", "source", F.col("horizon_hours").cast("int").alias("horizon_hours"))
    return own.unionByName(defaults.join(F.broadcast(own.limit(1).select(F.lit(1).alias("any"))), F.lit(True), "left_anti"))
