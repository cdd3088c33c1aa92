"""The knowledge base's tables, derived from the driver's tables; each with the SQL that derives the same.

documents: doc_id becomes a document of one of four sources; every 17th is a tombstone, every 11th restricted.
chunks: embeddings dealt to documents; every 23rd has another model. events: log rows and messages of four partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SOURCES = ("confluence", "gitlab", "jira", "opensearch")
MODEL, OTHER_MODEL = "hash-64", "hash-32"
EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("doc_id") % 4 + 1).cast("int"))
    updated = F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + F.col("doc_id") * 3600)
    return d.select(
        F.col("doc_id").alias("document_id"), kind.alias("source_type"),
        F.concat(kind, F.lit(":"), F.col("doc_id")).alias("source_id"),
        F.concat(F.lit("https://"), kind, F.lit(".example/"), F.col("doc_id")).alias("source_uri"),
        F.concat(F.lit("Document "), F.col("doc_id")).alias("title"),
        F.col("source").alias("container"), F.concat(F.lit("user"), F.col("doc_id") % 7).alias("author"),
        updated.alias("source_updated_at"),
        F.when(F.col("doc_id") % 17 == 0, updated).alias("deleted_at"),
        F.when(F.col("doc_id") % 11 == 0, "restricted").otherwise("team").alias("visibility"),
        "text", "lang",
    )


DOCUMENTS = """kb_documents AS (
  SELECT doc_id AS document_id, list_extract(['confluence','gitlab','jira','opensearch'], (doc_id % 4 + 1)::INT) AS source_type,
    list_extract(['confluence','gitlab','jira','opensearch'], (doc_id % 4 + 1)::INT) || ':' || doc_id AS source_id,
    'https://' || list_extract(['confluence','gitlab','jira','opensearch'], (doc_id % 4 + 1)::INT) || '.example/' || doc_id AS source_uri,
    'Document ' || doc_id AS title, source AS container, 'user' || (doc_id % 7) AS author,
    TIMESTAMP '2024-01-01' + to_hours(doc_id) AS source_updated_at,
    CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2024-01-01' + to_hours(doc_id) END AS deleted_at,
    CASE WHEN doc_id % 11 = 0 THEN 'restricted' ELSE 'team' END AS visibility, text, lang
  FROM documents
)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    e = table(spark, sf_dir, "embeddings")
    return e.crossJoin(F.broadcast(n)).select(  # the other side is one row
        F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % F.col("n")).alias("document_id"), F.floor(F.col("vec_id") / F.col("n")).cast("int").alias("chunk_index"),
        F.concat(F.lit("chunk "), F.col("label"), F.lit(" of vector "), F.col("vec_id")).alias("content"), "embedding", "label",
        F.when(F.col("vec_id") % 23 == 0, OTHER_MODEL).otherwise(MODEL).alias("embedding_model"),
    )


CHUNKS = """kb_chunks AS (
  SELECT vec_id AS chunk_id, vec_id % (SELECT count(*) FROM documents) AS document_id, (vec_id // (SELECT count(*) FROM documents))::INT AS chunk_index,
    'chunk ' || label || ' of vector ' || vec_id AS content, embedding, label,
    CASE WHEN vec_id % 23 = 0 THEN 'hash-32' ELSE 'hash-64' END AS embedding_model
  FROM embeddings
)"""


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, principal: *team* reads team documents, one user each third restricted one."""
    d = documents(spark, sf_dir)
    team = d.filter("visibility = 'team'").select("document_id", F.lit("*team*").alias("principal"))
    one = d.filter("visibility = 'restricted' AND document_id % 3 = 0").select("document_id", F.concat(F.lit("u"), F.col("document_id") % 5).alias("principal"))
    return team.unionByName(one)


GRANTS = """kb_grants AS (
  SELECT document_id, '*team*' AS principal FROM kb_documents WHERE visibility = 'team'
  UNION ALL SELECT document_id, 'u' || (document_id % 5) FROM kb_documents WHERE visibility = 'restricted' AND document_id % 3 = 0
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, rel_type between customers, suppliers, nations and regions; region to nation closes cycles."""
    c, s, n = (table(spark, sf_dir, x) for x in ("customer", "supplier", "nation"))
    name = lambda kind, key: F.concat(F.lit(kind + ":"), F.col(key))
    edge = lambda df, a, b, rel: df.select(a.alias("src"), b.alias("dst"), F.lit(rel).alias("rel_type"))
    return (
        edge(c, name("customer", "c_custkey"), name("nation", "c_nationkey"), "belongs_to")
        .unionByName(edge(s, name("supplier", "s_suppkey"), name("nation", "s_nationkey"), "belongs_to"))
        .unionByName(edge(n, name("nation", "n_nationkey"), name("region", "n_regionkey"), "part_of"))
        .unionByName(edge(n, name("region", "n_regionkey"), name("nation", "n_nationkey"), "contains"))
    )


EDGES = """kb_edges AS (
  SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst, 'belongs_to' AS rel_type FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'belongs_to' FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'part_of' FROM nation
  UNION ALL SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey, 'contains' FROM nation
)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts (UTC), level, service, value, props."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("level"), F.concat(F.lit("service"), F.col("user_id") % 5).alias("service"), "user_id", "value", "props")


LOGS = """kb_logs AS (
  SELECT event_id, ts, event_type AS level, 'service' || (user_id % 5) AS service, user_id, value, props FROM events
)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, partition, offset, ts, key, value: a topic has the offsets of each of its partitions in order of time."""
    e = logs(spark, sf_dir).withColumn("partition", (F.col("user_id") % 4).cast("int"))
    offset = F.row_number().over(W.partitionBy("level", "partition").orderBy("ts", "event_id")) - 1
    return e.select(F.col("level").alias("topic"), "partition", offset.cast("long").alias("offset"), "ts", F.col("user_id").cast("string").alias("key"), "value", "event_id")


MESSAGES = """kb_messages AS (
  SELECT level AS topic, (user_id % 4)::INT AS partition, row_number() OVER (PARTITION BY level, user_id % 4 ORDER BY ts, event_id) - 1 AS "offset", ts,
    user_id::VARCHAR AS key, value, event_id
  FROM kb_logs
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_type, run_id, started_at, status, failed: three runs of each source, from its documents' residues."""
    d = documents(spark, sf_dir)
    return d.groupBy("source_type", (F.col("document_id") % 12 % 3).alias("run_no")).agg(F.max("source_updated_at").alias("started_at"), F.sum(F.when(F.col("document_id") % 29 == 0, 1).otherwise(0)).alias("failed")).select(
        "source_type", F.concat("source_type", F.lit("-"), F.col("run_no")).alias("run_id"), "started_at", F.when(F.col("failed") == 0, "ok").when(F.col("failed") < 10, "partial").otherwise("failed").alias("status"), "failed"
    )


RUNS = """kb_runs AS (
  SELECT source_type, source_type || '-' || (document_id % 12 % 3) AS run_id, max(source_updated_at) AS started_at,
    CASE WHEN sum(CASE WHEN document_id % 29 = 0 THEN 1 ELSE 0 END) = 0 THEN 'ok' WHEN sum(CASE WHEN document_id % 29 = 0 THEN 1 ELSE 0 END) < 10 THEN 'partial' ELSE 'failed' END AS status,
    sum(CASE WHEN document_id % 29 = 0 THEN 1 ELSE 0 END)::BIGINT AS failed
  FROM kb_documents GROUP BY source_type, document_id % 12 % 3
)"""
