"""Queries of lookups: entities, summaries, stored models, addresses, envelopes, many vector queries at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from karst.functions import scores
from karst.operators import grounding, lookups
from karst.sources import tables as kb

from .queries import _GRADED, NOW, _claims
from .registry import query


def _graded(spark, sf_dir):
    return grounding.graded(_claims(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query("entity_by_name", """e AS (
  SELECT 'nation:' || n_nationkey AS id, 'nation' AS entity_type, n_name AS name, n_nationkey::BIGINT AS document_id FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'region', r_name, r_regionkey::BIGINT FROM region
  UNION ALL SELECT 'segment:' || c_custkey, 'customer', c_mktsegment, c_custkey FROM customer
), f AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY entity_type, id) AS n FROM e)
SELECT lower(f.name) AS name, f.id, f.entity_type, f.document_id, d.title FROM f LEFT JOIN kb_documents d ON d.document_id = f.document_id AND d.deleted_at IS NULL WHERE n = 1""")
def entity_by_name(spark, sf_dir):
    def entities(table, kind, key, name, prefix):
        return kb.table(spark, sf_dir, table).select(F.concat(F.lit(prefix + ":"), key).alias("id"), F.lit(kind).alias("entity_type"), F.col(name).alias("name"), F.col(key).cast("long").alias("document_id"))

    e = entities("nation", "nation", "n_nationkey", "n_name", "nation")
    e = e.unionByName(entities("region", "region", "r_regionkey", "r_name", "region")).unionByName(entities("customer", "customer", "c_custkey", "c_mktsegment", "segment"))
    return lookups.first_by_name(e, kb.documents(spark, sf_dir))


@query("knowledge_summary", """p AS (
  SELECT 'topic ' || (document_id // 3) AS subject, deleted_at IS NULL AND EXISTS (SELECT 1 FROM kb_grants g WHERE g.document_id = d.document_id AND principal IN ('u1', '*team*')) AS ok FROM kb_documents d
) SELECT subject, count(*) AS n FROM p GROUP BY subject HAVING bool_and(ok)""")
def knowledge_summary(spark, sf_dir):
    d = kb.documents(spark, sf_dir)
    provenance = d.select(F.concat(F.lit("topic "), F.floor(F.col("document_id") / 3)).alias("subject"), "document_id")
    return lookups.summaries_permitted(provenance, kb.grants(spark, sf_dir), d, ["u1", "*team*"])


@query("stored_models", "SELECT embedding_model, count(*) AS chunks, min(len(embedding)) AS least, max(len(embedding)) AS most FROM kb_chunks GROUP BY 1")
def stored_models(spark, sf_dir):
    return lookups.stored_models(kb.chunks(spark, sf_dir))


@query("reembed_plan", "SELECT chunk_id, document_id FROM kb_chunks WHERE embedding_model IS DISTINCT FROM 'hash-64'")
def reembed_plan(spark, sf_dir):
    return lookups.to_reembed(kb.chunks(spark, sf_dir), kb.MODEL).select("chunk_id", "document_id")


@query("unit_vectors", "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, round(embedding[64]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS last FROM embeddings")
def unit_vectors(spark, sf_dir):
    u = kb.table(spark, sf_dir, "embeddings").select("vec_id", scores.unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


@query("vector_topk_each", """s AS (SELECT q.vec_id AS query, r.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0)
SELECT query, id, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS place FROM s QUALIFY place <= 5""")
def vector_topk_each(spark, sf_dir):
    rows = kb.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return lookups.vector_top_each(rows.filter("id % 20 = 0"), rows, 5)


@query("url_origins", r"SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)', 1) || '/' AS origin FROM pages")
def url_origins(spark, sf_dir):
    return kb.table(spark, sf_dir, "pages").select("page_id", lookups.origin(F.col("url")).alias("origin"))


@query("resource_names", "SELECT document_id, document_id::VARCHAR AS by_uri, document_id::VARCHAR AS by_id FROM kb_documents")
def resource_names(spark, sf_dir):
    return kb.documents(spark, sf_dir).select("document_id", lookups.resource_name(F.col("source_uri")).alias("by_uri"), lookups.resource_name(F.col("source_id")).alias("by_id"))


@query("conflict_positions", """c AS (SELECT container AS query, document_id AS pos, 'status ' || (document_id % 3) AS value, document_id % 40 AS subject FROM kb_documents WHERE document_id % 13 <> 0)
SELECT query, min(pos) AS first_pos, string_agg(DISTINCT value, ' | ' ORDER BY value) AS positions FROM c GROUP BY query, subject HAVING count(DISTINCT value) >= 2 AND count(DISTINCT pos) >= 2""")
def conflict_positions(spark, sf_dir):
    return lookups.conflicts(_graded(spark, sf_dir))


@query("grounded_envelope", f"{_GRADED} SELECT query, count(*) AS claims, count(*) FILTER (verdict <> 'UNKNOWN') AS grounded, count(*) FILTER (verdict <> 'UNKNOWN') = 0 AS insufficient FROM t GROUP BY query")
def grounded_envelope(spark, sf_dir):
    return lookups.envelope(_graded(spark, sf_dir))


@query("stated_values", "SELECT document_id, CASE WHEN document_id % 2 = 0 THEN 'value ' || document_id ELSE title END AS value FROM kb_documents")
def stated_values(spark, sf_dir):
    text = F.when(F.col("document_id") % 2 == 0, F.concat(F.lit("Ticket\nStatus:  value "), "document_id", F.lit("; more"))).otherwise(F.col("title"))
    return kb.documents(spark, sf_dir).select("document_id", lookups.stated_value(text).alias("value"))
