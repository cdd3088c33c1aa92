"""The queries over the derived tables. Every one runs over its whole tables; limits are top-k's and pages' own."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karst.functions import scores
from karst.functions import text as txt
from karst.operators import ann, chunking, embedding, evaluation, events, graph, grounding, ingest, lookups, search
from karst.sources import tables as kb
from karst.sources.shared import new_folder
from karst.streaming import windows

from .registry import query

NOW = "2024-03-01 00:00:00"


def _vector(spark, sf_dir, vec_id=0):
    return list(kb.table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"])


def _live(spark, sf_dir, where=None):
    return search.live(kb.chunks(spark, sf_dir), kb.documents(spark, sf_dir), kb.MODEL, where)


_SCORED = """q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), s AS (
  SELECT c.*, d.source_type, d.container, d.visibility, round(list_cosine_similarity(c.embedding::DOUBLE[], q.v), 6) AS similarity
  FROM kb_chunks c JOIN kb_documents d USING (document_id), q WHERE d.deleted_at IS NULL AND c.embedding_model = 'hash-64'
)"""

# --------------------------------------------------------------------------- retrieval


@query("vector_topk", f"{_SCORED} SELECT chunk_id, document_id, similarity FROM s ORDER BY similarity DESC, chunk_id LIMIT 10")
def vector_topk(spark, sf_dir):
    return search.vector_top(_live(spark, sf_dir), _vector(spark, sf_dir), 10).select("chunk_id", "document_id", "similarity")


@query("vector_topk_filtered", f"{_SCORED} SELECT chunk_id, document_id, source_type, similarity FROM s WHERE source_type IN ('gitlab', 'jira') AND visibility = 'team' ORDER BY similarity DESC, chunk_id LIMIT 10")
def vector_topk_filtered(spark, sf_dir):
    where = F.col("source_type").isin("gitlab", "jira") & (F.col("visibility") == "team")
    return search.vector_top(_live(spark, sf_dir, where), _vector(spark, sf_dir), 10).select("chunk_id", "document_id", "source_type", "similarity")


@query("vector_threshold", f"{_SCORED} SELECT chunk_id, similarity FROM s WHERE similarity >= 0.3 ORDER BY similarity DESC, chunk_id LIMIT 8")
def vector_threshold(spark, sf_dir):
    return search.vector_top(_live(spark, sf_dir), _vector(spark, sf_dir), 8, least=0.3).select("chunk_id", "similarity")


@query("explain_empty", f"{_SCORED} SELECT count(*) AS indexed, count(*) FILTER (similarity >= 0.3) AS alike, count(*) FILTER (similarity >= 0.3 AND NOT coalesce(container = 'none', false)) AS excluded, CASE WHEN count(*) = 0 THEN 'nothing indexed' WHEN count(*) FILTER (similarity >= 0.3) = 0 THEN 'nothing similar' ELSE 'filters excluded all' END AS reason FROM s")
def explain_empty(spark, sf_dir):
    return search.why_empty(kb.chunks(spark, sf_dir), kb.documents(spark, sf_dir), kb.MODEL, _vector(spark, sf_dir), 0.3, F.col("container") == "none")


_WORDS = r"""w AS (
  SELECT document_id, source_type, visibility, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM kb_documents WHERE deleted_at IS NULL
), k AS (
  SELECT document_id, source_type, visibility, round(len([x for x in t if x IN ('the', 'of')]) / len(t)::DOUBLE, 9) AS rank_score FROM w WHERE list_contains(t, 'the') AND list_contains(t, 'of')
)"""


def _keywords(spark, sf_dir, where=None):
    d = kb.documents(spark, sf_dir).filter("deleted_at IS NULL")
    return search.keyword_top(d if where is None else d.filter(where), "text", "document_id", 50, ["the", "of"])


@query("keyword_topk", f"{_WORDS} SELECT document_id, rank_score FROM k ORDER BY rank_score DESC, document_id LIMIT 50")
def keyword_topk(spark, sf_dir):
    return _keywords(spark, sf_dir).select("document_id", "rank_score")


@query("keyword_phrase", r"""w AS (SELECT document_id, list_aggregate(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 'string_agg', ' ') AS t, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a FROM kb_documents)
SELECT document_id, round(len([x for x in a if x IN ('mit', 'license')]) / len(a)::DOUBLE, 9) AS rank_score FROM w WHERE contains(' ' || t || ' ', ' mit license ') AND NOT list_contains(a, 'gnu') ORDER BY rank_score DESC, document_id LIMIT 20""")
def keyword_phrase(spark, sf_dir):
    return search.keyword_top(kb.documents(spark, sf_dir), "text", "document_id", 20, [], none_of=["gnu"], phrases=[["mit", "license"]]).select("document_id", "rank_score")


_LEGS = """legs AS (
  SELECT document_id, 'vector' AS leg, row_number() OVER (ORDER BY similarity DESC, document_id) AS rank FROM (SELECT document_id, max(similarity) AS similarity FROM s WHERE {where} GROUP BY document_id ORDER BY similarity DESC, document_id LIMIT 50)
  UNION ALL SELECT document_id, 'keyword', row_number() OVER (ORDER BY rank_score DESC, document_id) FROM (SELECT * FROM k WHERE {where} ORDER BY rank_score DESC, document_id LIMIT 50)
), f AS (
  SELECT document_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score, string_agg(leg || '=' || rank, ',' ORDER BY leg) AS legs FROM legs GROUP BY document_id
)"""
_FUSED = f"{_SCORED}, {_WORDS}, {_LEGS.format(where='true')}"
_FUSED_WHERE = f"""{_SCORED}, {_WORDS}, {_LEGS.format(where="source_type IN ('gitlab', 'confluence')")}"""


def _legs(spark, sf_dir, where=None):
    """Both legs' first 50; a filter counts before that."""
    best = _live(spark, sf_dir, where).withColumn("similarity", F.round(scores.cosine(F.col("embedding"), _vector(spark, sf_dir)), 6)).groupBy("document_id").agg(F.max("similarity").alias("similarity"))
    vector = search.ranked(best.orderBy(F.col("similarity").desc(), "document_id").limit(50), "vector", "document_id", F.col("similarity").desc())
    keyword = search.ranked(_keywords(spark, sf_dir, where), "keyword", "document_id", F.col("rank_score").desc())
    return vector.unionByName(keyword)


@query("rrf_fuse", f"{_FUSED} SELECT document_id, rrf_score, legs FROM f ORDER BY rrf_score DESC, document_id LIMIT 20")
def rrf_fuse(spark, sf_dir):
    return search.fuse(_legs(spark, sf_dir), "document_id", top=20)


@query("hybrid_filtered", f"{_FUSED_WHERE} SELECT f.document_id, rrf_score, legs, d.title FROM f JOIN kb_documents d USING (document_id) ORDER BY rrf_score DESC, document_id LIMIT 20")
def hybrid_filtered(spark, sf_dir):
    fused = search.fuse(_legs(spark, sf_dir, F.col("source_type").isin("gitlab", "confluence")), "document_id", top=20)
    return fused.join(kb.documents(spark, sf_dir).select("document_id", "title"), "document_id").orderBy(F.col("rrf_score").desc(), "document_id").limit(20)


@query("code_search_granted", f"""{_SCORED}, {_WORDS}, {_LEGS.format(where="source_type = 'gitlab'")}, t AS (SELECT document_id, rrf_score FROM f ORDER BY rrf_score DESC, document_id LIMIT 20)
SELECT t.document_id, rrf_score, d.source_uri FROM t JOIN kb_documents d USING (document_id) WHERE EXISTS (SELECT 1 FROM kb_grants g WHERE g.document_id = t.document_id AND principal IN ('u1', '*team*'))""")
def code_search_granted(spark, sf_dir):
    """The twenty best of the code host, without those that the caller may not read."""
    d = kb.documents(spark, sf_dir)
    fused = search.fuse(_legs(spark, sf_dir, F.col("source_type") == "gitlab"), "document_id", top=20)
    may = grounding.permitted(fused, kb.grants(spark, sf_dir), d, ["u1", "*team*"])
    return may.join(d.select("document_id", "source_uri"), "document_id").select("document_id", "rrf_score", "source_uri")


@query("hash_bucket_embedding", """SELECT doc_id, ('0x' || substr(sha256(lower(word)), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents) GROUP BY ALL""")
def hash_bucket_embedding(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    return embedding.word_buckets(kb.table(spark, sf_dir, "documents"), "doc_id", words)


@query("ann_topk")
def ann_topk(spark, sf_dir):
    """The approximate ten of every vector with an id divisible by 20, from an index that is stored for it."""
    rows = kb.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = ann.build(rows, new_folder(spark, "ann"))
    return ann.search_each(index, rows.filter("id % 20 = 0"), 10).select("query", "id", "similarity", "place")


# --------------------------------------------------------------------------- named statements


@query("list_sources", """m AS (
  SELECT d.source_type, count(DISTINCT c.document_id) AS embedded, count(*) AS chunks, string_agg(DISTINCT c.embedding_model, ',' ORDER BY c.embedding_model) AS models FROM kb_chunks c JOIN kb_documents d USING (document_id) WHERE d.deleted_at IS NULL GROUP BY d.source_type
), n AS (SELECT source_type, count(*) AS documents, arg_max(source_uri, source_updated_at) AS sample FROM kb_documents WHERE deleted_at IS NULL GROUP BY source_type
), l AS (SELECT source_type, arg_max(status, (started_at, run_id)) AS last_status FROM kb_runs GROUP BY source_type)
SELECT n.source_type, n.documents, n.sample, coalesce(m.embedded, 0) AS embedded, coalesce(m.chunks, 0) AS chunks, m.models, l.last_status FROM n LEFT JOIN m USING (source_type) LEFT JOIN l USING (source_type)""")
def list_sources(spark, sf_dir):
    d = kb.documents(spark, sf_dir).filter("deleted_at IS NULL")
    n = d.groupBy("source_type").agg(F.count(F.lit(1)).alias("documents"), F.max_by("source_uri", "source_updated_at").alias("sample"))
    c = kb.chunks(spark, sf_dir).join(d.select("document_id", "source_type"), "document_id")
    models = F.array_join(F.array_sort(F.collect_set("embedding_model")), ",").alias("models")
    m = c.groupBy("source_type").agg(F.count_distinct("document_id").alias("embedded"), F.count(F.lit(1)).alias("chunks"), models)
    last = kb.runs(spark, sf_dir).groupBy("source_type").agg(F.max_by("status", F.struct("started_at", "run_id")).alias("last_status"))
    zero = F.lit(0).cast("long")
    return n.join(m, "source_type", "left").join(last, "source_type", "left").withColumn("embedded", F.coalesce("embedded", zero)).withColumn("chunks", F.coalesce("chunks", zero))


@query("freshness_by_source", f"SELECT source_type, count(*) AS documents, strftime(max(source_updated_at), '%Y-%m-%d %H:%M:%S') AS newest, round(epoch(TIMESTAMP '{NOW}' - max(source_updated_at)) / 3600, 1) AS hours FROM kb_documents WHERE deleted_at IS NULL GROUP BY source_type")
def freshness_by_source(spark, sf_dir):
    newest = F.max("source_updated_at")
    return kb.documents(spark, sf_dir).filter("deleted_at IS NULL").groupBy("source_type").agg(F.count(F.lit(1)).alias("documents"), F.date_format(newest, "yyyy-MM-dd HH:mm:ss").alias("newest"), scores.hours_between(newest, F.lit(NOW)).alias("hours"))


@query("document_by_key", "SELECT document_id, title, source_uri FROM kb_documents WHERE source_uri = 'https://jira.example/42' ORDER BY source_updated_at DESC LIMIT 1")
def document_by_key(spark, sf_dir):
    return kb.documents(spark, sf_dir).filter(F.col("source_uri") == "https://jira.example/42").orderBy(F.col("source_updated_at").desc()).limit(1).select("document_id", "title", "source_uri")


@query("document_chunks_window", "SELECT document_id, chunk_id, chunk_index, count(*) OVER (PARTITION BY document_id) AS total FROM kb_chunks")
def document_chunks_window(spark, sf_dir):
    return kb.chunks(spark, sf_dir).select("document_id", "chunk_id", "chunk_index", F.count(F.lit(1)).over(W.partitionBy("document_id")).alias("total"))


@query("document_reassembled", "SELECT document_id, count(*) AS chunks, string_agg(content, '\n\n' ORDER BY chunk_index) AS body FROM kb_chunks GROUP BY document_id")
def document_reassembled(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return kb.chunks(spark, sf_dir).groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.array_join(F.transform(parts, lambda x: x["content"]), "\n\n").alias("body"))


@query("document_capped", """w AS (SELECT conv_id AS document_id, count(*) AS chunks, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id)
SELECT document_id, chunks, substr(body, 1, 500) AS body, length(body) > 500 AS truncated, CASE WHEN length(body) > 500 THEN 'content truncated at 500 chars' END AS warning FROM w""")
def document_capped(spark, sf_dir):
    c = kb.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"))
    return lookups.reassembled(c, 500)


@query("document_versions", "SELECT document_id, lang, row_number() OVER (PARTITION BY container, lang ORDER BY source_updated_at DESC, document_id DESC) AS version_rank, container FROM kb_documents WHERE deleted_at IS NULL QUALIFY version_rank <= 3")
def document_versions(spark, sf_dir):
    w = W.partitionBy("container", "lang").orderBy(F.col("source_updated_at").desc(), F.col("document_id").desc())
    return kb.documents(spark, sf_dir).filter("deleted_at IS NULL").withColumn("version_rank", F.row_number().over(w)).filter("version_rank <= 3").select("document_id", "lang", "version_rank", "container")


@query("grants_semi", "SELECT document_id, visibility FROM kb_documents d WHERE deleted_at IS NULL AND EXISTS (SELECT 1 FROM kb_grants g WHERE g.document_id = d.document_id AND principal IN ('u1', '*team*'))")
def grants_semi(spark, sf_dir):
    d = kb.documents(spark, sf_dir)
    return grounding.permitted(d.filter("deleted_at IS NULL"), kb.grants(spark, sf_dir), d, ["u1", "*team*"]).select("document_id", "visibility")


@query("tombstone_anti", "SELECT document_id, source_type FROM kb_documents d WHERE deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM kb_chunks c WHERE c.document_id = d.document_id)")
def tombstone_anti(spark, sf_dir):
    return kb.documents(spark, sf_dir).filter("deleted_at IS NULL").join(kb.chunks(spark, sf_dir), "document_id", "left_anti").select("document_id", "source_type")


@query("latest_run_lateral", "SELECT source_type, arg_max(run_id, (started_at, run_id)) AS run_id, arg_max(status, (started_at, run_id)) AS status FROM kb_runs GROUP BY source_type")
def latest_run_lateral(spark, sf_dir):
    last = F.struct("started_at", "run_id")
    return kb.runs(spark, sf_dir).groupBy("source_type").agg(F.max_by("run_id", last).alias("run_id"), F.max_by("status", last).alias("status"))


@query("entity_neighbours", "SELECT rel_type, dst FROM kb_edges WHERE src = 'region:1' ORDER BY rel_type, dst LIMIT 100")
def entity_neighbours(spark, sf_dir):
    return graph.neighbours(kb.edges(spark, sf_dir), "region:1")


def _walk_sql(where: str) -> str:
    return f"""RECURSIVE w AS (
  SELECT 'customer:1' AS root, 1 AS depth, src, rel_type, dst, ['customer:1', dst] AS path FROM kb_edges WHERE src = 'customer:1' {where}
  UNION ALL SELECT root, depth + 1, e.src, e.rel_type, e.dst, list_append(path, e.dst) FROM w JOIN kb_edges e ON e.src = w.dst WHERE depth < 3 AND NOT list_contains(path, e.dst) {where.replace('rel_type', 'e.rel_type')}
) SELECT DISTINCT root, depth, src, rel_type, dst FROM w ORDER BY root, depth, src, rel_type, dst LIMIT 600"""


@query("graph_walk_depth3", _walk_sql(""))
def graph_walk_depth3(spark, sf_dir):
    return graph.walk(kb.edges(spark, sf_dir), ["customer:1"])


@query("graph_walk_reltype", _walk_sql("AND rel_type IN ('belongs_to', 'part_of')"))
def graph_walk_reltype(spark, sf_dir):
    return graph.walk(kb.edges(spark, sf_dir), ["customer:1"], rel_types=["belongs_to", "part_of"])


@query("graph_walk_regions", """RECURSIVE w AS (
  SELECT src AS root, 1 AS depth, src, rel_type, dst, [src, dst] AS path FROM kb_edges WHERE src LIKE 'nation:%' OR src LIKE 'supplier:%'
  UNION ALL SELECT root, depth + 1, e.src, e.rel_type, e.dst, list_append(path, e.dst) FROM w JOIN kb_edges e ON e.src = w.dst WHERE depth < 3 AND NOT list_contains(path, e.dst)
) SELECT DISTINCT root, depth, src, rel_type, dst FROM w""")
def graph_walk_regions(spark, sf_dir):
    """From every nation and supplier at a time."""
    e = kb.edges(spark, sf_dir)
    return graph.walk(e, e.select(F.col("src").alias("root")).filter("root LIKE 'nation:%' OR root LIKE 'supplier:%'"))


@query("edges_pruned", "SELECT src, dst, rel_type FROM kb_edges e WHERE rel_type <> 'belongs_to' OR split_part(src, ':', 2)::BIGINT IN (SELECT document_id FROM kb_grants WHERE principal = '*team*')")
def edges_pruned(spark, sf_dir):
    e = kb.edges(spark, sf_dir).withColumn("doc", F.when(F.col("rel_type") == "belongs_to", F.split_part("src", F.lit(":"), F.lit(2)).cast("long")))
    return graph.pruned(e, "doc", kb.grants(spark, sf_dir).filter("principal = '*team*'")).select("src", "dst", "rel_type")


# --------------------------------------------------------------------------- logs and metrics


@query("terms_agg", "SELECT level, count(*) AS n FROM kb_logs GROUP BY level ORDER BY n DESC, level LIMIT 3")
def terms_agg(spark, sf_dir):
    return events.terms(kb.logs(spark, sf_dir), "level", 3)


def _histogram(name: str, every: str, interval: str) -> None:
    @query(name, f"SELECT strftime(time_bucket(INTERVAL '{interval}', ts), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS n FROM kb_logs GROUP BY 1")
    def run(spark, sf_dir):
        return events.histogram(kb.logs(spark, sf_dir), every)


for _name, _every, _interval in (("date_histogram_5m", "5m", "5 minutes"), ("date_histogram_1h", "1h", "1 hour"), ("date_histogram_1d", "1d", "1 day")):
    _histogram(_name, _every, _interval)


@query("histogram_gaps", """t AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-12', INTERVAL 1 HOUR)) AS at), g AS (SELECT DISTINCT level FROM kb_logs WHERE value > 200 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12')
SELECT g.level, strftime(t.at, '%Y-%m-%d %H:%M:%S') AS bucket, count(l.event_id) AS n FROM g CROSS JOIN t LEFT JOIN kb_logs l ON l.level = g.level AND l.value > 200 AND l.ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND date_trunc('hour', l.ts) = t.at GROUP BY 1, 2""")
def histogram_gaps(spark, sf_dir):
    """Hours of a week by level, of high values: most hours have none."""
    return events.histogram_filled(kb.logs(spark, sf_dir).filter("value > 200"), "1h", "2024-01-05T00:00:00Z", "2024-01-12T01:00:00+01:00", by=["level"])


@query("metric_stats", "SELECT service, strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M:%S') AS bucket, round(avg(value), 6) AS average, round(sum(value), 4) AS total, min(value) AS minimum, max(value) AS maximum, count(value) AS samples FROM kb_logs GROUP BY 1, 2")
def metric_stats(spark, sf_dir):
    return events.metric(kb.logs(spark, sf_dir), 86400, by=["service"])


@query("metric_percentiles", "SELECT level, strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M:%S') AS bucket, round(avg(value), 6) AS average, round(sum(value), 4) AS total, min(value) AS minimum, max(value) AS maximum, count(value) AS samples, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM kb_logs GROUP BY 1, 2")
def metric_percentiles(spark, sf_dir):
    return events.metric(kb.logs(spark, sf_dir), 86400, by=["level"], percentiles=[50, 90, 99])


@query("log_count", "SELECT count(*) AS n FROM kb_logs WHERE level = 'purchase' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15'")
def log_count(spark, sf_dir):
    return events.between(kb.logs(spark, sf_dir).filter("level = 'purchase'"), "2024-01-05", "2024-01-15").agg(F.count(F.lit(1)).alias("n"))


_PAGE = "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, level FROM kb_logs WHERE service = 'service1'"


def _shown(df):
    return df.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "level")


@query("log_search_page", f"{_PAGE} ORDER BY ts DESC, event_id LIMIT 26")
def log_search_page(spark, sf_dir):
    return _shown(events.page(kb.logs(spark, sf_dir).filter("service = 'service1'"), 25))


@query("keyset_page2", f"{_PAGE} AND (ts < TIMESTAMP '2024-01-20 12:00:00' OR (ts = TIMESTAMP '2024-01-20 12:00:00' AND event_id > 5)) ORDER BY ts DESC, event_id LIMIT 26")
def keyset_page2(spark, sf_dir):
    after = events.cursor("2024-01-20 12:00:00", 5, "service1")
    return _shown(events.page(kb.logs(spark, sf_dir).filter("service = 'service1'"), 25, after, "service1"))


@query("json_field_filter", """SELECT event_id, (props->>'k')::BIGINT AS k FROM kb_logs WHERE (props->>'k')::BIGINT BETWEEN 10 AND 19""")
def json_field_filter(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return kb.logs(spark, sf_dir).select("event_id", k.alias("k")).filter("k BETWEEN 10 AND 19")


# --------------------------------------------------------------------------- messages


@query("topic_watermarks", 'SELECT topic, partition, min("offset") AS low, max("offset") + 1 AS high FROM kb_messages GROUP BY ALL')
def topic_watermarks(spark, sf_dir):
    return events.watermarks(kb.messages(spark, sf_dir))


_SHOW = 'SELECT partition, "offset", strftime(ts, \'%Y-%m-%d %H:%M:%S\') AS at, event_id'


def _seen(df):
    return df.select("partition", "offset", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_id")


@query("peek_latest", f"""m AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY "offset" DESC) AS n FROM kb_messages WHERE topic = 'click') {_SHOW} FROM m WHERE n <= (SELECT ceil(20.0 / count(DISTINCT partition)) FROM m) ORDER BY ts DESC, partition DESC, "offset" DESC LIMIT 20""")
def peek_latest(spark, sf_dir):
    return _seen(events.peek_latest(kb.messages(spark, sf_dir), "click", 20))


@query("peek_offset", f"""{_SHOW} FROM kb_messages WHERE topic = 'click' AND "offset" >= 10 ORDER BY ts, partition, "offset" LIMIT 20""")
def peek_offset(spark, sf_dir):
    return _seen(events.peek_from(kb.messages(spark, sf_dir), "click", 10, 20))


@query("peek_timestamp", f"""{_SHOW} FROM kb_messages WHERE topic = 'click' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts, partition, "offset" LIMIT 20""")
def peek_timestamp(spark, sf_dir):
    return _seen(events.peek_from(kb.messages(spark, sf_dir), "click", "2024-01-10", 20))


@query("consumer_lag", """w AS (SELECT topic, partition, min("offset") AS low, max("offset") + 1 AS high FROM kb_messages GROUP BY ALL),
g AS (SELECT topic, partition, CASE WHEN partition = 3 THEN -1 ELSE high - 7 * partition END AS done, high, low FROM w)
SELECT topic, partition, done, high, CASE WHEN done < 0 THEN high - low ELSE greatest(high - done, 0) END AS lag FROM g""")
def consumer_lag(spark, sf_dir):
    marks = events.watermarks(kb.messages(spark, sf_dir))
    done = marks.select("topic", "partition", F.when(F.col("partition") == 3, F.lit(-1)).otherwise(F.col("high") - 7 * F.col("partition")).alias("done"))
    return events.group_lag(done, marks)


@query("scan_type_slice", "SELECT user_id::VARCHAR AS key, count(*) AS size, list_slice(list(event_id ORDER BY ts, event_id), 1, 3)::VARCHAR AS head FROM events GROUP BY user_id")
def scan_type_slice(spark, sf_dir):
    e = kb.logs(spark, sf_dir)
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    head = e.withColumn("n", F.row_number().over(w)).filter("n <= 3").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("n", "event_id"))).alias("h"))
    size = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("size"))
    return size.join(head, "user_id").select(F.col("user_id").cast("string").alias("key"), "size", F.concat(F.lit("["), F.array_join(F.transform("h", lambda x: x["event_id"].cast("string")), ", "), F.lit("]")).alias("head"))


# --------------------------------------------------------------------------- text


@query("content_hash", "SELECT document_id, sha256(text) AS content_hash FROM kb_documents")
def content_hash(spark, sf_dir):
    return kb.documents(spark, sf_dir).select("document_id", txt.content_hash(F.col("text")).alias("content_hash"))


@query("token_count", r"SELECT document_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS tokens FROM kb_documents")
def token_count(spark, sf_dir):
    return kb.documents(spark, sf_dir).select("document_id", txt.token_count(F.col("text")).cast("long").alias("tokens"))


_LABELLED_RE2 = txt.LABELLED.replace("'", "''")


@query("redact_fixed_shapes", f"""SELECT document_id, sha256(regexp_replace(text, '{_LABELLED_RE2}', '\\1=«redacted:credential»', 'g')) AS redacted, len(regexp_extract_all(text, '{_LABELLED_RE2}'))::BIGINT AS n FROM kb_documents""")
def redact_fixed_shapes(spark, sf_dir):
    found = kb.documents(spark, sf_dir).select("document_id", txt.redacted(F.col("text")).alias("r"))
    return found.select("document_id", txt.content_hash(F.col("r.text")).alias("redacted"), F.col("r.count").cast("long").alias("n"))


@query("scrub_entropy")
def scrub_entropy(spark, sf_dir):
    text, n = txt.redact_shapes(F.col("text"))
    found = kb.documents(spark, sf_dir).select("document_id", n.alias("shapes"), txt.redact_entropy(text).alias("r"))
    return found.select("document_id", txt.content_hash(F.col("r.text")).alias("redacted"), (F.col("shapes") + F.col("r.count")).alias("n"))


@query("glob_filter", "SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '/[^/]*1[^/]*$') AND NOT lower(url) LIKE '%admin%'")
def glob_filter(spark, sf_dir):
    p = kb.table(spark, sf_dir, "pages")
    return p.filter(F.lower("url").rlike("/[^/]*1[^/]*$") & ~txt.matches_glob(F.col("url"), ["*admin*"])).select("page_id", "url")


@query("mask_endpoint", r"""e AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'sms' WHEN 2 THEN 'https' ELSE 'sqs' END AS protocol,
  CASE page_id % 4 WHEN 0 THEN 'user' || page_id || '@mail.example' WHEN 1 THEN '+1555' || (1000000 + page_id) ELSE replace(url, '://', '://u:p@') END AS endpoint FROM pages)
SELECT page_id, CASE protocol WHEN 'email' THEN 'u***@mail.example' WHEN 'sms' THEN '+15***' || right(endpoint, 2) WHEN 'https' THEN regexp_replace(regexp_replace(endpoint, '://[^/@]*@', '://'), '[?#].*$', '') ELSE endpoint END AS masked FROM e""")
def mask_endpoint(spark, sf_dir):
    i = F.col("page_id")
    protocol = F.when(i % 4 == 0, "email").when(i % 4 == 1, "sms").when(i % 4 == 2, "https").otherwise("sqs")
    endpoint = F.when(i % 4 == 0, F.concat(F.lit("user"), i, F.lit("@mail.example"))).when(i % 4 == 1, F.concat(F.lit("+1555"), i + 1000000)).otherwise(F.replace("url", F.lit("://"), F.lit("://u:p@")))
    return kb.table(spark, sf_dir, "pages").select("page_id", txt.masked_endpoint(protocol, endpoint).alias("masked"))


@query("intent_class", r"""i AS (SELECT conv_id, turn, regexp_matches(lower(text), '\b(currently|now|latest|today)\b') OR regexp_matches(lower(text), 'right now|still open|still being worked on|still in progress|currently assigned|who is assigned|latest commit|up to date|as of now|at the moment') AS live,
  regexp_matches(lower(text), '\b(architecture|design)\b') OR regexp_matches(lower(text), 'how does|how do|what happened|depend on|depends on') AS settled FROM conversations)
SELECT conv_id, turn, CASE WHEN live AND settled THEN 'mixed' WHEN live THEN 'live' ELSE 'knowledge' END AS need FROM i""")
def intent_class(spark, sf_dir):
    return kb.table(spark, sf_dir, "conversations").select("conv_id", "turn", txt.intent(F.col("text")).alias("need"))


@query("chunk_documents")
def chunk_documents(spark, sf_dir):
    return chunking.chunks(kb.documents(spark, sf_dir), "document_id", "text")


@query("normalize_pages")
def normalize_pages(spark, sf_dir):
    return kb.table(spark, sf_dir, "pages").select("page_id", txt.normalised(F.col("html")).alias("text"))


# --------------------------------------------------------------------------- grounding


@query("freshness_factor", f"""a AS (SELECT document_id, round(epoch(TIMESTAMP '{NOW}' - source_updated_at) / 3600.0, 1) AS age FROM kb_documents)
SELECT document_id, round(CASE WHEN greatest(age, 0) <= 720 THEN 1.0 ELSE greatest(0.25, 720 / greatest(age, 0)) END::DOUBLE, 9) AS factor FROM a""")
def freshness_factor(spark, sf_dir):
    return kb.documents(spark, sf_dir).select("document_id", F.round(scores.freshness(F.col("source_updated_at"), F.lit(NOW), F.lit(720)), 9).alias("factor"))


@query("agreement", "SELECT container, count(DISTINCT source_type) AS sources, round(count(DISTINCT source_type) / (1.0::DOUBLE + count(DISTINCT source_type)), 9) AS agreement FROM kb_documents GROUP BY container")
def agreement(spark, sf_dir):
    n = kb.documents(spark, sf_dir).groupBy("container").agg(F.count_distinct("source_type").alias("sources"))
    return n.withColumn("agreement", F.round(scores.agreement(F.col("sources")), 9))


@query("confidence", "SELECT vec_id, round(pow(abs(embedding[1])::DOUBLE / 4 % 1, 0.5) * pow(0.5::DOUBLE, 0.3) * pow(1.0::DOUBLE, 0.2), 6) AS confidence FROM embeddings")
def confidence(spark, sf_dir):
    r = F.abs(F.col("embedding")[0]).cast("double") / 4 % 1
    return kb.table(spark, sf_dir, "embeddings").select("vec_id", scores.confidence(r, scores.agreement(F.lit(1)), F.lit(1.0)).alias("confidence"))


def _claims(spark, sf_dir):
    d = kb.documents(spark, sf_dir)
    return d.select(
        F.col("container").alias("query"), F.col("document_id").alias("pos"), F.concat(F.lit("Status "), F.col("document_id") % 3).alias("text"), F.concat(F.lit("Topic "), F.col("document_id") % 40).alias("heading_path"),
        "source_type", "document_id", F.col("document_id").alias("chunk_id"), F.when(F.col("document_id") % 13 != 0, F.col("source_uri")).alias("source_uri"), "source_updated_at", (F.col("document_id") % 10 / 10).alias("retrieval_score"),
    )


_GRADED = f"""c AS (
  SELECT container AS query, document_id AS pos, 'status ' || (document_id % 3) AS value, 'topic ' || (document_id % 40) AS subject, source_type, document_id, document_id % 13 <> 0 AS ok, source_updated_at,
    (document_id % 10) / 10.0::DOUBLE AS s FROM kb_documents
), m AS (SELECT *, min(s) OVER (PARTITION BY query) AS lo, max(s) OVER (PARTITION BY query) AS hi FROM c
), n AS (SELECT *, CASE WHEN hi <= lo THEN 1.0::DOUBLE ELSE (s - lo) / (hi - lo) END AS r FROM m
), g AS (
  SELECT query, CASE WHEN ok THEN subject ELSE 'unknown: ' || pos END AS k, ok, min(pos) AS first_pos, max(r) AS r, max(source_updated_at) AS updated, count(DISTINCT (source_type, document_id)) AS n_sources, count(DISTINCT value) AS n_values FROM n GROUP BY ALL
), v AS (
  SELECT *, round(pow(r, 0.5) * pow(n_sources / (1.0::DOUBLE + n_sources), 0.3) * pow(CASE WHEN round(epoch(TIMESTAMP '{NOW}' - updated) / 3600.0, 1) <= 2160 THEN 1.0 ELSE greatest(0.25, 2160 / round(epoch(TIMESTAMP '{NOW}' - updated) / 3600.0, 1)) END::DOUBLE, 0.2), 6) AS sure FROM g
), t AS (
  SELECT query, first_pos, CASE WHEN NOT ok THEN 'UNKNOWN' WHEN n_values >= 2 AND n_sources >= 2 THEN 'CONFLICT' WHEN sure >= 0.6 THEN 'FACT' ELSE 'LOW_CONFIDENCE' END AS verdict,
    CASE WHEN ok AND NOT (n_values >= 2 AND n_sources >= 2) THEN sure END AS confidence FROM v
)"""


@query("graded_claims", f"{_GRADED} SELECT query, first_pos, verdict, confidence FROM t")
def graded_claims(spark, sf_dir):
    return grounding.graded(_claims(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("query", "first_pos", "verdict", "confidence")


@query("verdict_counts", f"{_GRADED} SELECT query, count(*) FILTER (verdict = 'FACT') AS fact, count(*) FILTER (verdict = 'LOW_CONFIDENCE') AS low_confidence, count(*) FILTER (verdict = 'CONFLICT') AS conflict, count(*) FILTER (verdict = 'UNKNOWN') AS unknown FROM t GROUP BY query")
def verdict_counts(spark, sf_dir):
    return evaluation.verdicts(grounding.graded(_claims(spark, sf_dir), F.lit(NOW).cast("timestamp")), ["query"])


@query("reconcile_values", "SELECT doc_id, quality AS snapshot_value, CASE WHEN doc_id % 5 <> 0 THEN (quality + (doc_id % 7 = 0)::INT) % 2 END AS live_value, CASE WHEN doc_id % 5 = 0 THEN 'LOW_CONFIDENCE' WHEN doc_id % 7 = 0 THEN 'CONFLICT' ELSE 'FACT' END AS verdict FROM labels")
def reconcile_values(spark, sf_dir):
    rows = kb.table(spark, sf_dir, "labels")
    live = rows.filter("doc_id % 5 <> 0").select("doc_id", ((F.col("quality") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)) % 2).alias("value"))
    return grounding.reconciled(rows.select("doc_id", F.col("quality").alias("value")), live, "doc_id")


@query("compress_budget", """RECURSIVE d AS (
  SELECT document_id, container, least(len(regexp_extract_all(text, '\\S+')), 512)::INT AS n, row_number() OVER (PARTITION BY container ORDER BY document_id) AS pos FROM kb_documents
), r AS (
  SELECT container, document_id, pos, n, n <= 2048 AS fits, CASE WHEN n <= 2048 THEN n ELSE 0 END AS used FROM d WHERE pos = 1
  UNION ALL SELECT d.container, d.document_id, d.pos, d.n, r.used + d.n <= 2048, CASE WHEN r.used + d.n <= 2048 THEN r.used + d.n ELSE r.used END FROM r JOIN d ON d.container = r.container AND d.pos = r.pos + 1
) SELECT container, document_id, n AS token_count FROM r WHERE fits""")
def compress_budget(spark, sf_dir):
    return grounding.compressed(kb.documents(spark, sf_dir).select("document_id", "container", "text"), [F.col("document_id")], "container", each=512, total=2048).select("container", "document_id", "token_count")


@query("rerank_fallback", f"{_SCORED} SELECT source_type, chunk_id, row_number() OVER (PARTITION BY source_type ORDER BY similarity DESC, chunk_id) AS place, 'disabled' AS rerank_status FROM s")
def rerank_fallback(spark, sf_dir):
    rows = _live(spark, sf_dir).withColumn("similarity", F.round(scores.cosine(F.col("embedding"), _vector(spark, sf_dir)), 6))
    return grounding.reranked(rows, "source_type", None, [F.col("similarity").desc(), F.col("chunk_id")]).select("source_type", "chunk_id", "place", "rerank_status")


# --------------------------------------------------------------------------- ingest

_CONFIG = hashlib.sha256(b'{"overlap": 32, "tokens": 256, "v": 1}').hexdigest()


def _stored(spark, sf_dir):
    """What an earlier run left: every third document's text was another, every fifth is new since."""
    d = kb.documents(spark, sf_dir).filter("document_id % 5 <> 0")
    return d.withColumn("text", F.when(F.col("document_id") % 3 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))).withColumn("content_hash", txt.content_hash(txt.redact_shapes(F.col("text"))[0])).withColumn("chunk_config", F.lit(_CONFIG)).drop("text")


@query("skip_unchanged", """SELECT document_id, CASE WHEN visibility <> 'team' THEN 'block' WHEN document_id % 5 = 0 THEN 'insert' WHEN document_id % 17 = 0 OR document_id % 3 = 0 THEN 'update' ELSE 'skip' END AS action FROM kb_documents""")
def skip_unchanged(spark, sf_dir):
    return ingest.compared(ingest.gated(kb.documents(spark, sf_dir).drop("deleted_at")), _stored(spark, sf_dir), _CONFIG).select("document_id", "action")


@query("upsert_snapshot", "SELECT document_id, CASE WHEN document_id % 3 = 0 OR document_id % 5 = 0 THEN 'new' ELSE 'kept' END AS state FROM kb_documents")
def upsert_snapshot(spark, sf_dir):
    d = kb.documents(spark, sf_dir)
    old = d.filter("document_id % 5 <> 0").withColumn("state", F.lit("kept"))
    new = d.filter("document_id % 3 = 0 OR document_id % 5 = 0").withColumn("state", F.lit("new"))
    return ingest.upserted(old, new).select("document_id", "state")


@query("cursor_advance", """SELECT strftime(greatest(CASE WHEN bool_or(document_id % 29 = 0) THEN min(CASE WHEN document_id % 29 = 0 THEN source_updated_at END) - INTERVAL 1 SECOND ELSE max(source_updated_at) END, TIMESTAMP '2024-01-01 06:00:00'), '%Y-%m-%d %H:%M:%S') AS "cursor" FROM kb_documents""")
def cursor_advance(spark, sf_dir):
    o = kb.documents(spark, sf_dir).select(F.col("source_updated_at").alias("updated_at"), (F.col("document_id") % 29 == 0).alias("failed"))
    return ingest.next_cursor(o, F.lit("2024-01-01 06:00:00").cast("timestamp")).select(F.date_format("cursor", "yyyy-MM-dd HH:mm:ss").alias("cursor"))


@query("reconcile_valve", "SELECT document_id, deleted_at IS NOT NULL OR document_id % 10 = 0 AS gone FROM kb_documents")
def reconcile_valve(spark, sf_dir):
    d = kb.documents(spark, sf_dir)
    return ingest.reconciled(d, d.filter("document_id % 10 <> 0"), F.lit(NOW).cast("timestamp")).select("document_id", F.col("deleted_at").isNotNull().alias("gone"))


@query("prune_report", "o AS (SELECT document_id FROM kb_documents WHERE deleted_at < TIMESTAMP '2024-01-20') SELECT count(DISTINCT o.document_id) AS documents, count(c.chunk_id) AS chunks, count(c.chunk_id) >= 1000 AS reindex FROM o LEFT JOIN kb_chunks c USING (document_id)")
def prune_report(spark, sf_dir):
    return ingest.prune_report(kb.documents(spark, sf_dir), kb.chunks(spark, sf_dir), F.lit("2024-01-20").cast("timestamp"))


@query("failure_upsert", """SELECT source_type, source_id, ((document_id % 6 = 0)::INT * 2 + (document_id % 4 = 0 AND document_id % 8 <> 0)::INT)::INT AS attempts, CASE WHEN document_id % 8 = 0 THEN 'policy' WHEN document_id % 4 = 0 THEN 'embed' ELSE 'chunk' END AS code FROM kb_documents WHERE (document_id % 6 = 0 OR document_id % 4 = 0) AND document_id % 9 <> 0""")
def failure_upsert(spark, sf_dir):
    d = kb.documents(spark, sf_dir)
    ledger = d.filter("document_id % 6 = 0").select("source_type", "source_id", F.lit(2).alias("attempts"), F.lit("chunk").alias("code"))
    failed = d.filter("document_id % 4 = 0").select("source_type", "source_id", F.when(F.col("document_id") % 8 == 0, "policy").otherwise("embed").alias("code"))
    return ingest.failures(ledger, failed, d.filter("document_id % 9 = 0"))


@query("run_rollup", "SELECT CASE WHEN bool_and(status = 'ok') THEN 'ok' WHEN bool_and(status = 'failed') THEN 'failed' ELSE 'partial' END AS status, CASE WHEN bool_and(status = 'ok') THEN 0 WHEN bool_and(status = 'failed') THEN 2 ELSE 1 END AS exit_code FROM kb_runs")
def run_rollup(spark, sf_dir):
    return ingest.rolled_up(kb.runs(spark, sf_dir))


# --------------------------------------------------------------------------- evaluation


def _judged(spark, sf_dir):
    """Each label is a query for its first vector's neighbours; vectors with the label are relevant."""
    e = kb.table(spark, sf_dir, "embeddings")
    results = e.select(F.col("vec_id").alias("item"), F.expr("(label + vec_id % 2) % 10").alias("query"), "label", "vec_id").withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.col("vec_id") % 7, "vec_id"))).select("query", "item", "rank")
    relevant = e.select(F.col("label").alias("query"), F.col("vec_id").alias("item"))
    return results, relevant


_JUDGED = """r AS (SELECT (label + vec_id % 2) % 10 AS query, vec_id AS item, row_number() OVER (PARTITION BY (label + vec_id % 2) % 10 ORDER BY vec_id % 7, vec_id) AS rank FROM embeddings),
v AS (SELECT label AS query, vec_id AS item FROM embeddings)"""


@query("recall_at_k", f"{_JUDGED} SELECT v.query, round(count(r.item) / count(*)::DOUBLE, 6) AS recall FROM v LEFT JOIN r ON v.query = r.query AND v.item = r.item AND r.rank <= 10 GROUP BY v.query")
def recall_at_k(spark, sf_dir):
    return evaluation.recall_at(*_judged(spark, sf_dir), 10)


@query("mrr", f"{_JUDGED} SELECT v.query, round(coalesce(1.0::DOUBLE / min(r.rank), 0), 6) AS rr FROM v LEFT JOIN r ON v.query = r.query AND v.item = r.item GROUP BY v.query")
def mrr(spark, sf_dir):
    return evaluation.reciprocal_rank(*_judged(spark, sf_dir))


@query("p95_nearest_rank", "SELECT level, quantile_disc(value, 0.95) AS quantile FROM kb_logs GROUP BY level")
def p95_nearest_rank(spark, sf_dir):
    return evaluation.nearest_rank(kb.logs(spark, sf_dir), "value", 0.95, ["level"])


# --------------------------------------------------------------------------- the whole of grounded search, and streams


_GROUNDED = rf"""RECURSIVE {_FUSED}, top50 AS (
  SELECT document_id, rrf_score FROM f ORDER BY rrf_score DESC, document_id LIMIT 50
), readable AS (
  SELECT t.rrf_score, d.*, regexp_extract_all(d.text, '\S+') AS words FROM top50 t JOIN kb_documents d USING (document_id)
  WHERE d.deleted_at IS NULL AND EXISTS (SELECT 1 FROM kb_grants g WHERE g.document_id = d.document_id AND g.principal IN ('u1', '*team*'))
), cut AS (
  SELECT * EXCLUDE (text), CASE WHEN len(words) <= 512 THEN text ELSE array_to_string(words[1:512], ' ') END AS text, least(len(words), 512)::INT AS n, row_number() OVER (ORDER BY rrf_score DESC, document_id) AS nth FROM readable
), budget AS (
  SELECT nth, n <= 2048 AS fits, CASE WHEN n <= 2048 THEN n ELSE 0 END AS used FROM cut WHERE nth = 1
  UNION ALL SELECT cut.nth, used + n <= 2048, CASE WHEN used + n <= 2048 THEN used + n ELSE used END FROM budget JOIN cut ON cut.nth = budget.nth + 1
), packed AS (
  SELECT cut.*, row_number() OVER (ORDER BY cut.nth) AS pos, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS subject, min(rrf_score) OVER () AS lo, max(rrf_score) OVER () AS hi FROM cut JOIN budget USING (nth) WHERE fits
), one AS (
  SELECT subject, min(pos) AS first_pos, arg_min(text, pos) AS text, max(CASE WHEN hi <= lo THEN 1.0::DOUBLE ELSE (rrf_score - lo) / (hi - lo) END) AS r, round(epoch(TIMESTAMP '{NOW}' - max(source_updated_at)) / 3600.0, 1)::DOUBLE AS age, count(DISTINCT (source_type, document_id)) AS n_sources FROM packed GROUP BY subject
), judged AS (
  SELECT *, round(pow(r, 0.5) * pow(n_sources / (1.0::DOUBLE + n_sources), 0.3) * pow(CASE WHEN age <= 2160 THEN 1.0::DOUBLE ELSE greatest(0.25::DOUBLE, 2160 / age) END, 0.2), 6) AS sure FROM one
)
SELECT 'q' AS query, first_pos::INT AS first_pos, text, CASE WHEN sure >= 0.6 THEN 'FACT' ELSE 'LOW_CONFIDENCE' END AS verdict, sure AS confidence, n_sources, 1::BIGINT AS n_values, NULL::VARCHAR AS positions, NULL::VARCHAR AS note FROM judged"""


@query("grounded_search", _GROUNDED)
def grounded_search(spark, sf_dir):
    """Hybrid retrieval, permission, compression and grading in one plan."""
    d = kb.documents(spark, sf_dir)
    fused = search.fuse(_legs(spark, sf_dir), "document_id", top=50)
    found = grounding.permitted(fused.join(d, "document_id"), kb.grants(spark, sf_dir), d, ["u1", "*team*"]).withColumn("query", F.lit("q"))
    packed = grounding.compressed(found, [F.col("rrf_score").desc(), F.col("document_id")], "query")
    claims = packed.select("query", F.row_number().over(W.partitionBy("query").orderBy(F.col("rrf_score").desc(), "document_id")).alias("pos"), "text", F.lit(None).cast("string").alias("heading_path"), "source_type", "document_id", F.col("document_id").alias("chunk_id"), "source_uri", "source_updated_at", F.col("rrf_score").alias("retrieval_score"))
    return grounding.graded(claims, F.lit(NOW).cast("timestamp"))


@query("streaming_window_dedup", """w AS (SELECT time_bucket(INTERVAL '1 day', ts) AS b, event_type AS level, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS window_start, level, n, total FROM w WHERE b + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def streaming_window_dedup(spark, sf_dir):
    """Closed windows of the events as a stream, each event once: those that the watermark, an hour behind the last event, has
    passed. Windows that are still open stay in the stream's state."""
    schema = kb.table(spark, sf_dir, "events").schema
    counted = windows.windowed_counts(windows.read_events(spark, f"{sf_dir}/events.parquet*", schema))
    return windows.run_once(counted)


@query("rate_limited_users", """RECURSIVE e AS (
  SELECT user_id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM kb_logs
), r AS (
  SELECT user_id, pos, t, 5.0::DOUBLE AS had FROM e WHERE pos = 1
  UNION ALL SELECT e.user_id, e.pos, e.t, least(5.0::DOUBLE, had - (had >= 1)::INT + greatest(0.0::DOUBLE, e.t - r.t) * (1.0::DOUBLE / 3600)) FROM r JOIN e ON e.user_id = r.user_id AND e.pos = r.pos + 1
) SELECT user_id, count(*) FILTER (had >= 1) AS allowed, count(*) FILTER (had < 1) AS refused, max(CASE WHEN had >= 1 THEN 0 ELSE ceil((1 - had) / (1.0::DOUBLE / 3600)) END)::INT AS longest_wait FROM r GROUP BY user_id""")
def rate_limited_users(spark, sf_dir):
    e = kb.logs(spark, sf_dir).select("event_id", "ts", "user_id")
    return windows.rate_limited(e, "user_id", 5.0, 1 / 3600).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"), F.max("retry_after").alias("longest_wait"))
