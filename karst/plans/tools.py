"""Queries of the source systems' read operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from karst.operators import tools
from karst.sources import tables as kb

from .registry import query


@query("index_families", r"""n AS (SELECT CASE event_id % 3 WHEN 0 THEN '.ds-logs-' || event_type || '-2024.01.0' || (event_id % 9 + 1) || '-00000' || (event_id % 7) WHEN 1 THEN 'logs-' || event_type || '-00000' || (event_id % 7) ELSE 'logs-' || event_type || '-2024.01' END AS name FROM events)
SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '^\.ds-', ''), '-\d{6}$', ''), '-\d{4}[.\-]\d{2}([.\-]\d{2})?$', ''), '-\d{6}$', '') AS family, count(*) AS n FROM n GROUP BY 1""")
def index_families(spark, sf_dir):
    e, i = kb.table(spark, sf_dir, "events"), F.col("event_id")
    name = (
        F.when(i % 3 == 0, F.concat(F.lit(".ds-logs-"), "event_type", F.lit("-2024.01.0"), i % 9 + 1, F.lit("-00000"), i % 7))
        .when(i % 3 == 1, F.concat(F.lit("logs-"), "event_type", F.lit("-00000"), i % 7))
        .otherwise(F.concat(F.lit("logs-"), "event_type", F.lit("-2024.01")))
    )
    return e.groupBy(tools.index_family(name).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("default_deny", "SELECT document_id, coalesce(visibility = 'team' AND deleted_at IS NULL AND nullif(document_id % 4, 3) < 3, false) AS passes FROM kb_documents")
def default_deny(spark, sf_dir):
    known = F.nullif(F.col("document_id") % 4, F.lit(3)) < 3
    return kb.documents(spark, sf_dir).select("document_id", tools.all_known_true(F.col("visibility") == "team", F.col("deleted_at").isNull(), known).alias("passes"))


@query("ancestor_restriction", "SELECT container, CASE WHEN count(*) > count(r) THEN NULL ELSE bool_or(r) END AS restricted FROM (SELECT container, CASE WHEN document_id % 97 <> 5 THEN visibility = 'restricted' END AS r FROM kb_documents) GROUP BY container")
def ancestor_restriction(spark, sf_dir):
    d = kb.documents(spark, sf_dir).select("container", F.when(F.col("document_id") % 97 != 5, F.col("visibility") == "restricted").alias("r"))
    return tools.restricted_by_ancestors(d, "container", "r")


@query("egress_hosts", r"""SELECT page_id, regexp_matches(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)', 1)), '^.*1\..*$') AS allowed FROM pages""")
def egress_hosts(spark, sf_dir):
    return kb.table(spark, sf_dir, "pages").select("page_id", tools.host_allowed(F.col("url"), ["*1.*"]).alias("allowed"))


@query("truncate_bytes", "SELECT document_id, CASE WHEN strlen(text) <= 100 THEN text ELSE left(text, list_max(list_filter(range(0, 101), lambda n: strlen(left(text, n)) <= 100))) END AS beginning FROM kb_documents")
def truncate_bytes(spark, sf_dir):
    return kb.documents(spark, sf_dir).select("document_id", tools.truncated(F.col("text"), 100).alias("beginning"))


@query("decode_values", "SELECT document_id, 'utf8' AS format, text FROM kb_documents WHERE document_id % 2 = 0 UNION ALL SELECT document_id, 'base64', 'base64:' || to_base64(unhex('FF' || sha256(text))) FROM kb_documents WHERE document_id % 2 = 1")
def decode_values(spark, sf_dir):
    value = F.when(F.col("document_id") % 2 == 0, F.col("text").cast("binary")).otherwise(F.unhex(F.concat(F.lit("FF"), F.sha2("text", 256))))
    return kb.documents(spark, sf_dir).select("document_id", tools.decoded(value).alias("v")).select("document_id", "v.*")


@query("decode_cut_values", """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'json' ELSE 'utf8' END AS format,
  CASE turn % 3 WHEN 0 THEN '{"role":"' || role || '","turn":' || turn || '}' WHEN 1 THEN text ELSE '"' || turn || '"' END AS text FROM conversations""")
def decode_cut_values(spark, sf_dir):
    """Objects, texts that end in two bytes of a character of three, and a JSON value that is no object."""
    t = F.col("turn")
    cut = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("E282")))
    value = F.when(t % 3 == 0, F.to_json(F.struct("role", "turn")).cast("binary")).when(t % 3 == 1, cut).otherwise(F.concat(F.lit('"'), t, F.lit('"')).cast("binary"))
    return kb.table(spark, sf_dir, "conversations").select("conv_id", "turn", tools.decoded(value, partial=True).alias("v")).select("conv_id", "turn", "v.*")


@query("wrapped_texts", """SELECT item_id, '<untrusted-content source="bench" id="' || item_id || '">' || chr(10) || text || chr(10) || '</untrusted-content>' AS framed FROM benchmark""")
def wrapped_texts(spark, sf_dir):
    return kb.table(spark, sf_dir, "benchmark").select("item_id", tools.wrapped(F.col("text"), F.lit("bench"), F.col("item_id")).alias("framed"))


@query("saved_object_search", "SELECT document_id, title FROM kb_documents WHERE title LIKE 'Document 1%' OR container LIKE 'src1%' ORDER BY title, document_id LIMIT 50")
def saved_object_search(spark, sf_dir):
    found = F.col("title").startswith("Document 1") | F.col("container").startswith("src1")
    return kb.documents(spark, sf_dir).filter(found).select("document_id", "title").orderBy("title", "document_id").limit(50)


@query("dashboard_links", """SELECT document_id, 'https://dash.example/#/view/' || document_id || '?_a=(q:''' || regexp_replace(container || '!''', '([!''])', '!\\1', 'g') || ''')' AS link FROM kb_documents""")
def dashboard_links(spark, sf_dir):
    state = tools.quoted(F.concat("container", F.lit("!'")))
    return kb.documents(spark, sf_dir).select("document_id", F.concat(F.lit("https://dash.example/#/view/"), "document_id", F.lit("?_a=(q:"), state, F.lit(")")).alias("link"))


@query("key_page", "SELECT DISTINCT 'user:' || user_id || ':' || event_type AS key FROM events WHERE 'user:' || user_id || ':' || event_type > 'user:11' AND event_type <> 'error' ORDER BY key LIMIT 40")
def key_page(spark, sf_dir):
    rows = kb.table(spark, sf_dir, "events").select(F.concat(F.lit("user:"), "user_id", F.lit(":"), "event_type").alias("key"))
    return tools.keys(rows, "key", "user:*", deny=["*:error"], after="user:11", limit=40)


@query("redrive_sources", "q AS (SELECT DISTINCT user_id AS queue, user_id // 3 AS target FROM events) SELECT a.queue, b.queue AS dead_letter FROM q a JOIN q b ON a.target = b.queue")
def redrive_sources(spark, sf_dir):
    q = kb.table(spark, sf_dir, "events").select(F.col("user_id").alias("queue"), F.floor(F.col("user_id") / 3).alias("target")).distinct()
    return tools.redrive_sources(q, "target")


@query("last_three_per_user", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_type = 'click' QUALIFY place <= 3")
def last_three_per_user(spark, sf_dir):
    e = kb.table(spark, sf_dir, "events").filter("event_type = 'click'")
    return tools.newest(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 3).select("user_id", "event_id", "place")


@query("threads", "SELECT conv_id, count(*) AS n, string_agg(turn || '=' || role, ',' ORDER BY turn) FILTER (p <= 3) AS notes FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY conv_id")
def threads(spark, sf_dir):
    t = tools.threads(kb.table(spark, sf_dir, "conversations"), "conv_id", "turn", ["turn", "role"], 3)
    return t.select("conv_id", "n", F.array_join(F.transform("notes", lambda x: F.concat(x["turn"].cast("string"), F.lit("="), x["role"])), ",").alias("notes"))


@query("byte_budget", "u AS (SELECT container, document_id, strlen(text) AS size, coalesce(sum(strlen(text)) OVER (PARTITION BY container ORDER BY document_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM kb_documents) SELECT container, document_id, used + size > 20000 AS cut, least(size, 20000 - used)::BIGINT AS room FROM u WHERE used < 20000")
def byte_budget(spark, sf_dir):
    return tools.byte_budget(kb.documents(spark, sf_dir), "container", [F.col("document_id")], "text", 20000).select("container", "document_id", "cut", "room")


@query("metric_list", "SELECT DISTINCT 'app/' || event_type AS namespace, 'service' || (user_id % 5) AS dimension FROM events WHERE event_type LIKE 'p%'")
def metric_list(spark, sf_dir):
    e = kb.logs(spark, sf_dir).filter(F.col("level").startswith("p"))
    return e.select(F.concat(F.lit("app/"), "level").alias("namespace"), F.col("service").alias("dimension")).distinct()


@query("alarm_history", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM kb_logs WHERE level = 'error' AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 30")
def alarm_history(spark, sf_dir):
    from karst.operators import events

    found = events.between(kb.logs(spark, sf_dir).filter("level = 'error'"), "2024-01-03", "2024-01-20")
    return found.orderBy(F.col("ts").desc(), "event_id").limit(30).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
