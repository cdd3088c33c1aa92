"""Invariants of the operators."""

import random

import pytest
from karst.operators import events, graph, grounding, ingest, search
from karst.streaming import windows
from pyspark.sql import functions as F

NOW = "2024-03-01 00:00:00"
CLAIM = "query string, pos int, text string, heading_path string, source_type string, document_id string, chunk_id int, source_uri string, source_updated_at timestamp, retrieval_score double"


def graded(spark, rows):
    df = spark.createDataFrame([(*r[:8], None, r[8]) for r in rows], CLAIM)
    return {r.first_pos: r for r in grounding.graded(df, F.lit(NOW).cast("timestamp")).collect()}


def test_verdicts(spark):
    rows = [
        ("q", 1, "open", "State", "jira", "d1", 1, "u", 1.0),
        ("q", 2, "closed", " state ", "gitlab", "d2", 1, "u", 0.9),
        ("q", 3, "fine", None, "jira", "d3", 1, "", 1.0),
        ("q", 4, "alone", None, "jira", "d4", 1, "u", 0.0),
        ("q", 5, "same", "Topic", "jira", "d5", 1, "u", 1.0),
        ("q", 6, "Same ", "Topic", "gitlab", "d6", 1, "u", 0.8),
        ("q", 7, "one", "Own", "jira", "d7", 1, "u", 1.0),
        ("q", 8, "two", "Own", "jira", "d7", 2, "u", 1.0),
    ]
    got = graded(spark, rows)
    assert {k: r.verdict for k, r in got.items()} == {1: "CONFLICT", 3: "UNKNOWN", 4: "LOW_CONFIDENCE", 5: "FACT", 7: "FACT"}
    assert got[1].positions == "closed | open" and got[1].confidence is None and got[3].confidence is None and got[4].confidence == 0
    assert got[7].n_values == 2 and got[7].n_sources == 1  # one source can't contradict itself


def test_nobody_reads_without_a_grant(spark):
    docs = spark.createDataFrame([(1, None), (2, None), (3, NOW)], "document_id long, deleted_at string")
    grants = spark.createDataFrame([(1, "a"), (3, "a")], "document_id long, principal string")
    ids = lambda who: {r.document_id for r in grounding.permitted(docs, grants, docs, who).collect()}
    assert ids(["a"]) == {1} and ids([]) == set() and ids(["b"]) == set()


def test_budget_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([("q", i, " ".join(["w"] * n)) for i, n in enumerate([5, 9, 4, 1])], "query string, pos int, text string")
    assert [r.pos for r in grounding.compressed(rows, [F.col("pos")], "query", each=8, total=10).orderBy("pos").collect()] == [0, 2, 3]


def test_fusion_does_not_depend_on_order(spark):
    rows = [(k, leg, rank) for leg in "ab" for rank, k in enumerate(random.Random(leg).sample(range(20), 10), 1)]
    score = lambda r: [tuple(x) for x in search.fuse(spark.createDataFrame(r, "id int, leg string, rank int"), "id", top=20).collect()]
    assert score(rows) == score(rows[::-1])
    with pytest.raises(ValueError):
        search.fuse(spark.createDataFrame(rows, "id int, leg string, rank int"), "id", k=0)


def test_walks(spark):
    e = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("x", "y"), ("y", "x")] + [("hub", f"n{i:03}") for i in range(300)]
    edges = spark.createDataFrame([(a, b, "r") for a, b in e], "src string, dst string, rel_type string")
    got = [(r.depth, r.src, r.dst) for r in graph.walk(edges, ["a"]).collect()]
    assert got == [(1, "a", "b"), (1, "a", "c"), (2, "b", "d"), (2, "c", "d")]
    assert [(r.depth, r.dst) for r in graph.walk(edges, ["x"]).collect()] == [(1, "y")]
    assert graph.walk(edges, ["hub"]).count() == 200 and graph.walk(edges, ["alone"]).count() == 0
    with pytest.raises(ValueError):
        graph.walk(edges, ["a"], depth=4)


def crawl(spark, rows):
    return spark.createDataFrame([("wiki", str(i), t, v, f"https://w/{i}") for i, t, v in rows], "source_type string, source_id string, text string, visibility string, source_uri string")


def test_ingest_again_changes_nothing(spark):
    pulled = ingest.gated(crawl(spark, [(1, "a", "team"), (2, "password: hunter22", "team"), (3, "c", "restricted")]), ["*/9"])
    got = {r.source_id: r for r in pulled.collect()}
    assert got["3"].blocked == "restricted" and got["3"].text is None and got["2"].redactions == 1
    empty = pulled.select("source_type", "source_id", "content_hash", F.lit("k").alias("chunk_config"), F.lit(None).cast("timestamp").alias("deleted_at")).filter("false")
    first = ingest.compared(pulled, empty, "k")
    assert {r.source_id: r.action for r in first.collect()} == {"1": "insert", "2": "insert", "3": "block"}
    stored = ingest.upserted(empty, first.filter("action != 'block'").withColumn("chunk_config", F.lit("k")).withColumn("deleted_at", F.lit(None).cast("timestamp")))
    assert {r.action for r in ingest.compared(pulled, stored, "k").collect()} == {"skip", "block"}
    assert {r.action for r in ingest.compared(pulled, stored, "other").collect()} == {"update", "block"}


def test_valve_and_cursor(spark):
    stored = spark.createDataFrame([("w", str(i), None) for i in range(10)], "source_type string, source_id string, deleted_at timestamp")
    gone = lambda n, **o: ingest.reconciled(stored, stored.filter(F.col("source_id") < str(n)), F.lit(NOW).cast("timestamp"), **o).filter("deleted_at IS NOT NULL").count()
    assert gone(8) == 2 and gone(7) == 0 and gone(9, complete=False) == 0
    old = F.lit("2024-01-05").cast("timestamp")
    def cursor(rows):
        df = spark.createDataFrame(rows, "t string, failed boolean").select(F.col("t").cast("timestamp").alias("updated_at"), "failed")
        return str(ingest.next_cursor(df, old).first().cursor)
    assert cursor([("2024-01-10", False), ("2024-01-08", False)]) == "2024-01-10 00:00:00"
    assert cursor([("2024-01-10", False), ("2024-01-08", True)]) == "2024-01-07 23:59:59"
    assert cursor([("2024-01-10", False), (None, True)]) == cursor([("2024-01-02", False)]) == cursor([]) == "2024-01-05 00:00:00"


def test_pages_follow_each_other(spark):
    rows = spark.createDataFrame([(i, f"2024-01-0{i % 3 + 1}") for i in range(10)], "event_id int, t string").select("event_id", F.col("t").cast("timestamp").alias("ts"))
    seen, after = [], None
    while True:
        page = events.page(rows, 3, after, "q").collect()
        seen += [r.event_id for r in page[:3]]
        if len(page) <= 3:
            break
        after = events.cursor(str(page[2].ts), page[2].event_id, "q")
    assert seen == [2, 5, 8, 1, 4, 7, 0, 3, 6, 9]
    with pytest.raises(ValueError):
        events.page(rows, 3, events.cursor("2024-01-01", 1, "other"), "q")


def test_token_bucket(spark):
    rows = spark.createDataFrame([(i, t, "k") for i, t in enumerate([0, 0, 0, 10, 100])], "event_id int, s int, key string").select("event_id", F.timestamp_seconds("s").alias("ts"), "key")
    got = windows.rate_limited(rows, "key", 2.0, 0.1).orderBy("event_id").collect()
    assert [r.allowed for r in got] == [True, True, False, True, True] and got[2].retry_after == 10


def test_streamed_snapshots(spark, tmp_path):
    schema = "id int, v string, at int"
    for i, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(2, "c", 2), (3, "d", 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    windows.upsert_batches(stream, f"{tmp_path}/out", f"{tmp_path}/ck", ["id"], "at").start().awaitTermination(120)
    last = max(int(p.name) for p in (tmp_path / "out").iterdir())
    assert sorted((r.id, r.v) for r in spark.read.parquet(f"{tmp_path}/out/{last}").collect()) == [(1, "a"), (2, "c"), (3, "d")]
