import hashlib
from collections import Counter

import numpy as np
import pytest
from karst.operators import embedding, envelopes
from karst.plans import queries as plans  # noqa: F401
from karst.plans.registry import QUERIES
from karst.sources.shared import new_folder
from karst.sources.snapshots import Store
from pyspark.sql import functions as F

CHUNKS = "chunk_id long, document_id long, heading_path string, content string, embedding array<float>, embedding_model string"


@pytest.fixture
def store(spark):
    made = Store(spark, new_folder(spark, "t"))
    rows = [(i, i % 3, "h" if i % 2 else None, f"text {i}", [1.0] * 4 if i % 5 == 0 else None, "old" if i % 5 == 0 else None) for i in range(60)]
    made.commit({"chunks": spark.createDataFrame(rows, CHUNKS)})
    return made


def counting(folder, model_id="m", size=4, **options):
    """A provider that notes every load and every batch in a folder."""

    def load():
        import os
        import uuid

        open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def run(texts):
            open(f"{folder}/batch-{len(texts)}-{uuid.uuid4().hex}", "w").close()
            return np.array([[len(t), t.count("p:"), t.count("q:"), 1.0][:size] for t in texts])

        return run

    return embedding.Provider(model_id, size, load, query_prefix="q:", passage_prefix="p:", **options)


def test_batches_prefixes_and_one_model_a_worker(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}" if i % 10 else None) for i in range(200)], "id int, t string").withColumn("embedding", F.lit("x")).repartition(2)
    provider = counting(str(tmp_path), model_id=f"m-{tmp_path}", normalize=False)
    got = embedding.embedded(rows, F.col("t"), provider, batch=16).collect()
    assert len(got) == 200 and all((r.embedding is None) == (r.id % 10 == 0) for r in got)
    assert all(r.embedding[0] == len(f"p:t{r.id}") and r.embedding[1] == 1 for r in got if r.embedding)
    names = [p.name for p in tmp_path.iterdir()]
    workers = [n.split("-")[1] for n in names if n.startswith("load")]
    assert len(workers) == len(set(workers)) and max(int(n.split("-")[1]) for n in names if n.startswith("batch")) <= 16
    assert embedding.query_vector(provider, "x")[2] == 1


def test_long_texts(spark, tmp_path):
    text = " ".join(["a"] * 10)
    make = lambda long: counting(str(tmp_path), model_id=f"{long}-{tmp_path}", normalize=False, max_words=4, long=long)
    assert embedding.vectors(make("cut"), [text], "")[0][0] == 7 and embedding.vectors(make("mean"), [text], "")[0][0] == (7 + 7 + 3) / 3
    with pytest.raises(ValueError, match="10 words"):
        embedding.vectors(make("refuse"), [text], "")
    with pytest.raises(ValueError, match="gave 3 numbers"):
        embedding.vectors(embedding.Provider(f"w-{tmp_path}", 4, lambda: lambda ts: np.ones((len(ts), 3))), ["x"], "")


def test_reembedding_goes_on_where_it_stopped(spark, store, tmp_path):
    provider = counting(str(tmp_path), model_id=f"new-{tmp_path}")
    live = spark.createDataFrame([(0,), (1,), (1,)], "document_id long")
    batches = lambda: sum(int(p.name.split("-")[1]) for p in tmp_path.iterdir() if p.name.startswith("batch"))
    assert embedding.reembed(store, provider, live, parts=5, most=2) == {"written": 2, "found": 0, "version": 1}
    first = batches()
    assert 0 < first < 40 and {r.embedding_model for r in store.read("chunks").collect()} == {"old", None}  # nothing is visible yet
    assert embedding.reembed(store, provider, live, parts=5) == {"written": 3, "found": 2, "version": 2}
    assert batches() == 40  # each text once
    assert embedding.reembed(store, provider, live, parts=5) == {"written": 0, "found": 0, "version": 2} and batches() == 40
    rows = store.read("chunks").collect()
    assert len(rows) == 60 and all((r.embedding_model == provider.model_id) == (r.document_id < 2) for r in rows)
    with pytest.raises(Exception, match="re-embed it first"):
        embedding.serving(store.read("chunks"), provider.model_id, 4).count()
    assert embedding.serving(store.read("chunks").filter("document_id < 2"), provider.model_id, 4).count() == 40
    with pytest.raises(Exception, match="width 4"):
        embedding.serving(store.read("chunks").filter("document_id < 2"), provider.model_id, 5).count()


RESULTS = "call int, status string, returned long, has_more boolean, next_cursor string"
GOOD = [(1, "ok", 2, True, "c"), (2, "empty", 0, False, None), (3, "partial", 0, False, None)]
ITEMS, CITED = [(1, 0), (1, 1)], [(1, "gitlab", "u", None), (1, "logs", None, None), (3, "logs", None, "group and window")]


@pytest.mark.parametrize(
    "rule,results,items,citations",
    [
        (0, GOOD, ITEMS, CITED), (1, [(4, "ok", 0, False, None)], [], []), (2, [(4, "not_found", 1, False, None)], [(4, 0)], [(4, "logs", None, None)]), (3, [(4, "ok", 0, True, "")], [], [(4, "logs", None, None)]),
        (4, [(4, "ok", 1, False, None)], [(4, 1)], [(4, "logs", None, None)]), (4, [(4, "ok", 1, False, None)], [(4, -1)], [(4, "logs", None, None)]), (4, [(4, "ok", 1, False, None)], [(4, None)], [(4, "logs", None, None)]),
        (5, [(4, "ok", 3, False, None)], [(4, 0)], [(4, "logs", None, None)]), (6, [(4, "ok", 0, False, None)], [], [(4, "confluence", " ", None)]), (7, [(4, "partial", 0, False, None)], [], [(4, "logs", None, None)]),
    ],
)
def test_envelope_rules(spark, rule, results, items, citations):
    tables = spark.createDataFrame(results, RESULTS), spark.createDataFrame(items, "call int, citation_ref int"), spark.createDataFrame(citations, "call int, source_type string, uri string, scope string")
    found = envelopes.violations(*tables).collect()
    assert {i for r in found for i in range(1, 8) if r[f"rule{i}"]} == ({rule} if rule else set())
    if rule:
        with pytest.raises(Exception, match=envelopes.RULES[rule - 1]):
            envelopes.enforced(*tables).collect()
    else:
        assert sorted(r.call for r in envelopes.enforced(*tables).collect()) == [1, 2, 3]


def test_buckets_of_words_shuffle_counts_only(spark):
    """Words were shuffled with their documents before they were hashed."""
    rows = [(1, ["a", "b", "a"]), (2, None), (3, []), (1, ["a"]), (None, ["a", "é"])]
    found = embedding.word_buckets(spark.createDataFrame(rows, "id long, w array<string>"), "id", F.col("w"))
    want = Counter((i, int(hashlib.sha256(x.encode()).hexdigest()[:8], 16) % 64) for i, w in rows for x in w or [])
    assert {(r.id, r.bucket): r.n for r in found.collect()} == want
    assert embedding.word_buckets(spark.createDataFrame([], "id long, w array<string>"), "id", F.col("w")).collect() == []
    plan = QUERIES["hash_bucket_embedding"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "word" not in plan.split("Exchange hashpartitioning(")[1].split(")")[0]
