import pytest
from karst.operators import ingest
from karst.sources import snapshots
from karst.sources.shared import new_folder
from pyspark.sql import functions as F

CRAWL = "source_type string, source_id string, document_id long, source_uri string, visibility string, text string, updated_at timestamp"


def crawl(spark, rows):
    return spark.createDataFrame([("wiki", f"s{i}", i, f"https://x/{i}", v, t, None) for i, v, t in rows], CRAWL).withColumn("updated_at", F.timestamp_seconds(F.col("document_id") * 3600))


def lines(changed):
    return changed.select("document_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))


def state(store, version=None):
    return {t: sorted(map(str, store.read(t, version).collect())) for t in ("documents", "chunks", "failures", "cursors")}


@pytest.fixture
def store(spark):
    return snapshots.Store(spark, new_folder(spark, "t"))


def test_runs_and_versions(spark, store):
    assert store.version() == 0
    ingest.run(store, crawl(spark, [(1, "team", "a\nb"), (2, "team", "c"), (3, "restricted", "d"), (None, None, None)]), lines, "v1")
    first = state(store)
    assert len(first["documents"]) == 2 and len(first["chunks"]) == 3 and len(first["failures"]) == 2
    ingest.run(store, crawl(spark, [(1, "team", "a\nb"), (2, "team", "changed"), (2, "team", "changed"), (4, "team", ""), (3, "team", "free now")]), lines, "v1")
    assert store.versions() == [1, 2] and state(store, 1) == first
    second = state(store)
    assert len(second["documents"]) == 4 and len(second["failures"]) == 1 and {r.content for r in store.read("chunks").collect()} == {"a", "b", "changed", "", "free now"}
    assert ingest.run(store, crawl(spark, [(9, "team", "x")]), lines, "v1", dry=True) == 2 and state(store) == second
    ingest.run(store, crawl(spark, []), lines, "v1")
    assert state(store) == second


@pytest.mark.parametrize("lost", ["actions", "documents", "chunks", "failures", "cursors", "version"])
def test_a_lost_run_leaves_the_old_version_whole(spark, store, monkeypatch, lost):
    ingest.run(store, crawl(spark, [(1, "team", "a")]), lines, "v1")
    before = state(store)
    write, create = snapshots.Stage.write, snapshots.Stage._create

    def failing(self, table, df):
        if table == lost:
            raise OSError("lost")
        return write(self, table, df)

    def uncreated(self, version, text):
        raise OSError("lost")

    monkeypatch.setattr(snapshots.Stage, "write", failing)
    if lost == "version":
        monkeypatch.setattr(snapshots.Stage, "_create", uncreated)
    with pytest.raises(OSError):
        ingest.run(store, crawl(spark, [(1, "team", "new"), (2, "team", "b")]), lines, "v1")
    assert store.version() == 1 and state(store) == before
    monkeypatch.setattr(snapshots.Stage, "write", write)
    monkeypatch.setattr(snapshots.Stage, "_create", create)
    ingest.run(store, crawl(spark, [(1, "team", "new"), (2, "team", "b")]), lines, "v1")
    assert store.version() == 2 and {r.content for r in store.read("chunks").collect()} == {"new", "b"}
    assert state(store, 1) == before


def test_the_second_of_two_commits_on_one_version_is_refused(spark, store):
    df = spark.range(3)
    a, b = store.stage(), store.stage()
    a.write("t", df)
    b.write("t", df.filter("id > 0"))
    assert a.commit() == 1
    with pytest.raises(snapshots.Conflict):
        b.commit()
    assert store.versions() == [1] and store.read("t").count() == 3
    with pytest.raises(KeyError):
        store.read("u")
    assert store.read("u", empty="x int").count() == 0


def test_vacuum(spark, store):
    for n in range(4):
        store.commit({"t": spark.range(n)} | ({"u": spark.range(1)} if n == 0 else {}))
    lost = store.stage()
    lost.write("t", spark.range(9))
    assert store.vacuum(keep=2, older_s=3600) == 0  # nothing is old enough
    assert store.vacuum(keep=2, older_s=0) == 2  # what a lost run wrote, and version 2's; u of version 1 is still named
    assert store.versions() == [3, 4] and store.read("t", 3).count() == 2 and store.read("u").count() == 1
