import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from karst.llm import mixing, sharding
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_mix_equals_its_sql(spark, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(mixing.SQL).fetchall()
    got = mixing.digest(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert mixing.digest(no_docs).collect() == []


def test_mix_of_odd_rows(odd_docs):
    got = mixing.digest(odd_docs).collect()
    assert len(got) == odd_docs.count()
    total, share = sum(r["size"] for r in got), defaultdict(lambda: [0, 0.0, 0, 0])
    for r in got:
        assert r.taken in (0, r["size"], 2 * r["size"]) and 0 <= r.target <= 2 * r.source_size + 1e-6
        share[r.source_size, r.target][0] += r.taken
        share[r.source_size, r.target][2] = max(share[r.source_size, r.target][2], r["size"])
    assert abs(sum(t for _, t in share) - 1.5 * total) < 1e-6
    assert all(abs(taken - target) <= largest + 1 for (_, target), (taken, _, largest, _) in share.items())
    assert sorted(map(str, got)) == sorted(map(str, mixing.digest(odd_docs.repartition(7)).collect()))
    emitted = mixing.mix(odd_docs)
    assert emitted.columns == odd_docs.columns
    assert sum(len((r.text or "").split()) for r in emitted.collect()) == pytest.approx(sum(r.taken for r in got), rel=0.01)


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100), ("d", 1), (None, 10), ("z", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    left, caps, w = 1.5 * 311, {"a": 200, "b": 200, "c": 200, "d": 2, "z": 0, None: 20}, {"a": 5, "b": 2, "c": 1, "d": 5, "z": 2, None: 1}
    want, open_ = {}, set(caps)
    while True:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > caps[s]}
        if not over:
            break
        for s in over:
            want[s] = caps[s]
            left -= caps[s]
        open_ -= over
    want |= {s: w[s] * level for s in open_}
    assert got == pytest.approx(want)


def test_shards(spark, odd_docs, no_docs):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("é").alias("text"))
    got = sharding.digest(docs).collect()
    by = Counter(r.shard for r in got)
    assert set(by) == set(range(40)) and max(by.values()) < 1.3 * min(by.values())
    moved = [r for r in got if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {40} and 0.6 < len(moved) / (20000 / 41) < 1.4
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r["size"] == 18
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.digest(no_docs).collect() == []
    rows = sharding.digest(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r.law for r in rows} == {"key"}
    assert len({r.shard for r in rows if r.doc_id is None}) == 1


def drawn(key, nodes):
    """The shard of a key by the rule itself: at each node the child with the least -ln(u) / weight."""

    key, path = "" if key is None else key, ""
    while isinstance(nodes, dict):
        by = {}
        for name, below in nodes.items():
            u = (int(hashlib.md5(f"{key}{path}/{name}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            by[-math.log(u) / sharding.total(below)] = name
        won = by[min(by)]
        nodes, path = nodes[won], f"{path}/{won}"
    return won


def test_shards_against_the_rule(odd_docs):
    tree = sharding.tree(40)
    rows = odd_docs.select("doc_id", "text").collect()
    want = []
    for r in rows:
        key, raw = None if r.doc_id is None else str(r.doc_id), (r.text or "").encode()
        want.append((key, len(raw) + 16, zlib.crc32(raw), drawn(key, tree), drawn(key, sharding.grown(tree))))
    got = sharding.digest(odd_docs).collect()
    assert sorted(map(str, want)) == sorted(str((None if r.doc_id is None else str(r.doc_id), r["size"], r.text_crc32, r.shard, r.grown_shard)) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_equal_their_sql(spark, odd_docs, no_docs):
    columns = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    con = duckdb.connect()
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs, no_docs):
        con.register("documents", docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).toArrow())
        want = con.execute(sharding.SQL).fetchall()
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in sharding.digest(docs).select(*columns).collect())


def test_a_doc_id_that_many_rows_share_is_spread(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("s").alias("source"))
    assert sorted(r.slot for r in sharding.digest(docs).collect()) == list(range(4000))
    block = F.floor(F.conv(F.substring(F.md5(F.concat(F.lit(":"), F.crc32("text")).cast("binary")), 1, 8), 16, 10).cast("long") * 8 / F.lit(1 << 32))
    assert docs.groupBy(block).count().count() == 8
    got = mixing.digest(docs).collect()
    assert len(got) == 4000 and abs(sum(r.taken for r in got) - 12000) <= 2


def test_weights_and_confined_movement(spark):
    keys = spark.range(30000).select(F.col("id").alias("doc_id"))
    old = {"r0": {"a": {0: 1.0, 1: 1.0}, "b": {2: 2.0}}, "r1": {"c": {3: 1.0, 4: 3.0}}}
    new = {"r0": {"a": {0: 1.0, 1: 1.0}, "b": {2: 2.0}}, "r1": {"c": {3: 1.0, 4: 6.0}}}
    rows = sharding.assign(sharding.assign(keys, old, name="x"), new, name="y").groupBy("x", "y").count().collect()
    share = defaultdict(int)
    for r in rows:
        share[r.x] += r["count"]
        assert r.x == r.y or r.y in (3, 4)  # only into the subtree that grew
        assert not (r.x == 4 and r.y != 4)
    assert abs(share[4] / 30000 - 3 / 8) < 0.02 and abs(share[2] / 30000 - 2 / 8) < 0.02


def test_written_shards(spark, odd_docs, tmp_path):
    sharding.write_shards(odd_docs.drop("shard"), f"file://{tmp_path}/out", 4)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == odd_docs.count()
