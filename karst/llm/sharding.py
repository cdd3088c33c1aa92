"""Sharding by a hierarchical weighted hash tree.

A row descends from the root to a region, a rack and a shard. At each node every child draws -ln(u) / weight,
with u from the MD5 of the row's key and the child's path; the smallest draw wins. A child wins in proportion to its
weight, and when weights change rows move only into children whose weight grew or out of those whose weight
shrank, so movement is confined to the subtrees concerned.

tree() lays out the shards it is given in full regions; grown() adds each further shard as a region of its own, so
that its only new draw is its own: one more shard takes rows only into itself (law `key`).

The key is doc_id: rows with equal doc_id share a shard, null doc_id being one key. Null text has no bytes. Equal
texts have equal size and checksum. An empty table gives an empty result; extra columns are ignored by digest() and
kept by write_shards().
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets, gapless

Tree = Mapping[str, Mapping[str, Mapping[int, float]]]

#: Bytes that a row takes beside its text.
ROW_BYTES = 16


def tree(shards: int, racks: int = 2, rack_size: int = 4, weight: float = 1.0) -> dict:
    """Regions of racks of shards, filled in order."""
    out: dict = {}
    for s in range(shards):
        rack = s // rack_size
        out.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack}", {})[s] = weight
    return out


def grown(old: Tree, more: int = 1, weight: float = 1.0) -> dict:
    """The tree with further shards, each a region and a rack of its own."""
    first = 1 + max((s for racks in old.values() for shards in racks.values() for s in shards), default=-1)
    return dict(old) | {f"added{s}": {f"added{s}": {s: weight}} for s in range(first, first + more)}


def total(node) -> float:
    return sum(map(total, node.values())) if isinstance(node, Mapping) else float(node)


def _number(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of a text's MD5 as a number: a hash that every engine has, so that SQL can check it."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (_number(F.concat(key, F.lit(name)), 13).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.lit(weight)


def _winner(key: Column, node: Mapping, path: str) -> Column:
    """The name of the child that wins at a node, or the number of the shard at the last level."""
    drawn = [F.struct(_draw(key, f"{path}/{k}", total(v)).alias("draw"), F.lit(k).alias("child")) for k, v in node.items() if total(v) > 0]
    return (F.least(*drawn) if len(drawn) > 1 else drawn[0])["child"]


def assign(docs: DataFrame, nodes: Tree, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """Adds the shard of each row. A level looks at the children of the node that won above it only."""
    k, region, rack = F.coalesce(F.col(key).cast("string"), F.lit("")), f"__{name}_region", f"__{name}_rack"
    out = docs.withColumn(region, _winner(k, nodes, ""))
    racks, shards = None, None
    for r, below in nodes.items():
        if total(below) > 0:
            here = _winner(k, below, f"/{r}")
            racks = F.when(F.col(region) == r, here) if racks is None else racks.when(F.col(region) == r, here)
            for q, leaves in below.items():
                if total(leaves) > 0:
                    at = F.col(rack) == f"{r}/{q}"
                    here = _winner(k, leaves, f"/{r}/{q}")
                    shards = F.when(at, here) if shards is None else shards.when(at, here)
    out = out.withColumn(rack, F.concat_ws("/", F.col(region), racks))
    return out.withColumn(name, shards.cast("int")).drop(region, rack)


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Writes docs under path, a folder for each shard; a shard's rows come from several tasks."""
    n = buckets(docs.sparkSession)
    dealt = assign(docs, tree(shards)).withColumn("__salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-n // shards)))))
    dealt.repartition(n, "shard", "__salt").drop("__salt").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """What op7 returns: each row's size, checksum, shard, place in the shard, and shard of one more."""
    n = buckets(docs.sparkSession)
    old = tree(shards)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = assign(assign(rows, old), grown(old), name="grown_shard")
    # a doc_id with many rows, null for one, is spread over the blocks of its shard by its texts
    rows = rows.withColumn("__spread", _number(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32"), 8))
    block = F.floor(F.col("__spread") * F.lit(n) / F.lit(1 << 32)).cast("int")
    return gapless(rows, ["shard"], [F.col("__spread"), F.col("doc_id"), F.col("text_crc32"), F.col("size")], block, "slot").select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


#: The same in DuckDB's SQL: the tree as rows (parent, path, weight), each level's winner by arg_min, checksums by their rule.
SQL = r"""
WITH c AS (
  SELECT list(list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS tab FROM range(256) r(i)
), b AS (
  SELECT row_number() OVER () AS id, doc_id::BIGINT AS doc_id, coalesce(doc_id::VARCHAR, '') AS key,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents
), d AS (
  SELECT id, doc_id, key, len(bytes)::BIGINT + 16 AS size, xor(4294967295, list_reduce(bytes, lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1]), 4294967295::BIGINT)) AS text_crc32 FROM b, c
), nodes AS (
  SELECT '' AS parent, '/region' || i AS path, 8.0::DOUBLE AS weight, NULL::INT AS shard FROM range(5) r(i)
  UNION ALL SELECT '/region' || (i // 2), '/region' || (i // 2) || '/rack' || i, 4.0::DOUBLE, NULL FROM range(10) r(i)
  UNION ALL SELECT '/region' || (i // 8) || '/rack' || (i // 4), '/region' || (i // 8) || '/rack' || (i // 4) || '/' || i, 1.0::DOUBLE, i::INT FROM range(40) r(i)
  UNION ALL SELECT '', '/added40', 1.0::DOUBLE, 40
), first AS (
  SELECT id, key, path, shard, -ln((('0x' || substr(md5(key || path), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / weight AS draw FROM d, nodes WHERE parent = ''
), top AS (
  SELECT id, key, arg_min(path, draw) FILTER (shard IS NULL) AS region, arg_min(path, draw) AS grown FROM first GROUP BY ALL
), racks AS (
  SELECT id, key, region, grown, arg_min(path, -ln((('0x' || substr(md5(key || path), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / weight) AS rack
  FROM top JOIN nodes ON parent = region GROUP BY ALL
), leaves AS (
  SELECT id, grown, arg_min(n.shard, -ln((('0x' || substr(md5(key || path), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / weight) AS shard
  FROM racks JOIN nodes n ON parent = rack GROUP BY ALL
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(key || ':' || text_crc32), 1, 8))::BIGINT, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  CASE WHEN grown = '/added40' THEN 40 ELSE shard END AS grown_shard
FROM d JOIN leaves USING (id)
"""
