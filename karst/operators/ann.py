"""A stored index for approximate vector search: k-means lists, each a partition of a Parquet table.

Centres are fitted on at most `sample` rows, chosen by a hash of their ids; every row is written to the list of the
centre most alike to it, with its vector in single precision. A search ranks the centres for a query and reads the first `probes` lists only: one
query by partition filters, many in blocks. How many to read is measured when the index is
built: the true neighbours of at most `trials` rows are looked up exactly, and probes are the least number of lists that
hold the `recall` asked for. Vectors without clusters need more of their lists read than others.

Rows without a vector, or with null or non-finite components, aren't indexed; repeated ids are rows of their own. A vector
of zeros is alike to none (0). Other widths than the index's raise an error. An empty table gives an index that finds nothing.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karst.functions.scores import cosine
from karst.operators.lookups import vector_top_each, whole_vectors

#: Most lists of an index; their centres are what driver and tasks hold of it.
MOST_LISTS = 1024
ROWS = "id long, v array<float>, list int"


@dataclass
class Index:
    """Where an index is, and what was measured when it was built. recall: of the trials, with `probes` lists read."""

    folder: str
    rows: int
    lists: int
    probes: int
    recall: float
    width: int

    def table(self, spark: SparkSession) -> DataFrame:
        """Its lists' folders are listed once."""
        if getattr(self, "_table", None) is None or self._table.sparkSession is not spark:
            self._table = spark.read.schema(ROWS).parquet(f"{self.folder}/rows")
        return self._table

    def centres(self, spark: SparkSession) -> np.ndarray:
        """At most MOST_LISTS rows."""
        found = sorted(spark.read.schema("list int, v array<double>").parquet(f"{self.folder}/centres").collect())
        return np.array([r.v for r in found]).reshape(len(found), self.width)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _stack(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists as rows of a matrix; column may be a slice."""
    if not len(column):
        return np.zeros((0, width or 0))
    widths = np.unique(np.diff(column.offsets.to_numpy()))
    if len(widths) > 1 or (width is not None and len(widths) and widths[0] != width):
        raise ValueError(f"vectors of widths {widths.tolist()} where {width or 'one width'} is needed")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def fitted(x: np.ndarray, lists: int, steps: int = 12, seed: int = 1) -> np.ndarray:
    """Centres (unit vectors) of a sample of unit vectors; a list that runs empty keeps its centre."""
    centres = x[np.random.default_rng(seed).choice(len(x), lists, replace=False)]
    for _ in range(steps):
        own = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        used = np.bincount(own, minlength=lists) > 0
        centres = np.where(used[:, None], _unit(sums), centres)
    return centres


def build(rows: DataFrame, folder: str, lists: int | None = None, k: int = 10, recall: float = 0.96, sample: int = 50_000, trials: int = 256) -> Index:
    """Writes an index of rows (id, embedding) under folder. lists: a third as many as rows by default, at most MOST_LISTS."""
    spark = rows.sparkSession
    vectors = whole_vectors(rows.select(F.col("id").cast("long").alias("id"), "embedding"))
    n = vectors.count()
    share = min(1.0, 2 * sample / max(1, n))
    mark = F.xxhash64("id", F.lit(7))
    drawn = vectors.filter(F.abs(mark / float(1 << 63)) <= share).orderBy(mark, "id").limit(sample).select("embedding").toArrow()  # `sample` rows
    x = _unit(_stack(drawn["embedding"].combine_chunks() if drawn.num_rows else pa.array([], pa.list_(pa.float32()))))
    width = x.shape[1] if n else 0
    lists = max(1, min(lists or n // 3, MOST_LISTS, len(x) or 1))
    centres = fitted(x, lists) if n else np.zeros((0, 0))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, v array<double>").coalesce(1).write.parquet(f"{folder}/centres")

    def deal(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                some = batch.slice(i, 4096)
                v = _stack(some.column("embedding"), width)
                own = (_unit(v) @ centres.T).argmax(1).astype(np.int32)
                flat = pa.array(v.astype(np.float32).reshape(-1))
                lists_of = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * np.int32(width)), flat)
                yield pa.RecordBatch.from_arrays([some.column("id"), lists_of, pa.array(own)], ["id", "v", "list"])

    # partitions by list that AQE makes of even size: a list with many rows is split, small ones share a task
    dealt = vectors.mapInArrow(deal, ROWS).hint("rebalance", "list")
    dealt.write.partitionBy("list").option("compression", "zstd").parquet(f"{folder}/rows")
    index = Index(folder, n, lists, lists, 1.0, width)
    if n and trials:
        index.probes, index.recall = _measured(index, spark, vectors, k, recall, trials, centres)
    fs_write(spark, f"{folder}/index.json", json.dumps(asdict(index)))
    return index


def opened(spark: SparkSession, folder: str) -> Index:
    return Index(**json.loads(spark.read.text(f"{folder}/index.json").first().value))


def fs_write(spark: SparkSession, path: str, text: str) -> None:
    from karst.sources.shared import place

    fs, where = place(spark, path)
    out = fs.create(where, False)
    out.write(bytearray(text.encode()))
    out.close()


def _measured(index: Index, spark: SparkSession, vectors: DataFrame, k: int, recall: float, trials: int, centres: np.ndarray) -> tuple[int, float]:
    """The least number of lists that hold `recall` of the true neighbours of the trials' vectors, and the share they hold."""
    queries = vectors.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(trials)
    near = vector_top_each(queries, vectors, k).select("query", F.col("id").alias("near"))
    held = near.join(index.table(spark).select("id", "list"), F.col("near") == F.col("id")).select("query", "list")
    own = queries.select(F.col("id").alias("q"), "embedding")
    found = held.join(own, F.col("query") == F.col("q")).select("embedding", "list").toArrow()  # trials * k rows
    q = _unit(_stack(found["embedding"].combine_chunks(), index.width))
    alike = q @ centres.T
    at = alike[np.arange(len(q)), found["list"].to_numpy()]
    rank = np.sort((alike > at[:, None] - 1e-12).sum(1))
    probes = int(rank[min(len(rank) - 1, int(np.ceil(recall * len(rank))) - 1)])
    return probes, float((rank <= probes).mean())


def search(index: Index, spark: SparkSession, query: list[float], k: int, probes: int | None = None) -> DataFrame:
    """id, similarity (six places) of the k rows most alike to one vector among the lists it reads; ties by id."""
    if not index.rows:
        return spark.createDataFrame([], "id long, similarity double")
    q = _unit(np.array([query], float))[0]
    if len(q) != index.width:
        raise ValueError(f"a vector of width {len(q)} where {index.width} is needed")
    wanted = np.argsort(-(index.centres(spark) @ q), kind="stable")[: probes or index.probes].tolist()
    near = index.table(spark).filter(F.col("list").isin(wanted))
    return near.select("id", F.round(F.coalesce(cosine(F.col("v"), list(query)), F.lit(0.0)), 6).alias("similarity")).orderBy(F.col("similarity").desc(), "id").limit(k)


def _dealt(sizes: dict[int, int], lists: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For each list its first block and how many it has: neighbouring lists share a block of about `block` rows, a longer list
    has some of its own."""
    first, parts = np.zeros(lists, np.int32), np.ones(lists, np.int32)
    at, held = 0, 0
    for i in range(lists):
        n = sizes.get(i, 0)
        if held and held + n > block:
            at, held = at + 1, 0
        first[i], parts[i] = at, max(1, -(-n // block))
        held += n
        if parts[i] > 1:
            at, held = at + int(parts[i]), 0
    return first, parts


def search_each(index: Index, queries: DataFrame, k: int, probes: int | None = None, block: int = 2048) -> DataFrame:
    """query, id, similarity (six places), place: for each row of queries (id, embedding) the k most alike rows of its lists.

    Queries are dealt into blocks by the list that is nearest to them, rows by their lists, long lists into several blocks.
    A block of queries meets the blocks with lists that one of its queries reads, and no others; a task holds one of each and
    gives the k best of every query. What the driver holds is a number for each list.
    """
    spark = queries.sparkSession
    n = probes or index.probes
    out = "query long, id long, similarity double"
    if not index.rows:
        return spark.createDataFrame([], f"{out}, place int")
    centres, width = index.centres(spark), index.width
    table = index.table(spark)
    count = lambda df: {r["list"]: r["count"] for r in df.groupBy("list").count().collect()}  # noqa: E731  a row for each list
    row_first, row_parts = _dealt(count(table), len(centres), block)

    def ranked(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                some = batch.slice(i, 1024)
                lists = np.argsort(-(_unit(_stack(some.column("embedding"), width)) @ centres.T), axis=1, kind="stable")[:, :n]
                targets = [np.unique(np.concatenate([np.arange(row_first[x], row_first[x] + row_parts[x]) for x in own])) for own in lists]
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("embedding").cast(pa.list_(pa.float64())), pa.array(lists[:, 0].astype(np.int32)), pa.array([t.tolist() for t in targets], pa.list_(pa.int32()))], ["query", "q", "list", "targets"])

    def in_block(first: np.ndarray, parts: np.ndarray, key: str):
        at = lambda x: F.element_at(F.array(*[F.lit(int(i)) for i in x]), F.col("list") + 1)
        return at(first) + F.pmod(F.xxhash64(key), at(parts)).cast("int")

    asked = whole_vectors(queries.select(F.col("id").cast("long").alias("id"), "embedding")).mapInArrow(ranked, "query long, q array<double>, list int, targets array<int>")
    asked = asked.withColumn("qb", in_block(*_dealt(count(asked), len(centres), block), "query"))
    meet = asked.select("qb", F.explode("targets").alias("rb")).distinct()
    qs = asked.groupBy("qb").agg(F.collect_list(F.struct(F.col("query").alias("id"), F.col("q").alias("v"))).alias("qs"))
    rs = table.withColumn("at", in_block(row_first, row_parts, "id")).groupBy("at").agg(F.collect_list(F.struct("id", "v", "list")).alias("rs"))
    pairs = meet.join(qs, "qb").join(rs, F.col("rb") == F.col("at")).select("qs", "rs")

    def best(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                asked_, held = (batch.column(c)[i].values for c in ("qs", "rs"))
                q, r = (_unit(_stack(x.field("v"), width)) for x in (asked_, held))
                ids, names = held.field("id").to_numpy(), asked_.field("id").to_numpy()
                read = np.zeros((len(q), len(centres)), bool)
                np.put_along_axis(read, np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :n], True, axis=1)
                alike = np.where(read[:, held.field("list").to_numpy()], np.round(q @ r.T, 6), -np.inf)
                least = np.maximum(-np.partition(-alike, min(k, len(r)) - 1, axis=1)[:, min(k, len(r)) - 1], -2)
                for name, row, low in zip(names, alike, least, strict=True):
                    some = np.flatnonzero(row >= low)
                    top = some[np.lexsort((ids[some], -row[some]))[:k]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), name)), pa.array(ids[top]), pa.array(row[top])], ["query", "id", "similarity"])

    place = F.row_number().over(W.partitionBy("query").orderBy(F.col("similarity").desc(), "id"))
    return pairs.mapInArrow(best, out).withColumn("place", place).filter(F.col("place") <= k)
