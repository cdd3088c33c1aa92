"""Near-duplicates by ProbMinHash, banding and verification.

A text has shingles of five words (one shingle of all its words if it has fewer), each with a weight: 1 (`weights="once"`),
or how often it occurs (`weights="count"`). Shingles arrive as Poisson processes with their weights as rates; each arrival
goes to one of m registers, and a register keeps the shingle that arrived first. A shingle's process stops once its next
arrival is later than all registers of its text (early termination). Two texts agree in a register with the probability
Jaccard of their weighted shingles, sum over shared i of 1 / sum over j of max(a_j / a_i, b_j / b_i); with weights of 1
that is the Jaccard similarity of their sets. Bands of registers give candidates, and texts whose similarity by the same
measure, computed exactly, is at least the threshold are linked. Classes are connected components of the links.

How links are found without the pairs of a group:
1. Equal texts are one node. Only nodes have bands, and equal texts are never compared.
2. In each bucket of a band every node is compared with the bucket's leader (its least node).
3. Buckets whose nodes are by then all in one component are closed. In the others, nodes in different components are
   compared within tasks, which give links, not pairs; large buckets are dealt out as pairs of blocks of bounded size.
   No pair that could be similar enough is left out: sets alike by t share one of their rarest shingles (see _Prefixes),
   and only pairs that do are looked at. So texts that share a frequent template and nothing rare are not compared.

Texts without words have no shingles and are linked to equal texts only. Null text counts as empty. Null doc_id
counts as the largest when a class's id is its least doc_id. Repeated rows are equal texts. An empty table gives an
empty result. Extra columns are kept by keep_one() and ignored by digest().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACED, U, Scratch, buckets, mix, prefix, range_hash, shingles, slices, tidied, utf8, words

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS

_NO_ID = (1 << 63) - 1


def sets(raw: np.ndarray, at: np.ndarray, k: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each distinct shingle, in order of row and hash."""
    n = len(at) - 1
    begin, end, row = words(raw, at, SPACED)
    word = range_hash(prefix(raw), begin, end)
    window, where = shingles(word, row, k)
    rows = row[where]
    size = np.bincount(row, minlength=n)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        first = np.searchsorted(row, short)
        total = np.zeros(len(short), U)
        for t in range(k - 1):
            has = size[short] > t
            total[has] += word[first[has] + t] * U(2 * t + 3)
        window, rows = np.concatenate([window, mix(total ^ U(0x5851F42D4C957F2D))]), np.concatenate([rows, short])
    order = np.lexsort((window, rows))
    window, rows = window[order], rows[order]
    if not len(rows):
        return rows.astype(np.int64), window, np.empty(0, np.int64)
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (window[1:] != window[:-1])
    first = np.flatnonzero(fresh)
    return rows[first], window[first], np.diff(np.append(first, len(rows)))


def weighted(count: np.ndarray, weights: str) -> np.ndarray:
    """The shingles' weights, from how often they occur."""
    if weights not in ("once", "count"):
        raise ValueError("weights are once or count")
    return count.astype(float) if weights == "count" else np.ones(len(count))


def alike(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """The probability Jaccard of two texts with sorted shingles a and b, and their weights x and y."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    here = b[at] == a
    if not here.any():
        return 0.0
    p, q = x[here], y[at[here]]
    if (p == 1).all() and (q == 1).all() and x.max() == 1 and y.max() == 1:
        return len(p) / (len(a) + len(b) - len(p))
    only_a, only_b = x.sum() - p.sum(), y.sum() - q.sum()
    # by the ratio of the weights: max(a_j / a_i, b_j / b_i) is the first where b_j / a_j is at most b_i / a_i
    ratio = q / p
    order = np.argsort(ratio, kind="stable")
    ratio, p, q = ratio[order], p[order], q[order]
    upto = np.searchsorted(ratio, ratio, side="right")
    below, above = np.cumsum(p)[upto - 1], q.sum() - np.cumsum(q)[upto - 1]
    return float((1 / ((only_a + below) / p + (only_b + above) / q)).sum())


def registers(row: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """The item of the first arrival in each of m registers, for each of n rows (0 for rows without items)."""
    earliest = np.full(n * m, np.inf)
    kept = np.zeros(n * m, U)
    active = np.arange(len(row))
    time = np.zeros(len(row))
    rate = weight.astype(float)
    step = 0
    while len(active):
        step += 1
        z = mix(item[active] + U((0x9E3779B97F4A7C15 * step) & 0xFFFFFFFFFFFFFFFF))
        time[active] -= np.log1p(-(z >> U(11)).astype(float) / float(1 << 53)) / rate[active]
        now = time[active]
        slot = row[active] * m + (mix(z ^ U(0xA0761D6478BD642F)) % U(m)).astype(np.int64)
        sooner = now < earliest[slot]
        if sooner.any():
            at, t = slot[sooner], now[sooner]
            np.minimum.at(earliest, at, t)
            won = earliest[at] == t
            kept[at[won]] = item[active[sooner][won]]
        latest = earliest.reshape(n, m).max(axis=1)
        active = active[now < latest[row[active]]]
    return kept.reshape(n, m)


def banded(kept: np.ndarray) -> np.ndarray:
    """A hash for each band of each row."""
    grid = kept.reshape(len(kept), BANDS, ROWS)
    out = np.zeros(grid.shape[:2], U) + np.arange(1, BANDS + 1, dtype=U) * U(0xD6E8FEB86659FD93)
    for i in range(ROWS):
        out = mix(out * U(0x2127599BF4325C37) + grid[:, :, i])
    return out


def signed(docs: DataFrame, keep: list[str], weights: str = "once") -> DataFrame:
    """The columns `keep` of docs as c0_, c1_ ..., doc_id, node (of the text), n (different shingles) and bands."""
    kept = [f"c{i}_" for i in range(len(keep))]
    read = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = [f for f in read.schema.fields if f.name != "text"]
    schema = T.StructType([*fields, T.StructField("node", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                raw, at = utf8(part.column("text"))
                n = part.num_rows
                row, item, count = sets(raw, at)
                found = registers(row, item, weighted(count, weights), n)
                size = np.bincount(row, minlength=n)
                text = raw.tobytes()
                node = [hashlib.md5(text[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                bands = banded(found).view(np.int64)
                lists = [b.tolist() if s else [] for b, s in zip(bands, size, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in fields], pa.array(node, pa.binary()), pa.array(size, pa.int32()), pa.array(lists, pa.list_(pa.int64()))], schema.names)

    return read.mapInArrow(tidied(run), schema)


# --------------------------------------------------------------------------- verification


def text_of_nodes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the nodes wanted: one row for each; equal texts meet before the shuffle already."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.unhex(F.md5(text.cast("binary"))).alias("node"), text.alias("text"))
    return rows.join(wanted.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))


def _bounded(part: pa.RecordBatch, weights: str):
    """The shingles and weights of each row of a batch with texts."""
    row, item, count = sets(*utf8(part.column("text")))
    weight = weighted(count, weights)
    bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
    return [(item[a:b], weight[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, weights: str = "once") -> DataFrame:
    """The pairs (a, b) whose texts are similar enough. A text stands beside blocks of the texts it is compared with."""
    block = 256
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    salted = pairs.join(sizes.withColumnRenamed("a", "a_"), F.col("a") == F.col("a_")).withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / block)).cast("int"))
    heads = sizes.select("a", F.col("a").alias("node"), F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col("k") / block) - 1).cast("int"))).alias("salt"))
    members = salted.select("a", F.col("b").alias("node"), F.lit(1).alias("side"), "salt")
    wanted = heads.select("a", "salt", "side", "node").unionByName(members.select("a", "salt", "side", "node"))
    rows = wanted.join(texts, "node").repartition(buckets(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "side", "node")

    def run(batches):
        head: tuple | None = None  # of the group that goes on: (a, salt), its shingles and their weights
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                a, salt, side, node = (part.column(c).to_pylist() for c in ("a", "salt", "side", "node"))
                out_a, out_b = [], []
                for i, (item, weight) in enumerate(_bounded(part, weights)):
                    if side[i] == 0:
                        head = ((a[i], salt[i]), item.copy(), weight.copy())
                        continue
                    if head is None or head[0] != (a[i], salt[i]):
                        raise ValueError("a block without its text")
                    if alike(item, weight, *head[1:]) >= threshold - 1e-9:
                        out_a.append(a[i])
                        out_b.append(node[i])
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])

    return rows.select("a", "salt", "side", "node", "text").mapInArrow(tidied(run), "a binary, b binary")


# --------------------------------------------------------------------------- components


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root: the least node of each component of the edges (a, b); nodes without edges are left out.

    Labels spread along edges and along themselves (root of the root), so that rounds are few; each round is a table.
    """
    both = scratch.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}/edges")
    labels = scratch.write(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"), f"{name}/0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels.node == near.a, "left").select("node", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("node").alias("at"), F.col("root").alias("beyond"))
        now = lower.join(jump, lower.next == jump["at"], "left").select("node", F.least("next", "beyond").alias("root"), (F.least("next", "beyond") != F.col("root")).alias("moved"))
        found = scratch.write(now, f"{name}/{step}")
        moved = found.filter("moved").limit(1).count()
        scratch.drop(f"{name}/{step - 1}")
        labels = found.select("node", "root")
        if not moved:
            return labels


# --------------------------------------------------------------------------- links left between components


class _Parts:
    """Components that are joined one by one."""

    def __init__(self, root: list):
        number: dict = {}
        self.own = np.array([number.setdefault(r, len(number)) for r in root], np.int64)
        self.parent = np.arange(len(number))

    def of(self, x: np.ndarray) -> np.ndarray:
        at = self.own[x]
        while True:
            up = self.parent[at]
            if (up == at).all():
                return at
            self.parent[at] = self.parent[up]
            at = self.parent[at]

    def join(self, x: int, y: int) -> bool:
        a, b = self.of(np.array([x, y]))
        self.parent[a] = b
        return a != b


class _Prefixes:
    """Which sets could be alike by the threshold, from their rarest shingles (rarest among all of them first).

    Sets are taken from the smallest to the largest. Of a set of n, an earlier one looks for its first n - ceil(t n) + 1
    shingles among the first n - ceil(2 t n / (1 + t)) + 1 of the smaller ones: sets alike by t share more than they have
    behind those. The first shingle that two share also bounds what they can share from there on. So texts of one template
    that are less alike than t don't meet by it, as those few are their own. With weights the probability Jaccard is at most
    the sum of the lesser parts of the two totals, so both first parts end where less than t of a set's weight is left.
    """

    def __init__(self, sets_: list, part: np.ndarray, threshold: float, weights: str):
        self.t, self.once = threshold, weights == "once"
        self.size = size = np.fromiter((len(x) for x, _ in sets_), np.int64, len(sets_))
        owner = np.repeat(np.arange(len(sets_)), size)
        _, back, times = np.unique(np.concatenate([x for x, _ in sets_]), return_inverse=True, return_counts=True)
        rank = np.empty(len(times), np.int64)
        rank[np.argsort(times, kind="stable")] = np.arange(len(times))
        rank = rank[back]
        order = np.lexsort((rank, owner))
        rank, first = rank[order], np.cumsum(size) - size
        place = np.arange(len(owner)) - first[owner]
        if self.once:
            least = lambda share: (size - np.ceil(share * size - 1e-9).astype(np.int64) + 1)[owner]
            asks, told = place < least(threshold), place < least(2 * threshold / (1 + threshold))
        else:
            weight = np.concatenate([w for _, w in sets_])[order]
            total = np.add.reduceat(weight, first)[owner]
            before = np.cumsum(weight) - weight
            asks = told = 1 - (before - before[first][owner]) / total >= threshold - 1e-9
        self.turn = np.empty(len(size), np.int64)
        self.turn[np.argsort(size, kind="stable")] = np.arange(len(size))
        # the index, by shingle and within it by component, so that a component's own can be stepped over
        by = np.lexsort((part[owner[told]], rank[told]))
        self.owner, self.place = owner[told][by], place[told][by]
        span = int(part.max()) + 1
        key = rank[told][by] * span + part[self.owner]
        a, p = owner[asks], place[asks]
        low, high = (np.searchsorted(key, rank[asks] * span + d) for d in (0, span))
        own_low, own_high = (np.searchsorted(key, rank[asks] * span + part[a] + d) for d in (0, 1))
        some = np.flatnonzero(high - low > own_high - own_low)
        self.ask = {}
        if len(some):
            cut = np.flatnonzero(np.diff(a[some])) + 1
            for rows in np.split(some, cut):
                self.ask[int(a[rows[0]])] = [(p[r], low[r], own_low[r], own_high[r], high[r]) for r in rows]

    def partners(self, x: int) -> np.ndarray:
        """The sets before x, in other components at first, that could be alike."""
        parts = [(p, q) for p, low, own_low, own_high, high in self.ask[x] for q in (slice(low, own_low), slice(own_high, high)) if q.start < q.stop]
        y = np.concatenate([self.owner[q] for _, q in parts])
        here = self.turn[y] < self.turn[x]
        if not self.once:
            return np.unique(y[here])
        there = np.concatenate([self.place[q] for _, q in parts])
        mine = np.concatenate([np.full(q.stop - q.start, p) for p, q in parts])
        here &= self.size[y] >= self.t * self.size[x] - 1e-9
        y, at = np.unique(y[here], return_index=True)  # the first shingle shared comes first
        left = 1 + np.minimum(self.size[x] - 1 - mine[here][at], self.size[y] - 1 - there[here][at])
        return y[left >= self.t / (1 + self.t) * (self.size[x] + self.size[y]) - 1e-9]


def _links(node: list, root: list, sets_: list, mine: list, across: bool, threshold: float, weights: str):
    """Links between components among the nodes of one bucket (of one pair of its blocks, if `across`).

    A pair is compared at most once, and only while the links found so far leave it in two components.
    """
    parts, block = _Parts(root), np.array(mine)
    found = _Prefixes(sets_, parts.own, threshold, weights)
    for x in sorted(found.ask, key=found.turn.__getitem__):
        y = found.partners(x)
        if across:
            y = y[block[y] != block[x]]
        item, weight = sets_[x]
        many = 16
        while True:
            y = y[parts.of(y) != parts.of(np.array([x]))]
            if not len(y):
                break
            some, y = y[:many], y[many:]
            many = min(8 * many, 1 << 14)
            if weights == "once":
                other = np.concatenate([sets_[i][0] for i in some])
                at = np.minimum(np.searchsorted(item, other), len(item) - 1)
                size = found.size[some]
                shared = np.add.reduceat((item[at] == other).astype(np.int64), np.cumsum(size) - size)
                near = shared >= (threshold - 1e-9) * (len(item) + size - shared)
            else:
                near = np.array([alike(item, weight, *sets_[i]) >= threshold - 1e-9 for i in some])
            for i in some[near].tolist():
                if parts.join(x, i):
                    yield node[x], node[i]


def left_over(bands: DataFrame, texts: DataFrame, labels: DataFrame, threshold: float, weights: str = "once", block: int = 1 << 20) -> DataFrame:
    """Links (a, b) of nodes that share a bucket but are in different components so far.

    All of them are verified, within tasks: what comes out is links, fewer than nodes. A bucket is dealt out as pairs of
    blocks with about `block` shingles each.
    """
    comp = bands.join(labels.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    sizes = comp.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("k")).filter("low != high").select(F.col("bucket").alias("open"), "k")
    n = F.ceil(F.col("k") / block).cast("int")
    members = comp.join(sizes, F.col("bucket") == F.col("open")).withColumn("mine", F.pmod(F.xxhash64("node"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    tiled = members.select("bucket", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "node", "root")
    rows = tiled.join(texts.withColumnRenamed("node", "at"), F.col("node") == F.col("at")).select("bucket", "x", "y", "mine", "node", "root", "text")
    rows = rows.repartition(buckets(bands.sparkSession), "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "node")

    def run(batches):
        key, group = None, []

        def give():
            found = list(_links(*map(list, zip(*group, strict=True)), key[1] != key[2], threshold, weights)) if len(group) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["a", "b"])

        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                columns = [part.column(c).to_pylist() for c in ("bucket", "x", "y", "node", "root", "mine")]
                for (item, weight), bucket, x, y, node, root, mine in zip(_bounded(part, weights), *columns, strict=True):
                    if (bucket, x, y) != key:
                        if group:
                            yield give()
                        key, group = (bucket, x, y), []
                    group.append((node, root, (item.copy(), weight.copy()), mine))
        if group:
            yield give()

    return rows.mapInArrow(tidied(run), "a binary, b binary")


# --------------------------------------------------------------------------- classes


def classes(docs: DataFrame, keep: list[str], threshold: float = THRESHOLD, weights: str = "once") -> DataFrame:
    """The columns of signed() and uid, class (of the least doc_id and uid of its texts)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    rows = scratch.write(signed(docs, keep, weights).withColumn("uid", F.monotonically_increasing_id()), "signed")
    own = F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), F.col("uid").alias("uid"))
    first = rows.groupBy("node").agg(F.min(own).alias("first"))
    nodes = scratch.write(rows.join(first.select(F.col("first.uid").alias("chosen")), F.col("uid") == F.col("chosen"), "left_semi").select("node", "n", "bands"), "nodes")
    bands = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("leader")).filter("k > 1").select(F.col("bucket").alias("of"), "leader")
    joined = scratch.write(bands.join(shared, F.col("bucket") == F.col("of")).select("bucket", "node", "n", "leader"), "bands")
    pairs = scratch.write(joined.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    texts = scratch.write(text_of_nodes(docs, joined), "texts")
    links = scratch.write(verified(pairs, texts, threshold, weights), "links")
    labels = components(links, scratch, "led")
    more = scratch.write(left_over(joined.drop("leader"), texts, labels, threshold, weights), "more")
    labels = components(links.unionByName(more), scratch, "all")
    rooted = first.join(labels.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("class")).withColumnRenamed("root", "of")
    table = scratch.write(rooted.join(least, F.col("root") == F.col("of")).select(F.col("node").alias("at"), "class"), "classes")
    for done in ("nodes", "bands", "pairs", "texts", "links", "more", "led", "all"):
        scratch.drop(done)
    return rows.join(table, F.col("node") == F.col("at")).drop("at")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, that with the least doc_id, with the columns of docs."""
    names = docs.columns
    found = classes(docs, names, **options)
    return found.filter(F.col("class.uid") == F.col("uid")).select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(names)])


def digest(docs: DataFrame, **options) -> DataFrame:
    """What op1 returns: doc_id and class_id, the least doc_id of the document's class."""
    found = classes(docs, [], **options)
    return found.select("doc_id", F.when(F.col("class.doc_id") != _NO_ID, F.col("class.doc_id")).alias("class_id"))
