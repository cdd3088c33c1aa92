"""Exact substring dedup: Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

A byte is removed if it is covered by a string of `length` bytes that also starts anywhere else. Strings are windows
of the texts' UTF-8 bytes; they don't cross texts.

1. Narrowing, without loss. Of the hashes of GRAM bytes that start within a window, the least (the first of equals) is its
   anchor. Equal windows have equal anchors at equal places, so only occurrences of one anchor need to be compared, and
   an anchor that occurs once needs no comparison. Anchors are counted with partial sums before the shuffle. The bytes
   that an anchor's windows can cover around an occurrence are a string; equal strings are one, which repeats in all its
   windows. So an anchor costs as much as it has different strings, however often it occurs. Where it has more than `hot`,
   its windows are told apart by longer anchors, grown by half of what a window has to spare to the side on which it
   reaches further, until none has that many strings or the anchor is the window itself, which is then counted by its digest.
2. Shards. Strings are aligned at the anchor. A shard (a slice of the strings) turns its strings of an anchor into their
   transform: beginning at the right end, level by level, the symbols that stand before the suffixes in the suffixes'
   order. A string's end is a symbol of its own, less than all bytes and equal to none.
3. Merging. The transforms of an anchor are merged without sorting suffixes: the interleave says which shard each suffix of
   the merged order is from. It begins as the shards one after the other, at the strings' right ends; each iteration reads
   the shards' symbols in the order of the interleave and refines it by dealing them out stably by symbol, which is one
   step to the left. The common prefixes of neighbours come with it: 1 more than the least between the two before, or 0
   where the symbols differ. At each place where a window can start, a suffix whose common prefix with a neighbour is
   `length` or more is in a repeated interval.
4. The intervals of a text are united and cut out.

Equal texts are one text with a count: with two or more copies, every window of theirs repeats.

Null text counts as empty; texts shorter than `length` lose nothing. Repeated rows are copies. An empty table gives an
empty result. Extra columns are kept by cut() and ignored by digest().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Scratch, buckets, mix, prefix, range_hash, slices, tidied, utf8

LENGTH = 200
GRAM = 48
#: Different strings of an anchor that one task may merge.
HOT = 50_000


# --------------------------------------------------------------------------- anchors


def _window_minima(key: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbouring keys."""
    out, span = key, 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the buffer, hash, and the first and last window start of each anchor."""
    none = np.empty(0, np.int64)
    n = len(raw)
    if n < length:
        return none, none, np.empty(0, U), none, none
    starts = np.arange(n - gram + 1)
    grams = range_hash(prefix(raw), starts, starts + gram)
    # the place in the low half makes the first of equals the least
    key = (mix(grams) >> U(32) << U(32)) | starts.astype(U)
    place = (_window_minima(key, length - gram + 1) & U(0xFFFFFFFF)).astype(np.int64)
    windows = np.maximum(np.diff(at) - length + 1, 0)
    row = np.repeat(np.arange(len(windows)), windows)
    window = np.arange(len(row)) + np.repeat(at[:-1] - (np.cumsum(windows) - windows), windows)
    if not len(window):
        return none, none, np.empty(0, U), none, none
    chosen = place[window]
    fresh = np.ones(len(window), bool)
    fresh[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(window)) - 1
    return row[first], chosen[first], grams[chosen[first]], window[first], window[last]


# --------------------------------------------------------------------------- merging


def _range_minima(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minima of values[begin:end]; no range is empty."""
    out = np.empty(len(begin), values.dtype)
    level = np.frexp(end - begin)[1] - 1
    table, span = values, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        here = level == k
        out[here] = np.minimum(table[begin[here]], table[end[here] - span])
        table = np.minimum(table[:-span], table[span:]) if len(table) > span else table
        span *= 2
    return out


def strings(raw: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A row for each level, from the right end to the left: the symbols (a byte and 1, or 0 beyond the ends) of strings
    that reach `high` bytes to the left and `length - low` to the right of their places in raw."""
    left = int(high.max(initial=0))
    out = np.zeros((length + left, len(place)), np.uint16)
    last = max(len(raw) - 1, 0)
    for t in range(length + left):
        j = length - 1 - t
        inside = j < length - low if j >= 0 else -j <= high
        out[t] = np.where(inside, raw[np.clip(place + j, 0, last)].astype(np.uint16) + 1, 0)
    return out


def transform(group: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The transform of each group's strings (columns of symbols, a row for each level; groups ascend): at each level the
    symbols before the suffixes, in the order of the suffixes."""
    out = np.empty_like(symbols)
    order = np.arange(len(group))
    block = group.astype(np.int64) * 257
    for t, level in enumerate(symbols):
        out[t] = level[order]
        order = order[np.argsort(block + out[t], kind="stable")]
    return out


def merge(group: np.ndarray, shard: np.ndarray, columns: np.ndarray, length: int = LENGTH, merged: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges transforms (columns, side by side by group and then by shard; shard: the number of each column's transform).

    Returns the repeated windows: string, and the first and last distance (of the window's start before the anchor) of
    each run of them. The merged transform is put into `merged`, if it is given.
    """
    k = len(group)
    block = group.astype(np.int64) * 257
    who = np.arange(k)  # the string of each suffix; its shard is the interleave
    at = np.empty(k, np.int64)
    lcp = np.zeros(k, np.int64)
    hits, hit_distance = [], []

    def look(distance: int) -> None:
        found = who[np.maximum(lcp, np.append(lcp[1:], 0)) >= length]
        hits.append(found)
        hit_distance.append(np.full(len(found), distance))

    for t, level in enumerate(columns):
        if t >= length:
            look(t - length)
        # the next of a shard's suffixes in the interleave is the next of its transform
        at[np.argsort(shard[who], kind="stable")] = np.arange(k)
        symbol = level[at]
        if merged is not None:
            merged[t] = symbol
        key = block + symbol
        to = np.argsort(key, kind="stable")
        key = key[to]
        same = np.zeros(k, bool)
        same[1:] = (key[1:] == key[:-1]) & (symbol[to[1:]] > 0)
        new = np.zeros(k, np.int64)
        beside = same.copy()
        beside[1:] &= to[1:] == to[:-1] + 1
        new[beside] = lcp[to[beside]] + 1
        apart = np.flatnonzero(same & ~beside)
        if len(apart):
            new[apart] = _range_minima(lcp, to[apart - 1] + 1, to[apart] + 1) + 1
        who, lcp = who[to], new
    look(len(columns) - length)
    row, distance = np.concatenate(hits), np.concatenate(hit_distance)
    sort = np.lexsort((distance, row))
    row, distance = row[sort], distance[sort]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (distance[1:] != distance[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(row)) - 1 if len(row) else first
    return row[first], distance[first], distance[last]


# --------------------------------------------------------------------------- Spark


def _packed(docs: DataFrame) -> DataFrame:
    """node, z: each text's digest and its compressed bytes."""

    def run(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                raw, at = utf8(part.column("text"))
                text = raw.tobytes()
                parts = [text[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(p).digest() for p in parts], pa.binary()), pa.array([squeeze(p) for p in parts], pa.binary())], ["node", "z"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "node binary, z binary")


def _anchored(docs: DataFrame, length: int) -> DataFrame:
    """node, place, anchor, low and high: distances of the first and last window that the anchor stands for."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                raw, at = utf8(part.column("text"))
                row, place, found, first, last = anchors(raw, at, length)
                node = part.column("node").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([node, pa.array((place - at[:-1][row]).astype(np.int32)), pa.array(found.view(np.int64)), pa.array((place - last).astype(np.int16)), pa.array((place - first).astype(np.int16))], ["node", "place", "anchor", "low", "high"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.unhex(F.md5(text.cast("binary"))).alias("node"), text.alias("text")).mapInArrow(tidied(run), "node binary, place int, anchor long, low short, high short")


def _unpacked(column: pa.Array) -> list[bytes]:
    import zstandard

    spread = zstandard.ZstdDecompressor().decompress
    return [spread(z) for z in column.to_pylist()]


PLACE = pa.struct([("node", pa.binary()), ("place", pa.int32())])
PIECE = "sid binary, anchor long, low short, high short, body binary, at array<struct<node:binary,place:int>>"
SHARD = "anchor long, k int, right int, left int, symbols binary, ends binary, sids array<binary>"
RUN = "sid binary, near short, far short"


def _pieces(texts: DataFrame, length: int) -> DataFrame:
    """Strings around repeated anchors, each once for a slice of texts: sid (its digest), anchor, body (the bytes from `high`
    before a place to `length - low` behind it: the windows that begin low to high bytes before it), and its places."""
    names = [x.split()[0] for x in PIECE.replace("node:binary,place:int", "x").split(", ")]
    kinds = (pa.binary(), pa.int64(), pa.int16(), pa.int16(), pa.binary(), pa.list_(PLACE))

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                found: dict = {}
                for node, text, marks in zip(part.column("node").to_pylist(), _unpacked(part.column("z")), part.column("marks").to_pylist(), strict=True):
                    for m in marks:
                        p, low, high = m["place"], m["low"], m["high"]
                        body = text[p - high : p - low + length]
                        sid = hashlib.md5(b"%d %d " % (low, high) + body).digest()
                        found.setdefault(sid, (m["anchor"], low, high, body, []))[4].append({"node": node, "place": p})
                rows = [(sid, *x) for sid, x in found.items()]
                for i in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i : i + 4096]], kind) for c, kind in enumerate(kinds)], names)

    return texts.select("node", "z", "marks").mapInArrow(tidied(run), PIECE)


def _bodies(part: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The strings' bytes one after the other, and their numbers (at: their anchors' places in the bytes)."""
    raw, begin = utf8(part.column("body"))
    m = {x: part.column(x).to_numpy().astype(np.int64) for x in part.schema.names if x not in ("sid", "body")}
    return raw, m | {"at": begin[:-1] + m["high"]}


def _shards(rows: DataFrame, length: int, most: int = 8192) -> DataFrame:
    """A row for each anchor of a shard (a slice of at most `most` strings): the transform of its k strings there, that reach
    `right` and `left` bytes at most (symbols level by level; ends: which of them are ends, as bits, if any), and their sids."""
    names = [x.split()[0] for x in SHARD.split(", ")]

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, most) for i in range(0, batch.num_rows, most)):
                raw, m = _bodies(part)
                by = np.argsort(m["anchor"], kind="stable")
                anchor, low, high = (m[x][by] for x in ("anchor", "low", "high"))
                new = np.ones(len(by), bool)
                new[1:] = anchor[1:] != anchor[:-1]
                columns = transform(np.cumsum(new) - 1, strings(raw, m["at"][by], low, high, length))
                ends = columns == 0
                plain = (columns - ~ends).astype(np.uint8)
                own = np.append(np.flatnonzero(new), len(by))
                right, left = length - np.minimum.reduceat(low, own[:-1]), np.maximum.reduceat(high, own[:-1])
                data, over = [], []
                for a, b, r, q in zip(own[:-1].tolist(), own[1:].tolist(), right.tolist(), left.tolist(), strict=True):
                    levels = slice(length - r, length + q)
                    data.append(plain[levels, a:b].tobytes())
                    over.append(np.packbits(ends[levels, a:b]).tobytes() if b > a + 1 and ends[levels, a:b].any() else b"")
                sids = pa.ListArray.from_arrays(pa.array(own, pa.int32()), part.column("sid").take(pa.array(by)))
                numbers = [pa.array(anchor[own[:-1]]), *(pa.array(x, pa.int32()) for x in (np.diff(own), right, left))]
                yield pa.RecordBatch.from_arrays([*numbers, pa.array(data, pa.binary()), pa.array(over, pa.binary()), sids], names)

    return rows.select("sid", "anchor", "low", "high", "body").mapInArrow(tidied(run), SHARD)


def _merged(shards: DataFrame, n: int, length: int, most: int = 20_000) -> DataFrame:
    """sid, near, far: the distances of the repeated windows of strings."""

    def solve(table: pa.Table):
        table = table.combine_chunks()
        anchor, count, right, left = (table.column(c).to_numpy() for c in ("anchor", "k", "right", "left"))
        group = np.concatenate([[0], np.cumsum(anchor[1:] != anchor[:-1])])
        several = np.flatnonzero(np.bincount(group, weights=count)[group] > 1)  # one string alone has nothing to be merged with
        if not len(several):
            return
        columns = np.zeros((length + int(left[several].max()), int(count[several].sum())), np.uint16)
        symbols, ends = table.column("symbols").take(pa.array(several)).to_pylist(), table.column("ends").take(pa.array(several)).to_pylist()
        i = 0
        for r, data, over in zip(several.tolist(), symbols, ends, strict=True):
            k = int(count[r])
            block = np.frombuffer(data, np.uint8).astype(np.uint16) + 1
            if over:
                block[np.unpackbits(np.frombuffer(over, np.uint8), count=len(block)).astype(bool)] = 0
            columns[length - right[r] : length + left[r], i : i + k] = block.reshape(-1, k)
            i += k
        shard = np.repeat(several, count[several])
        string, near, far = merge(group[shard], shard, columns, length)
        sids = table.column("sids").take(pa.array(several)).combine_chunks().flatten()
        yield pa.RecordBatch.from_arrays([sids.take(pa.array(string)), pa.array(near, pa.int16()), pa.array(far, pa.int16())], ["sid", "near", "far"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += int(batch.column("k").to_numpy().sum())
            if size < most:
                continue
            table = pa.Table.from_batches(held)
            anchor = table.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            if cut:
                yield from solve(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            size = sum(int(b.column("k").to_numpy().sum()) for b in held)
        if held and sum(b.num_rows for b in held):
            yield from solve(pa.Table.from_batches(held))

    return shards.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(tidied(run), RUN)


# --------------------------------------------------------------------------- anchors of many strings

# A string of a longer anchor has, beside its own columns, `left` and `right`: all its windows hold the bytes from left
# before its place to right behind it, which are the anchor.
GROWN = "sid binary, anchor long, check long, left short, right short, low short, high short, body binary"


def _longer(rows: DataFrame, length: int) -> DataFrame:
    """Strings with longer anchors, for the same windows. Windows that reach further behind the anchor than half of what they
    have to spare get those bytes too, the others those in front. An anchor of a whole window is its md5, in two numbers."""
    names = [x.split()[0] for x in GROWN.split(", ")]

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 8192) for i in range(0, batch.num_rows, 8192)):
                raw, m = _bodies(part)
                m["row"] = np.arange(part.num_rows)
                half = (length - m["left"] - m["right"] + 1) // 2
                turn = length - m["right"] - half
                behind = m | {"right": m["right"] + half, "high": np.minimum(m["high"], turn)}
                before = m | {"left": turn + 1, "low": np.maximum(m["low"], turn + 1)}
                m = {name: np.concatenate([behind[name], before[name]]) for name in m}
                m = {name: x[m["low"] <= m["high"]] for name, x in m.items()}
                begin, end = m["at"] - m["left"], m["at"] + m["right"]
                anchor = mix(range_hash(prefix(raw), begin, end) ^ mix(m["left"].astype(U) + U(1))).view(np.int64)
                check = np.zeros(len(anchor), np.int64)
                for i in np.flatnonzero(end - begin == length).tolist():
                    digest = hashlib.md5(raw[begin[i] : end[i]]).digest()
                    anchor[i], check[i] = (int.from_bytes(x, "little", signed=True) for x in (digest[:8], digest[8:]))
                data = raw.tobytes()
                body = [data[a:b] for a, b in zip((m["at"] - m["high"]).tolist(), (m["at"] + length - m["low"]).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("sid").take(pa.array(m["row"])), pa.array(anchor), pa.array(check), *(pa.array(m[x], pa.int16()) for x in names[3:7]), pa.array(body, pa.binary())], names)

    return rows.select("sid", "left", "right", "low", "high", "body").mapInArrow(tidied(run), GROWN)


def _narrowed(rows: DataFrame, scratch: Scratch, length: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Strings whose anchors have grown until they have `hot` strings at most; and runs of the windows that are anchors
    themselves and stand in two strings or more."""
    few, whole, step = None, None, 0
    rows = rows.withColumn("left", F.lit(0).cast("short")).withColumn("right", F.lit(GRAM).cast("short"))
    # an anchor grows by half of what a window has to spare, so there are no more rounds than that number has bits
    while True:
        longer = scratch.write(_longer(rows, length), f"longer{step}")
        twice = longer.groupBy("anchor", "check").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("anchor").alias("of"), F.col("check").alias("and_of"), "k")
        known = longer.join(scratch.write(twice, f"twice{step}"), (F.col("anchor") == F.col("of")) & (F.col("check") == F.col("and_of")))
        done = F.col("left") + F.col("right") == length
        found = known.filter(done).select("sid", F.col("low").alias("near"), F.col("high").alias("far"))
        whole = found if whole is None else whole.unionByName(found)
        mine = known.filter(~done & (F.col("k") <= hot)).select("sid", "anchor", "low", "high", "body")
        few = mine if few is None else few.unionByName(mine)
        rows = known.filter(~done & (F.col("k") > hot))
        if rows.isEmpty():
            return few, whole
        step += 1


def united(spans) -> list[tuple[int, int]]:
    """The maximal runs of spans (begin, end); those that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


RESULT = "node binary, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """node, n_bytes, n_removed, n_spans, kept: texts (node, k, z, spans) without their repeated windows."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                out = []
                for text, k, spans in zip(_unpacked(part.column("z")), part.column("k").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    if k > 1 and len(text) >= length:
                        out.append((len(text), len(text), 1, b""))
                        continue
                    runs = united((x["begin"], x["end"]) for x in spans or ())
                    edges = [0, *(e for r in runs for e in r), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    out.append((len(text), len(text) - len(kept), len(runs), kept))
                yield pa.RecordBatch.from_arrays([part.column("node"), *(pa.array([o[i] for o in out], pa.int64()) for i in range(3)), pa.array([o[3] for o in out], pa.binary())], ["node", "n_bytes", "n_removed", "n_spans", "kept"])

    return texts.mapInArrow(tidied(run), RESULT)


def _runs(pieces: DataFrame, scratch: Scratch, n: int, length: int, hot: int) -> DataFrame:
    """sid, near, far: the windows of strings that start anywhere else as well, as runs of distances."""
    one = pieces.groupBy("sid").agg(F.first(F.struct("anchor", "low", "high", "body")).alias("s"), F.sum(F.size("at")).alias("times"))
    rows = scratch.write(one.select("sid", "s.*", "times"), "strings")
    many = rows.filter("times > 1").select("sid", F.col("low").alias("near"), F.col("high").alias("far"))
    hottest = scratch.write(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > hot).select(F.col("anchor").alias("of")), "hottest")
    if hottest.isEmpty():
        return _merged(_shards(rows, length), n, length).unionByName(many)
    hot_one = F.col("anchor") == F.col("of")
    few, whole = _narrowed(rows.join(hottest, hot_one, "left_semi"), scratch, length, hot)
    rest = rows.join(hottest, hot_one, "left_anti").select("sid", "anchor", "low", "high", "body")
    return _merged(_shards(rest.unionByName(few), length), n, length).unionByName(whole).unionByName(many)


def repeated(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The texts with a repeated anchor or copies, cut (node, n_bytes, n_removed, n_spans, kept), and the nodes of those."""
    spark = docs.sparkSession
    n = buckets(spark)
    scratch = Scratch(spark, "suffixes")
    marks = scratch.write(_anchored(docs, length), "anchors")
    # a table of its own, so that the join's two sides are plain shuffles and Spark can split a frequent anchor's rows
    twice = scratch.write(marks.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("anchor").alias("of")), "twice")
    of_node = marks.join(twice, F.col("anchor") == F.col("of")).groupBy("node").agg(F.collect_set(F.struct("place", "anchor", "low", "high")).alias("marks"))
    texts = _packed(docs).groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.first("z").alias("z"))
    suspects = scratch.write(texts.join(of_node, "node", "left").filter("marks IS NOT NULL OR k > 1"), "suspects")
    scratch.drop("anchors")
    scratch.drop("twice")
    pieces = scratch.write(_pieces(suspects.filter("marks IS NOT NULL"), length), "pieces")
    runs = _runs(pieces, scratch, n, length, hot).withColumnRenamed("sid", "of")
    spans = pieces.select("sid", "at").join(runs, F.col("sid") == F.col("of")).select(F.explode("at").alias("x"), "near", "far")
    spans = spans.groupBy(F.col("x.node").alias("node")).agg(F.collect_list(F.struct((F.col("x.place") - F.col("far")).alias("begin"), (F.col("x.place") - F.col("near") + length).alias("end"))).alias("spans"))
    cut = _cut(suspects.select("node", "k", "z").join(spans, "node", "left"), length)
    return cut, suspects.select("node")


def _node(docs: DataFrame):
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


def cut(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes cut out of text, and n_chars (if there is such a column) counted anew.

    A cut through a character drops what is left of it.
    """
    names = docs.columns
    found, _ = repeated(docs, length)
    scratch = Scratch(docs.sparkSession, "suffixes-cut")
    changed = scratch.write(found.filter("n_removed > 0").select("node", "kept"), "changed")

    def whole(batches):
        for batch in batches:
            kept = [x.decode("utf-8", "ignore") for x in batch.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(kept, pa.string())], ["at", "cut_"])

    fresh = changed.mapInArrow(tidied(whole), "at binary, cut_ string")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}_") for i, c in enumerate(names)], _node(docs).alias("node"))
    joined = rows.join(fresh, F.col("node") == F.col("at"), "left")
    text = F.coalesce(F.col("cut_"), F.col(f"c{names.index('text')}_").cast("string"))
    return joined.select(*[(text if c == "text" else F.when(F.col("cut_").isNotNull(), F.char_length("cut_").cast(docs.schema[c].dataType)).otherwise(F.col(f"c{i}_")) if c == "n_chars" else F.col(f"c{i}_")).alias(c) for i, c in enumerate(names)])


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """What op4 returns: what is removed from each document, and the checksum of what stays."""
    found, _ = repeated(docs, length)
    scratch = Scratch(docs.sparkSession, "suffixes-digest")
    changed = scratch.write(found.filter("n_removed > 0").select(F.col("node").alias("at"), "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")), "changed")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("node"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    zero = F.lit(0).cast("long")
    return rows.join(changed, F.col("node") == F.col("at"), "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))
