"""Best-fit packing of token sequences by large-item matching.

Only lengths decide where a piece goes, and a length is an integer up to the capacity. So the plan is made
on the histogram of lengths (as many rows as the capacity, whatever the corpus), as patterns with a number of
bins each, and every piece finds its bin by its rank among the pieces of its length. Pieces above one third
of the capacity are matched greedily, two at most to a bin: the longest left with the longest that fits
beside it. Shorter pieces, longest first, go to the smallest gap that holds them.

Ranks need no sort and don't move the ids: each piece is written with its number among those of its length in its part
of the table, and a part's first rank of a length is a prefix sum of the parts' counts.

Null text counts as empty; an empty text is one piece, its end id. Repeated rows, rows with equal or null
doc_id and equal lengths are separate pieces. An empty table gives an empty result. Other input columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, slices, tidied
from .tokens import Encoder, tokenizer_path

CAPACITY = 2048

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


#: A piece's part of the table, and its number among the pieces of its length there.
PLACED = T.StructType([*PIECES.fields, T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())])


def cut_documents(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY, width: int = 4) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian, unsigned, `width` bytes each), part, nth: each document's ids and
    its end id. part and nth are of the run that wrote the rows: write them before they are used.

    A document longer than the capacity is cut into pieces of the capacity; what is left over comes first.
    width: 2 suffices for up to 65,536 ids.
    """
    path = path or tokenizer_path()

    def cut(batches):
        encoder, own_part = Encoder.of(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = encoder.encode(part.column("text"))
                doc, piece, start, length, data, nth = [], [], [], [], [], []
                doc_id = part.column("doc_id").to_pylist()
                for r in range(part.num_rows):
                    own = np.append(ids[at[r] : at[r + 1]], np.uint32(end_id))
                    if width == 2 and own.max() > 0xFFFF:
                        raise ValueError("an id doesn't fit into 2 bytes; cut with width=4")
                    own = own.astype(f"<u{width}")
                    bounds = [0, *range(len(own) % capacity or min(capacity, len(own)), len(own) + 1, capacity)]
                    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        doc.append(doc_id[r])
                        piece.append(i)
                        start.append(a)
                        length.append(b - a)
                        nth.append(int(seen[b - a]))
                        seen[b - a] += 1
                        data.append(own[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary()), pa.array(np.full(len(doc), own_part, np.int32)), pa.array(nth, pa.int64())], PLACED.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(cut), PLACED)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns, as ([(length, how often in a bin)], number of bins)."""
    left = {n: c for n, c in histogram.items() if c}
    gaps: dict[int, list] = defaultdict(list)  # by gap: [items, bins]
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            room = capacity - n
            mate = next((m for m in large if m <= room and m <= n and left[m] - (m == n) > 0), None)
            if mate is None:
                gaps[room].append([[(n, 1)], left[n]])
                left[n] = 0
            elif mate == n:
                gaps[room - n].append([[(n, 2)], left[n] // 2])
                left[n] %= 2
            else:
                bins = min(left[n], left[mate])
                gaps[room - mate].append([[(n, 1), (mate, 1)], bins])
                left[n] -= bins
                left[mate] -= bins
    for n in sorted((n for n in left if left[n]), reverse=True):
        for gap in sorted(g for g in gaps if g >= n):
            each, stay = gap // n, []
            for items, bins in gaps[gap]:
                full = min(bins, left[n] // each)
                left[n] -= full * each
                if full:
                    gaps[gap - each * n].append([[*items, (n, each)], full])
                bins -= full
                if bins and left[n]:
                    gaps[gap - left[n] * n].append([[*items, (n, left[n])], 1])
                    left[n] = 0
                    bins -= 1
                if bins:
                    stay.append([items, bins])
            gaps[gap] = stay
            if not left[n]:
                break
        each = capacity // n
        if left[n] >= each:
            gaps[capacity - each * n].append([[(n, each)], left[n] // each])
            left[n] %= each
        if left[n]:
            gaps[capacity - left[n] * n].append([[(n, left[n])], 1])
            left[n] = 0
    return [(items, bins) for gap in sorted(gaps) for items, bins in gaps[gap]]


def slots(patterns: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, first bin, offset), in order of length and rank: a run of ranks goes to a run of bins."""
    used: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for items, bins in patterns:
        offset = 0
        for length, times in items:
            for _ in range(times):
                rows.append((length, used[length], first, offset))
                used[length] += bins
                offset += length
        first += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a column `length` of 1 to capacity, and the columns part and nth of
    cut_documents(), which are dropped."""
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    kept = scratch.write(pieces, "pieces")
    counts = kept.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # for each length a row for each part, never a row for each piece
    earlier = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    before = scratch.write(counts.select(F.col("part").alias("__part"), F.col("length").alias("__length"), "n", F.coalesce(earlier, F.lit(0)).alias("__before")), "before")
    histogram = {r["length"]: r["n"] for r in before.groupBy(F.col("__length").alias("length")).agg(F.sum("n").alias("n")).collect()}  # a row for each length up to the capacity
    table = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))  # its size depends on the capacity only

    @F.pandas_udf("sequence_id long, offset long")
    def seat(length, rank):
        import pandas as pd

        rows = table.value
        span = 1 << 44
        at = np.searchsorted(rows[:, 0] * span + rows[:, 1], length.to_numpy() * span + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": rows[at, 2] + rank.to_numpy() - rows[at, 1], "offset": rows[at, 3]})

    # Spark broadcasts the counts while they are few; beyond that the join deals pieces out by part and length, once
    ranked = kept.join(before.drop("n"), (F.col("part") == F.col("__part")) & (F.col("length") == F.col("__length"))).withColumn("__rank", F.col("nth") + F.col("__before"))
    return ranked.withColumn("__seat", seat("length", "__rank")).select(*[c for c in kept.columns if c not in ("part", "nth")], "__seat.sequence_id", "__seat.offset")


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY, width: int = 2) -> DataFrame:
    """The packed sequences, as placed pieces with their ids."""
    return place(cut_documents(docs, path, end_id, capacity, width), capacity)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """What op2 returns: a piece's place, and the checksum of its ids instead of them."""
    cut = cut_documents(docs, path)
    return place(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "nth"))
