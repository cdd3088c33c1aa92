"""Product codes of vectors: a codebook for each of equal consecutive parts, fitted to all vectors in integers by Lloyd's
rounds with Hamerly's bounds.

A component x becomes floor(scale * x). Each round is one pass over a table of vectors, each with its codes and, for each
part, an upper bound of the distance to its entry and a lower bound of the distance to any other. When entries move, the
bounds are moved by as much; only where the upper isn't strictly below the lower (nor below half the way from the entry to
its nearest neighbour) is the distance computed, and only if it fails again are all entries scanned, in exact integers,
ties to the lower index. Strict bounds leave no room for ties, so codes are those of full scans. Bounds are rounded
outwards. Tasks add up their parts by entry (at most parts * entries sums a task); the sums, as many, come to the driver,
which divides them with floor. Unused entries stay.

Defined results: rows whose vector is null or holds null, NaN or infinite components are dropped. The first entries are the
vectors with the smallest vec_id, null last, equal ones in order of their bytes; with fewer vectors than entries the
codebooks are as small. Repeated rows are rows of their own; null labels are one label. An empty table gives an empty result. Vectors of
different widths, of a width that parts don't divide, or with components too large for exact 64-bit sums raise an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidied

STATE = "vec_id long, label int, v binary, s binary, part int, entry int, n long, sums array<long>"
CODED = "vec_id long, label int, code string, error long"
#: Rows that are compared with all entries at a time.
BLOCK = 4096


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x * (1 + 1e-12), np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x * (1 - 1e-12), -np.inf), 0)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all of c."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 < 1 << 53:  # each product and sum is an integer that a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for i in range(x.shape[1]):
        out += (x[:, i, None] - c[None, :, i]) ** 2
    return out


class Bounds:
    """Of one part: how far its entries moved since the last round, and how far they are from each other."""

    def __init__(self, before: np.ndarray | None, now: np.ndarray):
        k = len(now)
        self.c = now
        self.drift = np.zeros(k) if before is None else _up(np.sqrt(((now - before) ** 2).sum(1).astype(np.float64)))
        top = np.sort(self.drift)[::-1]
        self.other = np.where((self.drift == top[0]) & (np.sum(self.drift == top[0]) == 1), top[1] if k > 1 else 0.0, top[0])
        apart = squares(now, now).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        self.half = _down(np.sqrt(apart.min(1)) / 2)

    def assign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Moves codes and bounds (in place) to those of this round; returns how many rows were scanned."""
        upper[:] = _up(upper + self.drift[code])
        lower[:] = _down(lower - self.other[code])
        least = np.maximum(lower, self.half[code])
        rows = np.flatnonzero(~(upper < least))
        upper[rows] = _up(np.sqrt(((x[rows] - self.c[code[rows]]) ** 2).sum(1).astype(np.float64)))
        rows = rows[~(upper[rows] < least[rows])]
        for i in range(0, len(rows), BLOCK):
            some = rows[i : i + BLOCK]
            d = squares(x[some], self.c)
            code[some] = best = d.argmin(1)
            at = np.arange(len(some))
            upper[some] = _up(np.sqrt(d[at, best].astype(np.float64)))
            rest = d.astype(np.float64)
            rest[at, best] = np.inf
            lower[some] = _down(np.sqrt(rest.min(1)))
        return len(rows)


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """Equal binary values as rows."""
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(dtype).reshape(n, -1)


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    n, size = len(x), x.nbytes // max(1, len(x))
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(x)])


def _prepare(parts: int):
    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = batch.column("q")
            width = np.unique(np.diff(q.offsets.to_numpy()))
            if len(width) > 1 or width[0] % parts:
                raise ValueError(f"vectors need one width that is a multiple of {parts}")
            x = q.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if x.shape[1] and int(np.abs(x.astype(np.float64)).max()) >= min(1 << 31, (2**61 / x.shape[1]) ** 0.5):
                raise ValueError("a component is too large for exact sums of squares")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _binary(x.astype("<i4"))], ["vec_id", "label", "v"])

    return work


#: A row's state: codes, upper and lower bounds of its parts.
def _state(parts: int) -> np.dtype:
    return np.dtype([("code", "<u2", (parts,)), ("upper", "<f4", (parts,)), ("lower", "<f4", (parts,))])


def _step(before: list[np.ndarray] | None, books: list[np.ndarray], last: bool):
    """One round's pass over the vectors. before: the last round's codebooks, None in the first round."""
    parts = len(books)
    kind = _state(parts)

    def work(batches):
        bounds = [Bounds(None if before is None else before[p], books[p]) for p in range(parts)]
        sums, count = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"), "<i4").astype(np.int64).reshape(batch.num_rows, parts, -1)
            if x.shape[2] != books[0].shape[1]:
                raise ValueError("vectors need one width")
            s = np.zeros(batch.num_rows, kind)
            if before is None:
                s["upper"], s["lower"] = np.inf, 0
            else:
                s[:] = _matrix(batch.column("s"), "u1").view(kind)[:, 0]
            error = np.zeros(batch.num_rows, np.int64)
            for p, b in enumerate(bounds):
                code = s["code"][:, p].astype(np.int64)
                upper, lower = s["upper"][:, p].astype(np.float64), s["lower"][:, p].astype(np.float64)
                b.assign(x[:, p], code, upper, lower)
                s["code"][:, p] = code
                s["upper"][:, p] = np.nextafter(upper.astype("<f4"), np.float32(np.inf))
                s["lower"][:, p] = np.maximum(np.nextafter(lower.astype("<f4"), np.float32(-np.inf)), 0)
                if last:
                    error += ((x[:, p] - b.c[code]) ** 2).sum(1)
                else:
                    count[p] += np.bincount(code, minlength=len(b.c))
                    np.add.at(sums[p], code, x[:, p])
            if last:
                told = [r.tobytes().hex() for r in s["code"].astype("u1" if max(map(len, books)) <= 256 else ">u2")]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(told), pa.array(error)], ["vec_id", "label", "code", "error"])
            else:
                n = batch.num_rows
                none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("v"), _binary(s.view("u1").reshape(n, -1)), *none], [c.split()[0] for c in STATE.split(", ")])
        if not last:
            used = [(p, e) for p in range(parts) for e in np.flatnonzero(count[p]).tolist()]
            n = len(used)
            none = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.binary())]
            own = [pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()), pa.array([int(count[p][e]) for p, e in used], pa.int64()), pa.array([sums[p][e].tolist() for p, e in used], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*none, *own], [c.split()[0] for c in STATE.split(", ")])

    return work


def encode(vectors: DataFrame, entries: int = 256, rounds: int = 4, parts: int = 4, scale: int = 1024) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error of each vector that is kept, and the codebooks (a matrix of entries for each part)."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "quantizer")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding").filter(F.col("embedding").isNotNull() & whole)
    scaled = kept.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("q"))
    table = scratch.write(scaled.mapInArrow(tidied(_prepare(parts)), "vec_id long, label int, v binary"), "start")
    first = table.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # as many as a codebook has
    if not first:
        return spark.createDataFrame([], CODED), [np.empty((0, 0), np.int64)] * parts
    if len({len(r.v) for r in first}) > 1:
        raise ValueError("vectors need one width")
    start = np.stack([np.frombuffer(r.v, "<i4") for r in first]).astype(np.int64)
    books = [np.ascontiguousarray(b) for b in np.split(start, parts, axis=1)]
    before, name = None, "start"
    for r in range(rounds):
        table = scratch.write(table.mapInArrow(tidied(_step(before, books, False)), STATE), f"round{r}")
        scratch.drop(name)
        name, width = f"round{r}", books[0].shape[1]
        sums = table.filter(F.col("part").isNotNull()).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
        before, books = books, [b.copy() for b in books]
        for row in sums.collect():  # at most parts * entries rows
            books[row.part][row.entry] = [row[f"s{i}"] // row.n for i in range(width)]
        table = table.filter(F.col("v").isNotNull()).select("vec_id", "label", "v", "s")
    coded = scratch.write(table.mapInArrow(tidied(_step(before, books, True)), CODED), "coded")
    if rounds:
        scratch.drop(name)
    return coded, books


def digest(vectors: DataFrame, **how) -> DataFrame:
    """What op12 returns."""
    coded, books = encode(vectors, **how)
    told = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()
    sums = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    sums = Scratch(vectors.sparkSession, "label_errors").write(sums, "sums")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(told).alias("codebooks_sha256"))


def _round(r: int) -> str:
    """SQL of one assignment and one update; the last round has an assignment only."""
    return f"""
a{r} AS MATERIALIZED (
  SELECT rn, p, any_value(x) AS x, arg_min(e, d * 256 + e) AS e, min(d) AS d
  FROM (SELECT v.rn, v.p, v.x, c.e, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v JOIN c{r} c ON v.p = c.p)
  GROUP BY rn, p
),
c{r + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT p, e, list(y ORDER BY i) AS x FROM (
      SELECT p, e, i, floor(sum(x[i]) / count(*))::BIGINT AS y FROM a{r}, (SELECT unnest(range(1, 17)) AS i) GROUP BY p, e, i
    ) GROUP BY p, e) n ON n.p = c.p AND n.e = c.e
)"""


SQL = f"""
WITH v AS MATERIALIZED (
  SELECT rn, vec_id, label, p, list_transform(embedding[p * 16 + 1 : p * 16 + 16], lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS x
  FROM (SELECT *, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
       (SELECT unnest(range(4)) AS p)
),
c0 AS MATERIALIZED (SELECT p, rn - 1 AS e, x FROM v WHERE rn <= 256),
{",".join(_round(r) for r in range(5))},
coded AS (
  SELECT v.vec_id, any_value(v.label) AS label, string_agg(printf('%02x', a4.e), '' ORDER BY v.p) AS code, sum(a4.d)::BIGINT AS error
  FROM v JOIN a4 ON v.rn = a4.rn AND v.p = a4.p GROUP BY v.rn, v.vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM c4) AS codebooks_sha256
FROM coded
"""
