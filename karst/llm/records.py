"""Length-delimited binary records of token ids, in TFRecord framing, with a separate offset index.

A record: length (unsigned 64-bit), its masked CRC-32C, the payload, its masked CRC-32C, all little-endian.
A payload: doc_id (signed 64-bit, 0 for null), number of ids (unsigned 32-bit), 1 for a doc_id that isn't null,
bytes in an id (2 or 4), two zero bytes, the ids. Beside each file stands an index of its records' offsets (unsigned
64-bit), so that a reader can take records in any order. A manifest (a Parquet table) names the files of the
attempts that were committed, with their order, records and ids; files of lost or repeated attempts are not in it.

Null text counts as empty; an empty text is a record with the end id alone. Rows with equal doc_id stand side by
side, in order of a hash of their text and of it; null doc_id come first. An empty table gives an empty manifest and result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, buckets, slices, tidied
from .tokens import Encoder, tokenizer_path

#: The reversed Castagnoli polynomial and the mask's constant.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8

LANE = 256
HEADER = 16


class _Tables:
    """The CRC's linear steps over four and over LANE bytes, as tables of the state's halves."""

    made: tuple | None = None

    @classmethod
    def get(cls) -> tuple:
        if cls.made is None:
            one = np.arange(256, dtype=np.uint32)
            for _ in range(8):
                one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)

            def four(state):
                for _ in range(4):
                    state = one[state & 0xFF] ^ (state >> 8)
                return state

            half = np.arange(1 << 16, dtype=np.uint32)
            low, high = four(half), four(half << np.uint32(16))
            far_low, far_high = half, half << np.uint32(16)
            for _ in range(LANE // 4):
                far_low = low[far_low & 0xFFFF] ^ high[far_low >> 16]
                far_high = low[far_high & 0xFFFF] ^ high[far_high >> 16]
            cls.made = (low, high, far_low, far_high)
        return cls.made


def crc32c(payloads: list[bytes]) -> np.ndarray:
    """CRC-32C of each payload of four bytes or more, for all at once: lanes of 256 bytes, then their combination."""
    low, high, far_low, far_high = _Tables.get()
    size = np.fromiter(map(len, payloads), np.int64, len(payloads))
    lanes = -(-size // LANE)
    end = np.cumsum(lanes) * LANE
    padded = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)  # zeros in front leave a state of 0 as it is
    for p, n, e in zip(payloads, size, end, strict=True):
        padded[e - n : e] = np.frombuffer(p, np.uint8)
        padded[e - n : e - n + 4] ^= 0xFF
    grid = np.ascontiguousarray(padded.view("<u4").reshape(-1, LANE // 4).T)
    state = np.zeros(grid.shape[1], np.uint32)
    for row in grid:
        state ^= row
        state = low[state & 0xFFFF] ^ high[state >> 16]
    order = np.argsort(-lanes, kind="stable")
    first, count = (np.cumsum(lanes) - lanes)[order], lanes[order]
    total = np.zeros(len(order), np.uint32)
    for t in range(int(count[0]) if len(count) else 0):
        # the records with more than t lanes come first in this order
        k = int(np.searchsorted(-count, -t, side="left"))
        now = total[:k]
        total[:k] = far_low[now & 0xFFFF] ^ far_high[now >> 16] ^ state[first[:k] + t]
    out = np.empty_like(total)
    out[order] = ~total
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frame(payloads: list[bytes]) -> list[bytes]:
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    of_length, of_data = masked(crc32c(lengths)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [a + x.tobytes() + p + y.tobytes() for a, x, p, y in zip(lengths, of_length, payloads, of_data, strict=True)]


def unframe(data: bytes, offsets: np.ndarray) -> list[bytes]:
    """The payloads of the records at these offsets; raises where a checksum does not hold."""
    lengths = [data[o : o + 8] for o in offsets]
    sizes = [int.from_bytes(x, "little") for x in lengths]
    if any(o + 16 + n > len(data) for o, n in zip(offsets, sizes, strict=True)):
        raise ValueError("a record is cut off")
    payloads = [data[o + 12 : o + 12 + n] for o, n in zip(offsets, sizes, strict=True)]
    for what, shift in ((lengths, [8] * len(sizes)), (payloads, [12 + n for n in sizes])):
        told = np.array([int.from_bytes(data[o + s : o + s + 4], "little") for o, s in zip(offsets, shift, strict=True)], np.uint32)
        if (masked(crc32c(what)) != told).any():
            raise ValueError("a record's checksum does not hold")
    return payloads


def _place(uri: str):
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


MANIFEST = "part int, file string, records long, tokens long, bytes long"


def write_records(docs: DataFrame, root: str, path: str | None = None, end_id: int = 2, width: int = 2) -> DataFrame:
    """Writes the ids of all texts, in ascending doc_id, under root; returns the manifest, which is kept there too.

    width: bytes in an id; 2 suffices for up to 65,536 ids.
    """
    spark, path = docs.sparkSession, path or tokenizer_path()
    n = buckets(spark)

    def write(batches):
        encoder, part = Encoder.of(path), TaskContext.get().partitionId()
        files, where = _place(root)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        files.create_dir(f"{where}/data", recursive=True)
        out, at, tokens = None, [], 0
        size = 0
        for batch in batches:
            for rows in slices(batch, "text"):
                if out is None and rows.num_rows:
                    out = files.open_output_stream(f"{where}/data/{name}.records")
                ids, bounds = encoder.encode(rows.column("text"))
                payloads = []
                for r, doc_id in enumerate(rows.column("doc_id").to_pylist()):
                    own = np.append(ids[bounds[r] : bounds[r + 1]], np.uint32(end_id))
                    if width == 2 and own.max() > 0xFFFF:
                        raise ValueError("an id doesn't fit into 2 bytes; write with width=4")
                    payloads.append((doc_id or 0).to_bytes(8, "little", signed=True) + len(own).to_bytes(4, "little") + bytes([doc_id is not None, width, 0, 0]) + own.astype(f"<u{width}").tobytes())
                    tokens += len(own)
                for record in frame(payloads):
                    at.append(size)
                    size += len(record)
                    out.write(record)
        if out is not None:
            out.close()
            with files.open_output_stream(f"{where}/data/{name}.index") as index:
                index.write(np.array(at, "<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(at)], pa.int64()), pa.array([tokens], pa.int64()), pa.array([size], pa.int64())], ["part", "file", "records", "tokens", "bytes"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("spread"))
    # a doc_id with many rows, null for one, is cut into ranges of the hash
    order = [F.col("doc_id").asc_nulls_first(), F.col("spread")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    dealt.mapInArrow(tidied(write), MANIFEST).write.parquet(f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def read_records(spark: SparkSession, root: str, seed: int | None = None) -> DataFrame:
    """doc_id, start (ids of all records before it), n_tokens, ids (little-endian unsigned 32-bit) from the files.

    Checksums are verified. With a seed, each file's records come in an order drawn from it, by the index.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    before = F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # a row for each file
    files = manifest.withColumn("base", F.coalesce(before, F.lit(0)))

    def read(batches):
        store, where = _place(root)
        for batch in batches:
            for part, name, base in zip(*(batch.column(c).to_pylist() for c in ("part", "file", "base")), strict=True):
                with store.open_input_stream(f"{where}/data/{name}.index") as f:
                    at = np.frombuffer(f.read(), "<u8").astype(np.int64)
                with store.open_input_file(f"{where}/data/{name}.records") as f:
                    end = np.append(at[1:], f.size())
                    start = base
                    i = 0
                    while i < len(at):
                        j = max(i + 1, int(np.searchsorted(end, at[i] + (1 << 22), side="right")))
                        f.seek(int(at[i]))
                        payloads = unframe(f.read(int(end[j - 1] - at[i])), at[i:j] - at[i])
                        doc, first, count, data = [], [], [], []
                        for p in payloads:
                            n, known, width = int.from_bytes(p[8:12], "little"), p[12], p[13]
                            doc.append(int.from_bytes(p[:8], "little", signed=True) if known else None)
                            first.append(start)
                            count.append(n)
                            data.append(np.frombuffer(p, f"<u{width}", n, HEADER).astype("<u4").tobytes())
                            start += n
                        out = pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(first, pa.int64()), pa.array(count, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                        if seed is not None:
                            out = out.take(pa.array(np.random.default_rng([seed, part, i]).permutation(len(doc))))
                        yield out
                        i = j

    n = max(1, manifest.count())
    return files.select("part", "file", "base").repartition(n).mapInArrow(tidied(read), "doc_id long, start long, n_tokens long, ids binary")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """What op10 returns: each document's place and the checksum of its ids, as read back from the files."""
    spark = docs.sparkSession
    root = Scratch(spark, "records").root
    write_records(docs, root, path)
    return read_records(spark, root).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
