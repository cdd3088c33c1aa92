"""Embedding of texts by a model that each Python worker loads once, and re-embedding that goes on where it stopped."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.functions.text import embed_input
from karst.sources.shared import place
from karst.sources.snapshots import Store

#: A loaded model: texts to a matrix with a row for each.
Model = Callable[[list[str]], np.ndarray]


@dataclass(frozen=True)
class Provider:
    """What tasks need to embed. load is called once a Python worker, so it must be a function that workers can import or that
    pickles by value. long: what becomes of a text of more than max_words words: "cut" to its first, "mean" of its runs of so
    many words, or "refuse"."""

    model_id: str
    dimensions: int
    load: Callable[[], Model]
    max_words: int = 512
    normalize: bool = True
    query_prefix: str = ""
    passage_prefix: str = ""
    long: str = "cut"

    def __post_init__(self):
        if self.long not in ("cut", "mean", "refuse"):
            raise ValueError("long is cut, mean or refuse")


_loaded: dict[str, Model] = {}


def _model(provider: Provider) -> Model:
    if provider.model_id not in _loaded:
        _loaded[provider.model_id] = provider.load()
    return _loaded[provider.model_id]


def vectors(provider: Provider, texts: list[str], prefix: str) -> np.ndarray:
    """A row for each text; runs in tasks, and on the driver for one query."""
    pieces, owner = [], []
    for i, text in enumerate(texts):
        words = re.findall(r"\S+", text)
        if len(words) <= provider.max_words:
            own = [text]
        elif provider.long == "refuse":
            raise ValueError(f"a text of {len(words)} words, where {provider.max_words} are the most")
        else:
            runs = [" ".join(words[k : k + provider.max_words]) for k in range(0, len(words), provider.max_words)]
            own = runs[:1] if provider.long == "cut" else runs
        pieces += [prefix + p for p in own]
        owner += [i] * len(own)
    got = np.asarray(_model(provider)(pieces), float).reshape(len(pieces), -1)
    if len(pieces) and got.shape[1] != provider.dimensions:
        raise ValueError(f"model {provider.model_id} gave {got.shape[1]} numbers a text, not {provider.dimensions}")
    out = np.zeros((len(texts), provider.dimensions))
    np.add.at(out, owner, got)
    out /= np.maximum(np.bincount(owner, minlength=len(texts)), 1)[:, None]
    if provider.normalize:
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)
    return out


def query_vector(provider: Provider, text: str) -> list[float]:
    return vectors(provider, [text], provider.query_prefix)[0].tolist()


def embedded(rows: DataFrame, text: Column, provider: Provider, batch: int = 64) -> DataFrame:
    """Rows with embedding and embedding_model, which replace columns of these names; a null text has a null vector. The model
    gets `batch` texts at a time, whatever the size of Arrow's batches."""
    kept = rows.drop("embedding", "embedding_model")
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embedding_model", T.StringType())])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                texts = part.column("__text").to_pylist()
                known = [t for t in texts if t is not None]
                made = iter(vectors(provider, known, provider.passage_prefix).astype(np.float32).tolist())
                own = pa.array([None if t is None else next(made) for t in texts], pa.list_(pa.float32()))
                model = pa.array([provider.model_id] * part.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), own, model], schema.names)

    return kept.withColumn("__text", text).mapInArrow(run, schema)


# --------------------------------------------------------------------------- the store's model


class MixedStore(ValueError):
    """The store's vectors aren't all of one model."""


def serving(chunks: DataFrame, model: str, dimensions: int) -> DataFrame:
    """The chunks, which fail the job that reads them, at the first row with a vector of another model or width: vectors of two
    spaces aren't compared. Rows without a vector pass."""
    fits = F.col("embedding").isNull() | (F.col("embedding_model").eqNullSafe(model) & (F.size("embedding") == dimensions))
    told = F.concat(F.lit("the store has vectors of model "), F.coalesce("embedding_model", F.lit("none")), F.lit(" and width "), F.size("embedding").cast("string"), F.lit(f", not {model} and {dimensions}: re-embed it first"))
    return chunks.filter(F.when(fits, True).otherwise(F.raise_error(told).cast("boolean")))


def reembed(store: Store, provider: Provider, live: DataFrame | None = None, parts: int = 16, table: str = "chunks", most: int | None = None) -> dict[str, int]:
    """Gives a store's chunks (chunk_id, heading_path, content, embedding, embedding_model) vectors of a model, part by part.

    Parts (by a hash of chunk_id) are written beside the store's tables, for the version they come from, each whole or not at
    all; a later run writes those that are missing and then commits the next version. If no chunk needs it nothing is written.
    live: document_ids whose chunks are re-embedded; others stay as they are. most: parts a run writes.
    Returns how many parts were written and found, and the version that is current then.
    """
    spark, base = store.spark, store.version()
    chunks = store.read(table, base)
    due = chunks.filter(~F.col("embedding_model").eqNullSafe(provider.model_id))
    if live is not None:
        due = due.join(live.select("document_id").distinct(), "document_id", "left_semi").select(*chunks.columns)
    if not due.limit(1).count():
        return {"written": 0, "found": 0, "version": base}
    name = hashlib.sha256(f"{provider.model_id}/{parts}".encode()).hexdigest()[:16]
    folder = f"{store.root}/reembed/{base}-{name}"
    done = lambda i: place(spark, f"{folder}/{i}/_SUCCESS")
    found = [i for i in range(parts) if (lambda fs, p: fs.exists(p))(*done(i))]
    todo = [i for i in range(parts) if i not in found][:most]
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(parts))
    for i in todo:
        made = embedded(due.filter(part == i), embed_input(F.col("heading_path"), F.col("content")), provider)
        made.select("chunk_id", "embedding", "embedding_model").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{i}")
    if len(found) + len(todo) < parts:
        return {"written": len(todo), "found": len(found), "version": base}
    fresh = spark.read.schema("chunk_id long, embedding array<float>, embedding_model string").parquet(*[f"{folder}/{i}" for i in range(parts)])
    fresh = fresh.select(F.col("chunk_id").alias("__id"), F.col("embedding").alias("__v"), F.col("embedding_model").alias("__m"))
    both = chunks.withColumn("embedding", F.col("embedding").cast("array<float>")).join(fresh, F.col("chunk_id") == F.col("__id"), "left")
    pick = lambda new, old: F.when(F.col("__id").isNotNull(), F.col(new)).otherwise(F.col(old))
    out = both.withColumns({"embedding": pick("__v", "embedding"), "embedding_model": pick("__m", "embedding_model")}).select(*chunks.columns)
    version = store.commit({table: out}, base, {"embedding_model": provider.model_id})
    fs, where = place(spark, folder)
    fs.delete(where, True)
    return {"written": len(todo), "found": len(found), "version": version}


# --------------------------------------------------------------------------- embedding by hashing


def hashed(size: int = 64, **options) -> Provider:
    """The provider that needs no weights: each word adds or takes 1 at a place that its digest tells."""

    def load() -> Model:
        places: dict[str, tuple[int, float]] = {}

        def one(text: str) -> np.ndarray:
            out = np.zeros(size)
            for word in re.findall(r"\w+", text.lower()):
                if word not in places:
                    digest = hashlib.sha256(word.encode()).digest()
                    places[word] = int.from_bytes(digest[:4], "big") % size, 1.0 if digest[4] & 1 else -1.0
                at, sign = places[word]
                out[at] += sign
            if not out.any():
                out[0] = 1.0
            return out

        return lambda texts: np.array([one(t) for t in texts])

    return Provider(options.pop("model_id", f"hashed-{size}"), size, load, **options)


def word_buckets(rows: DataFrame, key: str, words: Column, size: int = 64) -> DataFrame:
    """key, bucket, n: how many of a key's words (an array) have a digest whose first four bytes fall on a bucket.

    Words are hashed where their row is, each different one of a batch once, so that only counts are shuffled. Null arrays have
    no words; rows with equal keys count together.
    """

    def count(batches):
        for b in batches:
            lists = b.column("__words")
            words = lists.flatten().dictionary_encode()
            place = np.array([int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "big") % size for w in words.dictionary.to_pylist()], np.int64)
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            n = np.bincount(row * size + place[words.indices.to_numpy()], minlength=b.num_rows * size)
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(cell // size)), pa.array(cell % size), pa.array(n[cell])], [key, "bucket", "n"])

    long = T.LongType()
    schema = T.StructType([rows.schema[key], T.StructField("bucket", long), T.StructField("n", long)])
    return rows.select(key, words.alias("__words")).mapInArrow(count, schema).groupBy(key, "bucket").agg(F.sum("n").alias("n"))
