"""Lookups of the knowledge base: entities, summaries, stored models, addresses, envelopes, and a search for many queries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grounding import permitted

# --------------------------------------------------------------------------- entities and summaries


def first_by_name(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """For each name (in any case) the entity of the first type, with its document's title if it has a live one."""
    one = entities.groupBy(F.lower("name").alias("name")).agg(F.min_by(F.struct("id", "entity_type", "document_id"), F.struct("entity_type", "id")).alias("e")).select("name", "e.*")
    d = documents.filter("deleted_at IS NULL").select(F.col("document_id").alias("__d"), "title")
    return one.join(d, F.col("document_id") == F.col("__d"), "left").drop("__d")


def summaries_permitted(provenance: DataFrame, grants: DataFrame, documents: DataFrame, principals: Sequence[str]) -> DataFrame:
    """subject, n: summaries whose every source document (a row subject, document_id each) a principal may read."""
    may = permitted(provenance.select("document_id").distinct(), grants, documents, principals).select(F.col("document_id").alias("__may"))
    seen = provenance.join(may, F.col("document_id") == F.col("__may"), "left")
    return seen.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count("__may").alias("__ok")).filter("n = __ok").drop("__ok")


# --------------------------------------------------------------------------- the vector store


def stored_models(chunks: DataFrame) -> DataFrame:
    """embedding_model, chunks, least and most dimensions; a store is fit for search if this is one row with equal widths."""
    width = F.size("embedding")
    return chunks.groupBy("embedding_model").agg(F.count(F.lit(1)).alias("chunks"), F.min(width).alias("least"), F.max(width).alias("most"))


def to_reembed(chunks: DataFrame, model: str) -> DataFrame:
    """Chunks whose vectors are not of the model, or that have none: what a resumed run still has to do."""
    return chunks.filter(~F.col("embedding_model").eqNullSafe(model))


def whole_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows with a vector all of whose components are finite numbers."""
    return rows.filter(F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def vector_top_each(queries: DataFrame, rows: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """query, id, similarity (six places), place: the k rows most alike to each query, ties by id; exact.

    Both have id and embedding; rows without a whole vector are left out, vectors of different widths raise an error. They
    are dealt into blocks of about `block` rows; a task multiplies one block of each and gives the k best of every query, so
    what is shuffled is k rows for a query and block, and memory is two blocks.
    """

    def blocks(df: DataFrame, name: str) -> DataFrame:
        df = whole_vectors(df)
        n = -(-df.count() // block) or 1
        at = F.pmod(F.xxhash64("id", "embedding"), F.lit(n))  # an id that many rows share is spread by their vectors
        return df.groupBy(at.alias(name)).agg(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))).alias(f"{name}_rows"))

    def best(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q, r = (batch.column(c)[i].values for c in ("q_rows", "r_rows"))
                ids = [x.field("id").to_numpy() for x in (q, r)]
                lists = [x.field("v") for x in (q, r)]
                widths = {w for x in lists for w in np.diff(x.offsets.to_numpy()).tolist()}
                if len(widths) > 1:
                    raise ValueError(f"vectors of widths {sorted(widths)}")
                vectors = [x.flatten().to_numpy().reshape(len(x), -1) for x in lists]
                a, b = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in vectors)
                for query, row in zip(ids[0], np.round(a @ b.T, 6), strict=True):
                    top = np.lexsort((ids[1], -row))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), query)), pa.array(ids[1][top]), pa.array(row[top])], ["query", "id", "similarity"])

    # blocks of the stated queries against blocks of all rows, not rows against rows
    pairs = blocks(queries, "q").crossJoin(blocks(rows, "r")).select("q_rows", "r_rows")
    found = pairs.mapInArrow(best, "query long, id long, similarity double")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.col("similarity").desc(), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


# --------------------------------------------------------------------------- addresses


def origin(url: Column) -> Column:
    """scheme://host/ of a URL, null if it has none."""
    found = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)", 1)
    return F.when(found != "", F.concat(found, F.lit("/")))


def resource_name(address: Column) -> Column:
    """The last part of a resource's address, after / or :."""
    return F.regexp_extract(address, "[^/:]*$", 0)


# --------------------------------------------------------------------------- documents


def reassembled(chunks: DataFrame, most: int = 20_000, by: str = "\n\n") -> DataFrame:
    """document_id, chunks, body (its chunks in order, cut to `most` characters), truncated and a warning where it is cut."""
    if not 500 <= most <= 100_000:
        raise ValueError("most is from 500 to 100,000")
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    whole = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.array_join(F.transform(parts, lambda x: x["content"]), by).alias("__body"))
    cut = F.length("__body") > most
    return whole.select("document_id", "chunks", F.substring("__body", 1, most).alias("body"), cut.alias("truncated"), F.when(cut, F.lit(f"content truncated at {most} chars")).alias("warning"))


# --------------------------------------------------------------------------- answers


def conflicts(graded: DataFrame) -> DataFrame:
    """The claims whose sources differ, with every value that they give."""
    return graded.filter("verdict = 'CONFLICT'").select("query", "first_pos", "positions")


def envelope(graded: DataFrame) -> DataFrame:
    """query, claims, grounded, insufficient: an answer has too little evidence if no claim is above UNKNOWN."""
    n = graded.groupBy("query").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("verdict") != "UNKNOWN").alias("grounded"))
    return n.withColumn("insufficient", F.col("grounded") == 0)


def stated_value(text: Column, label: str = "status") -> Column:
    """What stands behind `label:` up to the end of the line or sentence, else the whole text."""
    found = F.trim(F.regexp_extract(text, rf"(?i)\b{label}\s*:\s*([^\n.;]+)", 1))
    return F.coalesce(F.nullif(found, F.lit("")), text)
