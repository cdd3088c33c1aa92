"""A stored keyword index: for each word and document the positions of the word, sorted by word.

Postings are dealt out in ranges of (word, key), so a word that many documents have is spread over files, and stand sorted
by word in them, so that a search reads the row groups of the words asked for only (their statistics are kept by the file
format), never a text. A search gives the rows and ranks of keyword_search; phrases are found by positions.

Rows with a null text or key are left out, an empty text has no words. Rows with equal keys are one document to a search, which
puts their postings together; their words stand over each other, so keys should be unique. An empty table gives an index that finds nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.operators.search import tokens, websearch
from karst.sources.shared import place, put


def _by_word(batches):
    """Of rows (key, t): key, words (how many), terms (each different word) and positions (where each stands, in order)."""
    for b in batches:
        lists = b.column("t")
        words = lists.flatten().dictionary_encode()
        n = lists.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(b.num_rows), n)
        position = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
        both = row * max(1, len(words.dictionary)) + words.indices.to_numpy()
        order = np.argsort(both, kind="stable")
        first = np.flatnonzero(np.diff(both[order], prepend=-1))
        terms = words.dictionary.take(words.indices.take(pa.array(order[first])))
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(position[order], pa.int32()))
        of_row = pa.array(np.searchsorted(row[order[first]], np.arange(b.num_rows + 1)), pa.int32())
        own = [b.column("key"), pa.array(n, pa.int32()), pa.ListArray.from_arrays(of_row, terms), pa.ListArray.from_arrays(of_row, positions)]
        yield pa.RecordBatch.from_arrays(own, ["key", "words", "terms", "positions"])


def build(rows: DataFrame, text: str, key: str, folder: str, parts: int | None = None) -> None:
    """Writes folder/postings (term, key, positions) and folder/documents (key, words).

    Texts are cut into words once, into a table of each row's words that goes when the index is there.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), tokens(F.col(text)).alias("t"))
    schema = T.StructType([cut.schema["key"], *T.StructType.fromDDL("words int, terms array<string>, positions array<array<int>>").fields])
    by_row = put(cut.mapInArrow(_by_word, schema), f"{folder}/rows")
    by_row.select("key", "words").write.option("compression", "zstd").parquet(f"{folder}/documents")
    postings = by_row.select("key", F.inline(F.arrays_zip("terms", "positions")).alias("term", "positions")).select("term", "key", "positions")
    dealt = postings.repartitionByRange(parts, "term", "key").sortWithinPartitions("term", "key")
    dealt.write.options(**{"compression": "zstd", "parquet.block.size": str(8 << 20)}).parquet(f"{folder}/postings")
    fs, where = place(spark, f"{folder}/rows")
    fs.delete(where, True)


def opened(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/documents")


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


def occurrences(lists: list[Column]) -> Column:
    """How often words stand in a row, of their sorted positions; as a regular expression counts, without overlaps."""
    if len(lists) == 1:
        return F.coalesce(F.size(lists[0]), F.lit(0))
    starts = lists[0]
    for i, own in enumerate(lists[1:], 1):
        starts = F.array_intersect(starts, _shifted(own, i))
    n = len(lists)
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("free"))
    step = lambda s, x: F.when(x >= s["free"], F.struct((s["n"] + 1).alias("n"), (x + n).alias("free"))).otherwise(s)
    return F.coalesce(F.aggregate(F.sort_array(starts), start, step)["n"], F.lit(0))


def asked(postings: DataFrame, words: list[str]) -> DataFrame:
    """key and found (positions by word) of the documents that have any of the words; reads those words' postings only."""
    hits = postings.filter(F.col("term").isin(words)).groupBy("key", "term").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))  # rows with equal keys
    return hits.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("found"))


def search(spark: SparkSession, folder: str, query: str, k: int, live: DataFrame | None = None) -> DataFrame:
    """key, rank_score of the k first documents that a web search finds (see keyword_search). live: keys to look among."""
    groups = websearch(query)
    postings, documents = opened(spark, folder)
    words = sorted({w for terms in groups for _, ws in terms for w in ws})
    if not words:
        return documents.limit(0).select("key", F.lit(0.0).alias("rank_score"))
    rows = asked(postings, words)
    if any(not any(ok for ok, _ in terms) for terms in groups):  # an alternative that only excludes looks at all documents
        rows = documents.select("key").distinct().join(rows, "key", "left")
    if live is not None:
        rows = rows.join(live, "key", "left_semi")
    counted = {ws: f"n{i}" for i, ws in enumerate(dict.fromkeys(ws for terms in groups for _, ws in terms))}
    rows = rows.select("key", *[occurrences([F.col("found")[w] for w in ws]).alias(name) for ws, name in counted.items()])
    hit = F.lit(False)
    for terms in groups:
        every = F.lit(True)
        for wanted, ws in terms:
            every = every & ((F.col(counted[ws]) > 0) if wanted else (F.col(counted[ws]) == 0))
        hit = hit | every
    wanted = list(dict.fromkeys(ws for terms in groups for ok, ws in terms if ok))
    score = F.lit(0.0)
    for ws in wanted:
        times = F.sequence(F.lit(0), F.col(counted[ws]))
        score = score + F.aggregate(times, F.lit(0.0), lambda s, i: s + F.when(i > 0, 1.0 / (i * i)).otherwise(0.0))
    rank = F.round(score * 0.1 / 1.64493406685 / max(1, len(wanted)), 9)
    return rows.filter(hit).select("key", rank.alias("rank_score")).orderBy(F.col("rank_score").desc(), "key").limit(k)
