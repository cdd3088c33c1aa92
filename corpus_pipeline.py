"""A corpus pipeline: quality rules, near-dedup, substring dedup, a mix to target weights, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes it as Parquet in the shared folder and
reads it again as the next stage's docs. All stages but the last return the columns of documents; the last returns
packed pieces with their ids and places.

A stage begins by dropping the scratch tables of the stage before it, whose result is written by then.

In all stages an empty table gives an empty result with the same columns, texts are read whole however long they are, rows
that are equal in all columns are rows of their own, and columns beside those of documents are kept as they are, whatever
their names (the last stage returns its own columns only).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from karst.llm import minhash, mixing, packing, quality, suffixes
from karst.llm.common import Scratch, documents

_left: list[Scratch] = []


def _stage(f: Callable) -> Callable:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            _left.pop().drop()
        before = len(Scratch.made)
        out = f(spark, docs, sf_dir)
        _left.extend(Scratch.made[before:])
        del Scratch.made[before:]
        return out

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust outlier rule reject go.

    A null or empty text has no words and goes by the base rules. Null lang or source is a value of its own. Equal rows
    stay or go together; a distance equal to the bound stays.
    """
    return quality.keep(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that with the least doc_id.

    Null and empty texts are equal texts. Null doc_id counts as the largest. Of rows with equal doc_id in a class any one
    stays.
    """
    return minhash.keep_one(docs)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by repeated strings are cut out of the texts; all documents stay.

    A null text stays null, an empty one empty; a text may become empty. n_chars is counted anew where the text changes. Of
    equal texts that are long enough nothing stays, but the stage before this one leaves one of each.
    """
    return suffixes.cut(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null or empty text has no words, so it is taken as often as its place along its source falls on, and adds none. Null
    sources are one source. Documents of equal size stand in order of a hash, so reruns agree.
    """
    return mixing.mix(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as packed pieces: doc_id, piece, start, length, ids (2 bytes each), sequence_id, offset.

    A null or empty text is one piece, its end id. Pieces of equal length take places in any order. Null doc_id stays null.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: No SQL: the robust fits, the near-duplicate classes and the tokenizer aren't SQL's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    written = Scratch(spark, "pipeline", kept=True)
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = written.write(out, name)
        if i:
            written.drop(STAGES[i - 1][0])
    return docs
