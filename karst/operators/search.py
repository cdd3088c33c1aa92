"""Retrieval: exact vector search, keyword search, reciprocal rank fusion and their combination."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karst.functions.scores import cosine


def live(chunks: DataFrame, documents: DataFrame, model: str, where: Column | None = None) -> DataFrame:
    """Chunks of one model with their live documents; filters reach both scans before the join."""
    d = documents.filter("deleted_at IS NULL")
    if where is not None:
        d = d.filter(where)
    return chunks.filter(F.col("embedding_model") == model).join(d, "document_id")


def vector_top(chunks: DataFrame, query: list[float], k: int, least: float | None = None) -> DataFrame:
    """The k chunks most alike to the query: similarity (six places) descending, then chunk_id. One scan, no index."""
    scored = chunks.withColumn("similarity", F.round(cosine(F.col("embedding"), query), 6))
    if least is not None:
        scored = scored.filter(F.col("similarity") >= least)
    return scored.orderBy(F.col("similarity").desc(), "chunk_id").limit(k)


def why_empty(chunks: DataFrame, documents: DataFrame, model: str, query: list[float], least: float, where: Column) -> DataFrame:
    """One row: chunks that are indexed, alike enough, and alike enough but filtered out; and the reason."""
    c = live(chunks, documents, model).withColumn("ok", F.coalesce(where, F.lit(False))).withColumn("alike", F.round(cosine(F.col("embedding"), query), 6) >= least)
    n = c.agg(F.count(F.lit(1)).alias("indexed"), F.count_if("alike").alias("alike"), F.count_if(F.col("alike") & ~F.col("ok")).alias("excluded"))
    return n.withColumn("reason", F.when(F.col("indexed") == 0, "nothing indexed").when(F.col("alike") == 0, "nothing similar").when(F.col("excluded") == F.col("alike"), "filters excluded all").otherwise("found"))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits: no stemming, no stop words."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def keyword_top(rows: DataFrame, text: str, key: str, k: int, all_of: Sequence[str], any_of: Sequence[str] = (), none_of: Sequence[str] = (), phrases: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Rows that have all words (and any of some, and none of others, and the phrases), by share of their words that
    are asked for (nine places), then key."""
    t = rows.withColumn("__t", tokens(F.col(text)))
    hit = F.lit(True)
    for w in all_of:
        hit = hit & F.array_contains("__t", w)
    if any_of:
        hit = hit & F.arrays_overlap("__t", F.array(*map(F.lit, any_of)))
    if none_of:
        hit = hit & ~F.arrays_overlap("__t", F.array(*map(F.lit, none_of)))
    for p in phrases:
        hit = hit & F.concat(F.lit(" "), F.array_join("__t", " "), F.lit(" ")).contains(f" {' '.join(p)} ")
    asked = F.array(F.lit(""), *map(F.lit, [*all_of, *any_of, *(w for p in phrases for w in p)]))
    rank = F.round(F.size(F.filter("__t", lambda x: F.array_contains(asked, x))) / F.nullif(F.size("__t"), F.lit(0)), 9)
    return t.filter(hit).withColumn("rank_score", F.coalesce(rank, F.lit(0.0))).drop("__t").orderBy(F.col("rank_score").desc(), key).limit(k)


_ASKED = re.compile(r'(-?)"([^"]*)"|(-?)(\S+)')


def websearch(query: str) -> list[list[tuple[bool, tuple[str, ...]]]]:
    """Alternatives of a web search, each a list of (wanted, words): words beside each other are all asked for, quoted ones as
    a phrase, those after - must be absent, and `or` divides alternatives."""
    found: list = [[]]
    for no, quoted, minus, word in _ASKED.findall(query):
        if word.lower() == "or":
            found.append([])
            continue
        words = tuple(re.findall(r"[^\W_]+", (quoted or word).lower()))
        if words:
            found[-1].append((not (no or minus), words))
    return [terms for terms in found if terms]


def keyword_search(rows: DataFrame, text: str, key: str, k: int, query: str) -> DataFrame:
    """Rows that a web search finds, by rank (nine places), then key.

    A term that occurs n times gives 1 + 1/4 + ... + 1/n**2, over pi**2 / 6 and by 0.1, the weight of plain text; the rank
    is the mean over the query's wanted terms: the published frequency rank for alternatives, here for all queries.
    A query without words finds nothing.
    """
    groups = websearch(query)
    t = rows.withColumn("__t", F.concat(F.lit(" "), F.array_join(tokens(F.col(text)), "  "), F.lit(" ")))
    # words stand between two spaces of their own, so that neighbouring occurrences are counted apart
    shape = lambda words: " " + "  ".join(words) + " "
    hit = F.lit(False)
    for terms in groups:
        every = F.lit(True)
        for wanted, words in terms:
            here = F.col("__t").contains(shape(words))
            every = every & (here if wanted else ~here)
        hit = hit | every
    wanted = list(dict.fromkeys(words for terms in groups for ok, words in terms if ok))
    score = F.lit(0.0)
    for words in wanted:
        times = F.regexp_count("__t", F.lit(shape(words)))
        score = score + F.aggregate(F.sequence(F.lit(0), times), F.lit(0.0), lambda s, i: s + F.when(i > 0, 1.0 / (i * i)).otherwise(0.0))
    rank = F.round(score * 0.1 / 1.64493406685 / max(1, len(wanted)), 9)
    return t.filter(F.coalesce(hit, F.lit(False))).withColumn("rank_score", rank).drop("__t").orderBy(F.col("rank_score").desc(), key).limit(k)


def ranked(leg: DataFrame, name: str, key: str, *order: Column) -> DataFrame:
    """key, leg, rank (from 1) of a leg, which a top-k has made small."""
    return leg.select(F.col(key), F.lit(name).alias("leg"), F.row_number().over(W.orderBy(*order, F.col(key))).alias("rank"))


def fuse(legs: DataFrame, key: str, k: int = 60, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of rows (key, leg, rank): key, rrf_score, legs. Ties go to the lesser key."""
    if k <= 0:
        raise ValueError("k is positive")
    out = legs.groupBy(key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf_score"), F.array_join(F.array_sort(F.collect_list(F.concat("leg", F.lit("="), "rank"))), ",").alias("legs"))
    return out if top is None else out.orderBy(F.col("rrf_score").desc(), key).limit(top)
