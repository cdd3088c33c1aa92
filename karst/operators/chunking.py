"""Chunks of texts: sections by headings, blocks by blank lines and fences, filled up to a number of words.

Lines are rows. What a line is in (a fence, a section, a block) comes from windows over its text's lines; which chunk a
piece goes to is a fold over numbers of words, and texts are put together only in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karst.functions.text import token_count

from .folds import EMPTY, fill, folded

#: A line that opens or closes a fence, and a heading.
FENCE = r"^\s*(?:```|~~~)"
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
WORDS = r"\S+"


def sectioned(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each line: key, pos, line, kind (text, fence, heading or blank), section (its number), heading_path.

    Blank lines and headings inside of a fence are text. A heading's path has the last heading of each higher level that
    no heading of a level above that has ended.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    so_far = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    fence = F.col("line").rlike(FENCE)
    marked = lines.withColumn("fence", fence).withColumn("fences", F.count_if("fence").over(so_far))
    inside = F.col("fence") | (F.col("fences") % 2 == 1)
    kind = F.when(inside, F.when(F.col("fence"), "fence").otherwise("text")).when(F.col("line").rlike(HEADING), "heading").when(~F.col("line").rlike(r"\S"), "blank").otherwise("text")
    found = marked.withColumn("kind", kind)
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", HEADING, 1)))
    title = F.trim(F.regexp_extract("line", HEADING, 2))
    found = found.withColumn("level", level).withColumn("section", F.count("level").over(so_far).cast("int"))
    titles = []
    for n in range(1, 7):
        last = F.max(F.when(F.col("level") == n, F.struct("pos", title.alias("title")))).over(so_far)
        higher = F.max(F.when(F.col("level") < n, F.col("pos"))).over(so_far)
        titles.append(F.when(last["pos"] > F.coalesce(higher, F.lit(-1)), last["title"]))
    path = F.array_join(F.array_compact(F.array(*titles)), " > ")
    return found.select(key, "pos", "line", "kind", "section", F.nullif(path, F.lit("")).alias("heading_path"))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _joined(parts: Column, by: str) -> Column:
    """Texts of an array of (place, text), in order."""
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["x"]), by)


def chunks(docs: DataFrame, key: str, text: str, tokens: int = 256, overlap: int = 32) -> DataFrame:
    """key, chunk_index, content, heading_path, token_count: chunks of about `tokens` words within sections; each but a
    section's first begins with the last `overlap` words of the one before.

    A block that is too long is cut into pieces of whole lines, a line that is too long into runs of words. Null and
    blank texts have no chunks. Rows with equal or null keys are cut each by itself.
    """
    if tokens < 8 or not 0 <= overlap < tokens:
        raise ValueError("a chunk has 8 words or more, and overlaps by less than that")
    name, key = key, "__row"
    docs = docs.select(F.struct(F.col(name).alias("key"), F.monotonically_increasing_id().alias("row")).alias(key), F.col(text).alias(text))
    so_far = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    lines = sectioned(docs, key, text).withColumn("block", F.count_if(F.col("kind").isin("blank", "heading")).over(so_far)).filter(~F.col("kind").isin("blank", "heading"))
    words = F.regexp_extract_all("line", F.lit(WORDS), F.lit(0))
    sized = lines.withColumn("n", token_count(F.col("line"))).withColumn("whole", F.sum("n").over(W.partitionBy(key, "block"))).filter("whole > 0")
    runs = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / tokens)), lambda i: F.array_join(F.slice(words, (i * tokens + 1).cast("int"), tokens), " "))
    long = F.col("n") > tokens
    units = sized.select(key, "pos", "section", "heading_path", "block", "whole", long.alias("long"), F.posexplode(F.when(long, runs).otherwise(F.array("line"))).alias("run", "unit"))
    units = units.withColumn("n", token_count(F.col("unit")))
    order = W.partitionBy(key).orderBy("pos", "run")
    fresh = (F.col("block") != F.lag("block", 1, -1).over(order)) | F.col("long") | F.lag("long", 1, False).over(order)
    # a block that fits is one piece
    fits = F.col("whole") <= tokens
    units = units.withColumn("fresh", fresh).withColumn("counted", F.when(fits, 0).otherwise(F.col("n")))
    pieces = folded(units, [key], ["pos", "run"], ["counted", "fresh"], EMPTY, fill(tokens), "piece int")
    pieces = pieces.groupBy(key, "section", "heading_path", "piece").agg(F.sum("n").alias("n"), _joined(F.collect_list(F.struct("pos", "run", F.col("unit").alias("x"))), "\n").alias("x"))
    first = F.col("section") != F.lag("section", 1, -1).over(W.partitionBy(key).orderBy("piece"))
    numbered = folded(pieces.withColumn("fresh", first), [key], ["piece"], ["n", "fresh"], EMPTY, fill(tokens, overlap), "chunk_index int")
    bodies = numbered.groupBy(key, "section", "heading_path", "chunk_index").agg(_stripped(_joined(F.collect_list(F.struct("piece", "x")), "\n\n")).alias("body"))
    before = F.regexp_extract_all(F.lag("body").over(W.partitionBy(key, "section").orderBy("chunk_index")), F.lit(WORDS), F.lit(0))
    tail = F.array_join(F.slice(before, F.greatest(F.size(before) - overlap + 1, F.lit(1)), F.lit(overlap)), " ") if overlap else F.lit(None).cast("string")
    content = F.concat_ws("\n\n", F.nullif(tail, F.lit("")), "body")
    return bodies.withColumn("content", content).select(F.col(key)["key"].alias(name), "chunk_index", "content", "heading_path", token_count(F.col("content")).cast("int").alias("token_count"))
