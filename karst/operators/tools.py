"""Read operators of the source systems, on tables of their rows: policy, decoding, lookups, nested results, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karst.functions.text import glob_regex

# --------------------------------------------------------------------------- policy and identity


#: A data stream's prefix, a rollover number, a date, a rollover number; what is taken off in this order.
INDEX_PARTS = (r"^\.ds-", r"-\d{6}$", r"-\d{4}[.\-]\d{2}(?:[.\-]\d{2})?$", r"-\d{6}$")


def all_known_true(*conditions: Column) -> Column:
    """True only if every condition is known and true; null never passes."""
    out = F.lit(True)
    for c in conditions:
        out = out & c.eqNullSafe(True)
    return out


def restricted_by_ancestors(pages: DataFrame, key: str, restricted: str) -> DataFrame:
    """key, restricted: null if any ancestor could not be read, else whether any is restricted."""
    return pages.groupBy(key).agg(F.when(F.count(F.lit(1)) > F.count(restricted), F.lit(None).cast("boolean")).otherwise(F.bool_or(restricted)).alias("restricted"))


def index_family(name: Column) -> Column:
    """The name that an index's generations share: without data-stream prefix, rollover number and date."""
    out = name
    for part in INDEX_PARTS:
        out = F.regexp_replace(out, part, "")
    return F.coalesce(F.nullif(out, F.lit("")), name)


def stable_id(kind: str, *parts: Column) -> Column:
    """The id under which a source's item is stored."""
    if kind == "issue":
        return F.upper(F.trim(parts[0]))
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def host_allowed(url: Column, patterns: Sequence[str]) -> Column:
    """Whether a URL's host matches a glob of the list; denied without a host or a list."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    hit = F.lit(False)
    for p in patterns:
        hit = hit | host.rlike(glob_regex(p.lower()))
    return F.coalesce(hit & (host != ""), F.lit(False))


# --------------------------------------------------------------------------- decoding


def tail(text: Column, most: int) -> Column:
    """The longest end of at most so many UTF-8 bytes that cuts no character."""
    raw, n = text.cast("binary"), F.octet_length(text)
    tries = [F.try_validate_utf8(F.substring(raw, n - F.lit(most - k) + 1, F.lit(most - k)).cast("string")) for k in range(4) if most - k > 0]
    return F.when(n <= most, text).otherwise(F.coalesce(*tries, F.lit("")))


def truncated(text: Column, most: int) -> Column:
    """The longest beginning of at most so many UTF-8 bytes that cuts no character."""
    raw = text.cast("binary")
    tries = [F.try_validate_utf8(F.substring(raw, 1, max(most - k, 0)).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*tries))


def decoded(value: Column, fmt: str = "auto", partial: bool = False) -> Column:
    """Bytes as a struct (format, text): json for the text of an object or array, utf8 for other text, or base64 for what isn't
    UTF-8. fmt: auto or json, utf8 (no look for JSON), or base64 for all. partial: the value was cut off, so up to three bytes
    of a character at its end may go."""
    if fmt not in ("auto", "json", "utf8", "base64"):
        raise ValueError(f"no format {fmt}")
    size = F.octet_length(value)
    cuts = [value] + ([F.substring(value, F.lit(1), F.greatest(size - i, F.lit(0))) for i in (1, 2, 3)] if partial else [])
    found = F.coalesce(*[F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")) for c in cuts]) if fmt != "base64" else F.lit(None).cast("string")
    kind = F.substring(F.schema_of_variant(F.try_parse_json(found)), 1, 5)
    label = F.when(kind.isin("OBJEC", "ARRAY"), "json").otherwise("utf8") if fmt in ("auto", "json") else F.lit("utf8")
    return F.when(value.isNotNull(), F.struct(F.when(found.isNotNull(), label).otherwise("base64").alias("format"), F.coalesce(found, F.concat(F.lit("base64:"), F.base64(value))).alias("text")))


def looks_binary(content: Column, first: int = 8000) -> Column:
    """Whether a NUL is among the first bytes."""
    return F.locate("\0", F.substring(content, 1, first).cast("string")) > 0


def wrapped(text: Column, source: Column, key: Column) -> Column:
    """Text from outside in a frame that it can't close or open itself; lines that look like a transcript's turns don't."""
    safe = F.regexp_replace(text, r"(?i)<(/?)untrusted-content", "<$1untrusted\u200b-content")
    safe = F.regexp_replace(safe, r"(?im)^(\s*)(human|assistant):", "$1$2\u200b:")
    return F.concat(F.lit('<untrusted-content source="'), source, F.lit('" id="'), key.cast("string"), F.lit('">\n'), safe, F.lit("\n</untrusted-content>"))


def quoted(value: Column) -> Column:
    """A string of a link's state: in quotes, with ! before quotes and !."""
    return F.concat(F.lit("'"), F.regexp_replace(value, "([!'])", "!$1"), F.lit("'"))


# --------------------------------------------------------------------------- lookups and nested results


def keys(rows: DataFrame, key: str, pattern: str, deny: Sequence[str] = (), after: str | None = None, limit: int = 100) -> DataFrame:
    """A page of distinct keys that match a glob and none of those denied, in order, after a key."""
    found = rows.select(key).filter(F.col(key).rlike(glob_regex(pattern)))
    for d in deny:
        found = found.filter(~F.col(key).rlike(glob_regex(d)))
    if after is not None:
        found = found.filter(F.col(key) > after)
    return found.distinct().orderBy(key).limit(limit)


def redrive_sources(queues: DataFrame, target: str) -> DataFrame:
    """queue, dead_letter: the queues that send to each dead-letter queue among the queues."""
    dead = queues.select(F.col("queue").alias("dead_letter"))
    return queues.join(dead, F.col(target) == F.col("dead_letter"), "inner").select("queue", "dead_letter")


def newest(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= n)


def threads(rows: DataFrame, key: str, order: str, fields: Sequence[str], most: int) -> DataFrame:
    """key, n, notes: an array of the first `most` rows of each thread, in order; the rest is counted."""
    w = W.partitionBy(key).orderBy(order)
    sized = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    first = rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__n", *fields))).alias("notes"))
    return sized.join(first, key)


def byte_budget(rows: DataFrame, by: str, order: Sequence[Column], text: str, most: int) -> DataFrame:
    """Rows of each group while their text fits into the budget; the first that doesn't is cut, later ones are left out."""
    w = W.partitionBy(by).orderBy(*order)
    size = F.octet_length(text)
    used = F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = rows.withColumn("__used", used).filter(F.col("__used") < most)
    return held.withColumn("cut", F.col("__used") + size > most).withColumn("room", F.least(size, F.lit(most) - F.col("__used")).cast("long")).drop("__used")
