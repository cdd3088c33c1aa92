"""Log, metric and message operators on rows with a time."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import quantiles

INTERVALS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "1d": 86400}


def bounds(begin: str, end: str, most_days: int | None = None) -> tuple[datetime, datetime]:
    """Two ISO times with or without a zone (then UTC) as UTC; the first is the earlier, and they are no further apart than
    `most_days`."""
    a, b = (t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC) for t in map(datetime.fromisoformat, (begin, end)))
    if a >= b:
        raise ValueError("the range is empty")
    if most_days is not None and b - a > timedelta(days=most_days):
        raise ValueError(f"a range has {most_days} days at most")
    return a, b


def between(rows: DataFrame, begin: str, end: str, ts: str = "ts", most_days: int | None = 31) -> DataFrame:
    """Rows of a time range, both ends included."""
    a, b = (F.timestamp_micros(F.lit(round(t.timestamp() * 1_000_000))) for t in bounds(begin, end, most_days))
    return rows.filter(F.col(ts).between(a, b))


def terms(rows: DataFrame, field: str, n: int) -> DataFrame:
    """The n most frequent values; ties by value."""
    return rows.groupBy(field).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), field).limit(n)


def histogram(rows: DataFrame, every: str, ts: str = "ts") -> DataFrame:
    """bucket (UTC text) and n, for buckets that have rows."""
    width = INTERVALS[every]
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds(F.col(ts)) / width) * width)
    return rows.groupBy(F.date_format(bucket, "yyyy-MM-dd HH:mm:ss").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram_filled(rows: DataFrame, every: str, begin: str, end: str, ts: str = "ts", by: Sequence[str] = (), most: int = 1000) -> DataFrame:
    """by, bucket (UTC text) and n for every bucket of a time range, 0 for those without rows; `by`'s values are those that
    have rows in the range. More buckets than `most` are refused."""
    width = INTERVALS[every]
    a, b = bounds(begin, end)
    first, last = (int(t.timestamp() // width * width) for t in (a, b))
    if (b - a).total_seconds() / width > most:
        raise ValueError(f"more than {most} buckets; take a longer interval")
    at = F.floor(F.unix_seconds(F.col(ts)) / width) * width
    counted = between(rows, begin, end, ts, None).groupBy(*by, at.alias("__at")).agg(F.count(F.lit(1)).alias("n"))
    spark = rows.sparkSession
    steps = F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(width)))
    groups = counted.select(*by).distinct() if by else spark.range(1).select()
    every_one = groups.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], steps.alias("__step"))
    same = F.col("__at") == F.col("__step")
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    bucket = F.date_format(F.timestamp_seconds("__step"), "yyyy-MM-dd HH:mm:ss").alias("bucket")
    return every_one.join(counted, same, "left").select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(by)], bucket, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def metric(rows: DataFrame, period: int, value: str = "value", ts: str = "ts", by: Sequence[str] = (), percentiles: Sequence[int] = ()) -> DataFrame:
    """Statistics of each period of so many seconds. Percentiles are exact, by interpolation (see quantiles)."""
    bucket = F.date_format(F.timestamp_seconds(F.floor(F.unix_seconds(F.col(ts)) / period) * period), "yyyy-MM-dd HH:mm:ss").alias("bucket")
    v = F.col(value)
    stats = [F.round(F.avg(v), 6).alias("average"), F.round(F.sum(v), 4).alias("total"), F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.count(v).alias("samples")]
    out = rows.groupBy(*by, bucket).agg(*stats)
    if not percentiles:
        return out
    own = quantiles(rows.select(*by, bucket, v.alias("__value")), "__value", [p / 100 for p in percentiles], [*by, "bucket"])
    keys = [*by, "bucket"]
    own = own.select(*[F.col(k).alias(f"__q{i}") for i, k in enumerate(keys)], *[F.round(f"q{i}", 6).alias(f"p{p}") for i, p in enumerate(percentiles)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__q{i}"))
    return out.join(own, same, "left").drop(*[f"__q{i}" for i in range(len(keys))])


def cursor(ts: str, key: int, fingerprint: str) -> str:
    """An opaque cursor that names the query it belongs to."""
    return base64.urlsafe_b64encode(json.dumps({"ts": ts, "key": key, "q": fingerprint}, sort_keys=True).encode()).decode()


def page(rows: DataFrame, size: int, after: str | None = None, fingerprint: str = "", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """A page of the newest rows: the next ones after a cursor, and one more than asked for if there are more."""
    if after is not None:
        at = json.loads(base64.urlsafe_b64decode(after))
        if at["q"] != fingerprint:
            raise ValueError("the cursor belongs to another query")
        t = F.lit(at["ts"]).cast("timestamp")
        rows = rows.filter((F.col(ts) < t) | ((F.col(ts) == t) & (F.col(key) > at["key"])))
    return rows.orderBy(F.col(ts).desc(), key).limit(size + 1)


# --------------------------------------------------------------------------- messages


def watermarks(messages: DataFrame) -> DataFrame:
    """topic, partition, low, high (the next offset)."""
    return messages.groupBy("topic", "partition").agg(F.min("offset").alias("low"), (F.max("offset") + 1).alias("high"))


def peek_latest(messages: DataFrame, topic: str, limit: int) -> DataFrame:
    """The last messages of a topic: from each partition its share, then the last of those by time."""
    own = messages.filter(F.col("topic") == topic)
    parts = own.select("partition").distinct().count() or 1
    share = -(-limit // parts)
    last = own.withColumn("__n", F.row_number().over(W.partitionBy("partition").orderBy(F.col("offset").desc()))).filter(F.col("__n") <= share).drop("__n")
    return last.orderBy(F.coalesce("ts", F.lit(0).cast("timestamp")).desc(), F.col("partition").desc(), F.col("offset").desc()).limit(limit)


def peek_from(messages: DataFrame, topic: str, start: Column | int | str, limit: int) -> DataFrame:
    """The first messages of each partition from an offset (kept within what there is), or from a time (a string)."""
    own = messages.filter(F.col("topic") == topic)
    if isinstance(start, str):
        own = own.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    else:
        low = watermarks(own).select(F.col("partition").alias("__p"), F.greatest(F.lit(start), F.col("low")).alias("__from"))
        own = own.join(F.broadcast(low), F.col("partition") == F.col("__p")).filter(F.col("offset") >= F.col("__from")).drop("__p", "__from")  # a row for each partition
    return own.orderBy(F.coalesce("ts", F.lit(0).cast("timestamp")), "partition", "offset").limit(limit)


def group_lag(committed: DataFrame, marks: DataFrame) -> DataFrame:
    """topic, partition, done, high, lag of a group's committed offsets."""
    from karst.functions.scores import lag

    return committed.join(marks, ["topic", "partition"]).select("topic", "partition", "done", "high", lag(F.col("high"), F.col("low"), F.col("done")).alias("lag"))
