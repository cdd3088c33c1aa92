"""Read operators of wikis, code hosts, issue trackers, queues and log groups, on tables of their items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions import values
from karst.functions.text import glob_regex, matches_glob

from .tools import decoded, looks_binary, newest, tail


def searched(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, equal: dict | None = None, contains: dict | None = None, prefix: dict | None = None, has: dict | None = None, since: tuple | None = None, until: tuple | None = None) -> DataFrame:
    """A page of rows: columns equal to a value (or one of a list), that contain a text in any case, that begin with one,
    arrays that have all of some items, and times from and to (both included). What is None or empty asks for nothing."""
    for name, x in (equal or {}).items():
        if x is not None:
            rows = rows.filter(F.col(name).isin(list(x)) if isinstance(x, list | tuple | set) else F.col(name) == x)
    for name, x in (contains or {}).items():
        if x:
            rows = rows.filter(F.lower(name).contains(x.lower()))
    for name, x in (prefix or {}).items():
        if x:
            rows = rows.filter(F.col(name).startswith(x))
    for name, items in (has or {}).items():
        for x in items:
            rows = rows.filter(F.array_contains(name, x))
    if since:
        rows = rows.filter(F.col(since[0]) >= F.lit(since[1]).cast("timestamp"))
    if until:
        rows = rows.filter(F.col(until[0]) <= F.lit(until[1]).cast("timestamp"))
    page = rows.orderBy(*order)
    return (page.offset(offset) if offset else page).limit(limit)


def resumed(rows: DataFrame, key: str, limit: int, token: str | None = None, skip: int = 0) -> DataFrame:
    """A page of distinct keys in order: those after the token, without the first `skip` of them."""
    found = rows.select(key).distinct()
    if token is not None:
        found = found.filter(F.col(key) > token)
    return found.orderBy(key).offset(skip).limit(limit)


# --------------------------------------------------------------------------- code hosts


def code_hits(blobs: DataFrame, projects: DataFrame, word: str, deny: Sequence[str], names: Sequence[str] = ()) -> DataFrame:
    """Files whose text has a word, without denied paths and with names that match, and their projects' names. Projects are
    looked up by their id; Spark broadcasts them while they are few."""
    hits = blobs.filter(F.lower("text").contains(word.lower()) & ~matches_glob(F.col("path"), list(deny)))
    if names:
        hits = hits.filter(matches_glob(F.col("path"), list(names)))
    return hits.join(projects.select("project_id", F.col("name").alias("project")), "project_id", "left")


def file_contents(files: DataFrame, encoded: str) -> DataFrame:
    """Adds format and content from a column in base64: text, or a notice for what is binary."""
    raw = F.unbase64(encoded)
    told = decoded(raw)
    binary = looks_binary(raw) | (told["format"] == "base64")
    return files.withColumn("format", F.when(binary, "binary").otherwise(told["format"])).withColumn("content", F.when(binary, F.concat(F.lit("binary, "), F.octet_length(raw), F.lit(" bytes"))).otherwise(told["text"]))


def tree(paths: DataFrame, path: str, folder: str = "", recursive: bool = False) -> DataFrame:
    """name, kind: what is in a folder; without recursion folders stand for what they hold."""
    inside = paths.filter(F.col(path).startswith(folder)).select(F.substring(F.col(path), F.lit(len(folder) + 1), F.length(path)).alias("rest"))
    if recursive:
        return inside.select(F.col("rest").alias("name"), F.lit("blob").alias("kind")).distinct()
    deep = F.col("rest").contains("/")
    return inside.select(F.substring_index("rest", "/", 1).alias("name"), F.when(deep, "tree").otherwise("blob").alias("kind")).distinct()


def commits(rows: DataFrame) -> DataFrame:
    """Adds body: the message, null where it says no more than the title."""
    return rows.withColumn("body", F.nullif(F.trim("message"), F.trim("title")))


def failed_traces(jobs: DataFrame, by: str, trace: str, most: int = 3, size: int = 200) -> DataFrame:
    """The newest failed jobs of each pipeline with the end of their traces."""
    return newest(jobs.filter("status = 'failed'"), [by], [F.col("ts").desc(), F.col("event_id").desc()], most).withColumn("end", tail(F.col(trace), size))


# --------------------------------------------------------------------------- queues


def queue_attributes(rows: DataFrame, attributes: str) -> DataFrame:
    """Typed attributes of queues from a map of strings: counts are never negative, a redrive policy that is no object is null."""
    a = F.col(attributes)
    redrive = F.from_json(a["RedrivePolicy"], "deadLetterTargetArn string, maxReceiveCount string")
    return rows.select(
        "queue",
        F.coalesce(values.counted(a["ApproximateNumberOfMessages"]), F.lit(0).cast("long")).alias("messages"),
        values.counted(a["VisibilityTimeout"]).alias("visibility_timeout_s"),
        values.flag(a["FifoQueue"]).alias("fifo"),
        redrive["deadLetterTargetArn"].alias("dead_letter"),
        values.counted(redrive["maxReceiveCount"]).alias("max_receives"),
        F.timestamp_seconds(values.counted(a["CreatedTimestamp"])).alias("created_at"),
    )


def queue_arn(url: Column, region: str) -> Column:
    """A queue's resource name from its address; null without account and name."""
    part = lambda i: F.regexp_extract(url, r"^[a-z]+://([^/:?#]*)[^/]*/(?:.*/)?([^/]+)/([^/]+)/?$", i)
    own = F.nullif(F.regexp_extract(part(1), r"^(?:sqs\.)?([a-z]{2}(?:-[a-z]+)+-\d)\.", 1), F.lit(""))
    cloud = F.when(part(1).endswith(".amazonaws.com.cn"), "aws-cn").otherwise("aws")
    return F.when(part(3) != "", F.concat_ws(":", F.lit("arn"), cloud, F.lit("sqs"), F.coalesce(own, F.lit(region)), part(2), part(3)))


def topic_attributes(rows: DataFrame, attributes: str) -> DataFrame:
    """Typed attributes of topics (arn, map of strings): a delivery policy that isn't JSON is null, as is a count that is no
    number or isn't told."""
    a = F.col(attributes)
    policy = F.nullif(a["EffectiveDeliveryPolicy"], F.lit(""))
    return rows.select(
        F.coalesce(F.nullif(a["TopicArn"], F.lit("")), F.col("arn")).alias("arn"),
        F.regexp_extract("arn", "[^/:]*$", 0).alias("name"),
        F.nullif(a["DisplayName"], F.lit("")).alias("display_name"),
        *[values.counted(a[f"Subscriptions{k.title()}"]).alias(k) for k in ("confirmed", "pending", "deleted")],
        F.coalesce(values.flag(a["FifoTopic"]), F.lit(False)).alias("fifo"),
        F.when(F.try_parse_json(policy).isNotNull(), policy).alias("delivery_policy"),
    )


#: The states of a consumer group.
GROUP_STATES = ("PreparingRebalance", "CompletingRebalance", "Stable", "Dead", "Empty", "Unknown")


def consumer_groups(groups: DataFrame, pattern: str = "*", states: Sequence[str] = (), limit: int = 20) -> DataFrame:
    """The first `limit` groups (group, state, ...) by name whose name, in its case, fits a glob and whose state is one of
    `states` (any without one), each with `more`: how many beyond the limit fit too."""
    unknown = [s for s in states if s not in GROUP_STATES]
    if unknown or limit < 1:
        raise ValueError(f"no state {unknown[0]}" if unknown else "a limit is positive")
    found = groups.filter(F.col("group").rlike(glob_regex(pattern)))
    found = found.filter(F.col("state").isin(list(states))) if states else found
    n = found.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("more"))
    return found.orderBy("group").limit(limit).crossJoin(F.broadcast(n))  # one row
