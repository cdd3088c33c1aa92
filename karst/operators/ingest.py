"""Incremental ingest over snapshots: policy, comparison, upsert, cursor, reconciliation, failures, pruning.

A snapshot is a DataFrame; a step returns the next one, to be written beside the old one, never over it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions.text import content_hash, matches_glob, redacted
from karst.sources.snapshots import Store

KEY = ["source_type", "source_id"]


def gated(crawled: DataFrame, deny: Sequence[str] = ()) -> DataFrame:
    """Adds blocked (why a document must not be stored, else null), redacts text, counts redactions and hashes it."""
    reason = F.when(~F.col("visibility").eqNullSafe("team"), "restricted").when(matches_glob(F.col("source_uri"), list(deny)), "denied path")
    found = crawled.withColumn("blocked", reason).withColumn("__r", F.when(F.col("blocked").isNull(), redacted(F.col("text"))))  # patterns run once a row
    return found.withColumns({"redactions": F.coalesce("__r.count", F.lit(0)), "text": F.col("__r.text"), "content_hash": content_hash(F.col("__r.text"))}).drop("__r")


def compared(crawled: DataFrame, stored: DataFrame, config: str) -> DataFrame:
    """Adds action: insert, update, skip (live, same content and chunking) or block. Later work runs on the few that change."""
    old = stored.select(*[F.col(k).alias(f"__{k}") for k in KEY], F.col("content_hash").alias("__hash"), F.col("chunk_config").alias("__config"), F.col("deleted_at").alias("__gone"))
    both = crawled.join(old, (F.col("source_type") == F.col("__source_type")) & (F.col("source_id") == F.col("__source_id")), "left")
    same = F.col("__gone").isNull() & F.col("__hash").eqNullSafe(F.col("content_hash")) & F.col("__config").eqNullSafe(F.lit(config))
    action = F.when(F.col("blocked").isNotNull(), "block").when(F.col("__source_id").isNull(), "insert").when(same, "skip").otherwise("update")
    return both.withColumn("action", action).drop("__source_type", "__source_id", "__hash", "__config", "__gone")


def upserted(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """The next snapshot: changed rows replace those of their key; columns are those of stored."""
    kept = stored.join(changes.select(*KEY), KEY, "left_anti")
    return kept.unionByName(changes.select(*stored.columns))


def next_cursor(outcomes: DataFrame, old: Column) -> DataFrame:
    """One row (cursor): from rows (updated_at, failed) of a run.

    With failures it stops one second before the first; a failure without a time keeps the old one; else it is the latest
    time committed. It never moves back.
    """
    first_failed = F.min(F.when(F.col("failed"), F.col("updated_at")))
    undated = F.coalesce(F.bool_or(F.col("failed") & F.col("updated_at").isNull()), F.lit(False))
    any_failed = F.coalesce(F.bool_or("failed"), F.lit(False))
    candidate = F.when(undated, old).when(any_failed, first_failed - F.expr("INTERVAL 1 SECOND")).otherwise(F.max("updated_at"))
    return outcomes.agg(F.greatest(candidate, old).alias("cursor"))


def reconciled(stored: DataFrame, seen: DataFrame, now: Column, valve: float = 0.8, complete: bool = True) -> DataFrame:
    """stored with documents that a full crawl didn't see as tombstones; if it saw under `valve` of the live ones, or failed,
    nothing changes. The counts are one row beside the data, not an action."""
    live = stored.filter("deleted_at IS NULL")
    ok = live.agg(F.count(F.lit(1)).alias("__live")).crossJoin(seen.select(*KEY).distinct().agg(F.count(F.lit(1)).alias("__seen")))
    ok = ok.select((F.lit(complete) & (F.col("__seen") >= F.col("__live") * valve)).alias("__ok"))
    found = seen.select(*KEY).distinct().withColumn("__here", F.lit(True))
    both = stored.join(found, KEY, "left").crossJoin(F.broadcast(ok))  # one row
    gone = F.col("__ok") & F.col("__here").isNull() & F.col("deleted_at").isNull()
    return both.withColumn("deleted_at", F.when(gone, now).otherwise(F.col("deleted_at"))).select(*stored.columns)


def failures(ledger: DataFrame, failed: DataFrame, succeeded: DataFrame) -> DataFrame:
    """The next ledger (key, attempts, code): attempts add up, policy blocks add none, success clears."""
    new = failed.select(*KEY, F.when(F.col("code") == "policy", 0).otherwise(1).alias("attempts"), "code", F.lit(1).alias("__new"))
    both = ledger.select(*KEY, "attempts", "code", F.lit(0).alias("__new")).unionByName(new)
    return both.groupBy(*KEY).agg(F.sum("attempts").cast("int").alias("attempts"), F.max_by("code", "__new").alias("code")).join(succeeded.select(*KEY), KEY, "left_anti")


def prune_report(documents: DataFrame, chunks: DataFrame, before: Column, advise: int = 1000) -> DataFrame:
    """One row: documents deleted before a time, their chunks, and whether to rebuild the index."""
    old = documents.filter(F.col("deleted_at") < before).select("document_id")
    n = old.join(chunks, "document_id", "left").agg(F.count_distinct("document_id").alias("documents"), F.count("chunk_id").alias("chunks"))
    return n.withColumn("reindex", F.col("chunks") >= advise)


def rolled_up(runs: DataFrame) -> DataFrame:
    """One row: ok if all sources are, failed if all failed, else partial; and an exit code."""
    status = F.when(F.bool_and(F.col("status") == "ok"), "ok").when(F.bool_and(F.col("status") == "failed"), "failed").otherwise("partial")
    return runs.agg(status.alias("status")).withColumn("exit_code", F.when(F.col("status") == "ok", 0).when(F.col("status") == "partial", 1).otherwise(2))


# --------------------------------------------------------------------------- crawls


def scanned(rows: DataFrame, updated: str, key: str, cursor: Column | None = None, limit: int | None = None) -> DataFrame:
    """What a crawl reads, oldest first: rows from the cursor on, which counts too (all without one, undated ones then too)."""
    found = rows if cursor is None else rows.filter(F.col(updated) >= cursor)
    found = found.orderBy(F.col(updated).asc_nulls_first(), key)
    return found if limit is None else found.limit(limit)


def crawled_files(files: DataFrame, path: str, size: str, include: Sequence[str], deny: Sequence[str], most: int) -> DataFrame:
    """Adds blocked: denied files come as rows that say why, whether the globs `include` name them or not; of the others
    those that `include` names (all without one) and that have at most `most` bytes."""
    reason = F.when(matches_glob(F.col(path), list(deny)), "denied path")
    wanted = (matches_glob(F.col(path), list(include)) if include else F.lit(True)) & (F.col(size) <= most)
    return files.withColumn("blocked", reason).filter(F.col("blocked").isNotNull() | wanted)


def refetched(rows: DataFrame, ledger: DataFrame, most: int) -> DataFrame:
    """The rows whose failures are to be tried again: recorded, not by policy, with fewer attempts than `most`."""
    again = ledger.filter((F.col("code") != "policy") & (F.col("attempts") < most)).select(*KEY)
    return rows.join(again, KEY, "left_semi")


def once_a_run(retried: DataFrame, crawled: DataFrame) -> DataFrame:
    """A run's rows, each key once: the retried copy stays."""
    both = retried.withColumn("retry", F.lit(True)).unionByName(crawled.withColumn("retry", F.lit(False)))
    columns = [c for c in both.columns if c not in KEY]
    return both.groupBy(*KEY).agg(F.max_by(F.struct(*columns), "retry").alias("r")).select(*KEY, "r.*")


def reread(rows: DataFrame, stored: DataFrame, updated: str, cursor: Column) -> DataFrame:
    """What an inclusive scan reads once more without change: rows at the cursor whose content is stored as it is."""
    same = stored.select(*KEY, "content_hash")
    return rows.filter(F.col(updated) >= cursor).join(same, [*KEY, "content_hash"], "left_semi")


# --------------------------------------------------------------------------- what follows an action


def replaced_chunks(stored: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The next table of chunks: those of changed documents go, and the fresh ones come in one step."""
    return stored.join(changed.select("document_id"), "document_id", "left_anti").unionByName(fresh.select(*stored.columns))


def purged(documents: DataFrame, chunks: DataFrame, reclassified: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, chunks and failures after some documents must not be kept: tombstones without title, no chunks, and a failure
    by policy for each that was live."""
    gone = reclassified.select(F.col("document_id").alias("__gone")).distinct()
    both = documents.join(gone, F.col("document_id") == F.col("__gone"), "left")
    hit = F.col("__gone").isNotNull() & F.col("deleted_at").isNull()
    kept = both.withColumn("title", F.when(~F.col("__gone").isNotNull(), F.col("title"))).withColumn("deleted_at", F.when(hit, now).otherwise(F.col("deleted_at"))).select(*documents.columns)
    failures_ = both.filter(hit).select(*KEY, F.lit("policy").alias("code"))
    return kept, chunks.join(gone, F.col("document_id") == F.col("__gone"), "left_anti"), failures_


def pruned(documents: DataFrame, chunks: DataFrame, before: Column, orphans: bool = False, sources: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without old tombstones; with `orphans`, without live documents that no run has seen since."""
    old = F.coalesce("last_seen_at", "ingested_at") if orphans else F.col("deleted_at")
    which = (F.col("deleted_at").isNull() if orphans else F.col("deleted_at").isNotNull()) & (old < before)
    if sources:
        which = which & F.col("source_type").isin(list(sources))
    gone = documents.filter(which).select("document_id")
    return documents.join(gone, "document_id", "left_anti"), chunks.join(gone, "document_id", "left_anti")


def run_rules(full: bool, since: bool, limit: bool, dry: bool, failed: int) -> dict[str, bool]:
    """What a run may do: its own beginning never moves the cursor; only a whole, undisturbed full crawl reconciles; a dry run
    writes nothing."""
    return {"writes": not dry, "moves_cursor": not dry and not since, "reconciles": not dry and full and not since and not limit and failed == 0}


# --------------------------------------------------------------------------- a whole run

STORED = "source_type string, source_id string, document_id long, text string, content_hash string, chunk_config string, updated_at timestamp, redactions int, deleted_at timestamp"
CHUNKS = "document_id long, chunk_index int, content string"
LEDGER = "source_type string, source_id string, attempts int, code string"


def run(store: Store, crawled: DataFrame, chunked: Callable[[DataFrame], DataFrame], config: str, deny: Sequence[str] = (), dry: bool = False) -> int:
    """One run over what a crawl gave (source_type, source_id, document_id, source_uri, visibility, text, updated_at).

    Policy, comparison, documents, their chunks (chunked gives document_id, chunk_index, content), failures and each source's
    cursor become one version, or, if the run is lost, none. Of several rows of a key the one updated last counts. A dry run
    commits nothing. Returns the version that is current then.
    """
    base = store.version()
    stage = store.stage()
    docs, chunks, ledger = (store.read(t, base, s) for t, s in (("documents", STORED), ("chunks", CHUNKS), ("failures", LEDGER)))
    cursors = store.read("cursors", base, "source_type string, cursor timestamp")
    newest = crawled.groupBy(*KEY).agg(F.max_by(F.struct("document_id", "source_uri", "visibility", "text", "updated_at"), F.struct("updated_at", "document_id")).alias("r")).select(*KEY, "r.*")
    # decided once: later steps read what was written, so that all of them see the same
    acts = stage.write("actions", compared(gated(newest, deny), docs, config))
    changed = acts.filter(F.col("action").isin("insert", "update")).select(*KEY, "document_id", "text", "content_hash", F.lit(config).alias("chunk_config"), "updated_at", F.col("redactions").cast("int").alias("redactions"), F.lit(None).cast("timestamp").alias("deleted_at"))
    failed = acts.filter("action = 'block'").select(*KEY, F.lit("policy").alias("code"))
    done = acts.filter("action <> 'block'").select(*KEY)
    stage.write("documents", upserted(docs, changed))
    stage.write("chunks", replaced_chunks(chunks, changed, chunked(changed)))
    stage.write("failures", failures(ledger, failed, done))
    seen = acts.groupBy("source_type").agg(F.max("updated_at").alias("cursor"))
    stage.write("cursors", cursors.unionByName(seen).groupBy("source_type").agg(F.max("cursor").alias("cursor")))
    if dry:
        return base
    return stage.commit({"config": config}, drop=("actions",))
