"""Scalar scores: vectors, freshness, agreement, confidence, watermark arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least factor of a stale fact, the factor of one without a date, and the bar for a fact.
FRESHNESS_FLOOR = 0.25
FRESHNESS_UNKNOWN = 0.75
FACT = 0.6
WEIGHTS = (0.5, 0.3, 0.2)

#: Hours until a fact of a type counts as stale, and the source that has the say.
HORIZONS = {"runtime_config": 168, "architecture": 2160, "current_work_status": 24, "code_behavior": 720}
AUTHORITIES = {"runtime_config": "gitlab", "architecture": "confluence", "current_work_status": "jira", "code_behavior": "gitlab"}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: list[float]) -> Column:
    """Cosine similarity with a constant vector; null for zero vectors."""
    other = F.array(*[F.lit(float(x)) for x in b])
    size = sum(float(x) ** 2 for x in b) ** 0.5
    return dot(a, other) / F.nullif(norm(a) * F.lit(size), F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def hours_between(earlier: Column, later: Column) -> Column:
    return F.round((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3.6e9), 1)


def freshness(updated: Column, now: Column, horizon: Column) -> Column:
    """1 within the horizon (null: never stale), then horizon / age, the floor at least; a fixed factor without a date."""
    age = F.greatest(hours_between(updated, now), F.lit(0.0))
    return F.when(updated.isNull(), F.lit(FRESHNESS_UNKNOWN)).when(horizon.isNull() | (age <= horizon), F.lit(1.0)).otherwise(F.greatest(F.lit(FRESHNESS_FLOOR), horizon / age))


def agreement(sources: Column) -> Column:
    n = F.greatest(sources, F.lit(0))
    return n / (n + F.lit(1.0))


def confidence(retrieval: Column, agreed: Column, fresh: Column, weights: tuple[float, float, float] = WEIGHTS) -> Column:
    """The factors' weighted geometric mean, to six places."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    total = F.lit(1.0)
    for x, w in zip((retrieval, agreed, fresh), weights, strict=True):
        total = total * F.pow(clamp(x), F.lit(w))
    return F.round(clamp(total), 6)


def lag(high: Column, low: Column, done: Column) -> Column:
    """Messages not yet read: all of them if nothing is committed (null or negative)."""
    return F.when(done.isNull() | (done < 0), high - low).otherwise(F.greatest(high - done, F.lit(0)))
