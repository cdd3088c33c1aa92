"""Exact quantiles of groups of any size: no task holds a group's values.

Each group's values are first cut down to short ranges around the ranks asked for, by mergeable sketches whose error is
bounded; then values outside of the ranges are only counted, those inside counted by value, and ranks are prefix sums of these
counts. What one task holds of a group are its counts: at most `few` values a rank asked for, and one number between two ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karst.sources.shared import new_folder, put

#: Points of a sketch, and its accuracy: the rank of a point is off by at most 1 / ACCURACY of the values.
GRID, ACCURACY = 200, 10_000


def _ranks(share: float, n: Column, nearest: bool) -> tuple[Column, Column, Column]:
    """The two ranks (from 0) that a quantile lies between, and how far from the first to the second."""
    if nearest:
        at = F.greatest(F.ceil(F.round(F.lit(share) * n, 9)) - 1, F.lit(0)).cast("long")
        return at, at, F.lit(0.0)
    place_ = F.lit(share) * (n - 1)
    low = F.floor(place_)
    return low, F.least(low + 1, n - 1), place_ - low


def _same(left: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & left[k].eqNullSafe(F.col(f"{prefix}{i}"))
    return out


def quantiles(rows: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), nearest: bool = False, few: int = 50_000) -> DataFrame:
    """by and q0, q1, ...: the shares' quantiles of each group, interpolated between neighbours, or with `nearest` the value at
    the rank that is share * n rounded up. Nulls don't count; a group without values has none; NaN is the largest value.
    """
    if not shares or not all(0 <= p <= 1 for p in shares):
        raise ValueError("shares are between 0 and 1")
    spark = rows.sparkSession
    folder = new_folder(spark, "quantiles")
    v = rows.select(*by, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    names = [f"__g{i}" for i in range(len(by))]
    sizes = v.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).select(*[F.col(k).alias(g) for k, g in zip(by, names, strict=True)], "__n")
    ranks = F.array_distinct(F.array(*[r for p in shares for r in _ranks(p, F.col("__n"), nearest)[:2]]))
    # a row for each group and rank: the least and the most of the values that it is among, and how many are below and in these
    none = F.lit(None).cast("double")
    ranges = sizes.select(*names, "__n", F.explode(ranks).alias("r"), none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("__n").alias("inside"))
    ranges = put(ranges, f"{folder}/0")
    x, turn = F.col("__v"), 0
    open_ = (F.col("inside") > few) & (F.col("lo").isNull() | (F.col("lo") != F.col("hi")))
    among = (F.col("lo").isNull() | (x >= F.col("lo"))) & (F.col("hi").isNull() | (x <= F.col("hi")))
    while ranges.filter(open_).limit(1).count():
        turn += 1
        wide = ranges.filter(open_)
        held = v.join(wide, _same(v, by, "__g")).filter(among)
        points = F.array_distinct(F.percentile_approx("__v", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), ACCURACY))
        sketch = put(held.groupBy(*names, "r").agg(points.alias("q")), f"{folder}/{turn}-points")
        sketch = sketch.select(*[F.col(g).alias(f"o{g}") for g in names], F.col("r").alias("or"), "q")
        # cells: each point by itself, as many rows may have its value, and what lies between two, which is little
        cut = held.join(sketch, _same(held, names, "o__g") & (held.r == F.col("or")))
        cell = (F.size(F.filter("q", lambda e: e < x)) * 2 + F.array_contains("q", x).cast("int")).alias("cell")
        cells = cut.groupBy(*names, "r", cell).agg(F.any_value("__n").alias("__n"), F.any_value("below").alias("below"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count(F.lit(1)).alias("inside"))
        before = F.col("below") + F.coalesce(F.sum("inside").over(W.partitionBy(*names, "r").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        own = cells.withColumn("below", before).filter((F.col("below") <= F.col("r")) & (F.col("r") < F.col("below") + F.col("inside")))
        ranges = put(ranges.filter(~open_).unionByName(own.select(*ranges.columns)), f"{folder}/{turn}")
    bounds = ranges.groupBy(*names).agg(F.any_value("__n").alias("__n"), F.collect_list(F.struct("lo", "hi")).alias("kept"))  # two for each share at most
    both = v.join(bounds, _same(v, by, "__g"))
    kept = F.exists("kept", lambda k: (k["lo"].isNull() | (x >= k["lo"])) & (k["hi"].isNull() | (x <= k["hi"])))
    ends = F.array_compact(F.concat(F.transform("kept", lambda k: k["lo"]), F.transform("kept", lambda k: k["hi"])))
    part = F.size(F.filter(ends, lambda e: e < x))
    counts = both.groupBy(*names, part.alias("part"), F.when(kept, x).alias("x")).agg(F.count(F.lit(1)).alias("k"), F.any_value("__n").alias("__n"))
    order = W.partitionBy(*names).orderBy("part", F.col("x").asc_nulls_first())
    placed = counts.withColumn("upto", F.sum("k").over(order)).withColumn("from", F.col("upto") - F.col("k"))
    out = []
    for i, p in enumerate(shares):
        low, high, way = _ranks(p, F.col("__n"), nearest)
        a, b = (F.max(F.when((F.col("from") <= r) & (r < F.col("upto")), F.col("x"))) for r in (low, high))
        out += [a.alias(f"a{i}"), b.alias(f"b{i}"), F.max(way).alias(f"w{i}")]
    found = placed.groupBy(*names).agg(F.count(F.lit(1)).alias("__some"), *out)
    made = [F.when(F.col(f"w{i}") == 0, F.col(f"a{i}")).otherwise(F.col(f"a{i}") * (1 - F.col(f"w{i}")) + F.col(f"b{i}") * F.col(f"w{i}")).alias(f"q{i}") for i in range(len(shares))]
    return found.select(*[F.col(g).alias(k) for g, k in zip(names, by, strict=True)], *made)

