import math
import random

import pytest
from karst.operators import events
from karst.operators.quantiles import quantiles

SCHEMA = "g string, v double"


def plainly(rows, shares, nearest):
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    out = {}
    for g, vs in groups.items():
        vs = sorted(vs, key=lambda x: (math.isnan(x), x))
        n, told = len(vs), []
        for p in shares:
            if nearest:
                told.append(vs[max(0, math.ceil(round(p * n, 9)) - 1)])
            else:
                at = p * (n - 1)
                i, w = int(at), at - int(at)
                told.append(vs[i] if w == 0 else vs[i] * (1 - w) + vs[i + 1] * w)
        out[g] = told
    return out


@pytest.mark.parametrize("nearest", [False, True])
@pytest.mark.parametrize("few", [50_000, 40])
def test_against_sorting(spark, few, nearest):
    """With few=40 groups are narrowed down again and again; values are smooth, far apart, tied, and one alone."""
    rng = random.Random(1)
    rows = [("smooth", rng.gauss(0, 1)) for _ in range(6000)] + [("far", 10 ** rng.uniform(-300, 300) * rng.choice([1, -1])) for _ in range(5000)]
    rows += [("tied", float(rng.choice([1, 1, 1, 1, 2, 7]))) for _ in range(5000)] + [("same", 4.0)] * 3000 + [("one", 3.0), ("two", 1.0), ("two", 2.0), (None, 5.0), (None, None), ("none", None)]
    rows += [("odd", float("inf")), ("odd", float("-inf")), ("odd", 0.0), ("odd", -0.0), ("odd", 1.0)]
    shares = [0.0, 0.01, 0.5, 0.9, 0.99, 1.0]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.g: list(r)[1:] for r in quantiles(df, "v", shares, ["g"], nearest, few).collect()}
    want = plainly(rows, shares, nearest)
    assert got.keys() == want.keys()
    for g, vs in want.items():
        assert got[g] == pytest.approx(vs, rel=1e-12, nan_ok=True), g
    assert quantiles(df.filter("false"), "v", [0.5], ["g"]).collect() == [] and [r.q0 for r in quantiles(df.filter("false"), "v", [0.5]).collect()] == [None]
    assert quantiles(df, "v", [0.5], [], nearest, few).count() == 1


def test_gaps_and_bounds(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 02:50:00", "a"), ("2024-01-01 01:00:00", None)], "t string, k string").selectExpr("cast(t AS timestamp) AS ts", "k")
    got = sorted((str(r.k), r.bucket[11:], r.n) for r in events.histogram_filled(rows, "1h", "2024-01-01T00:00:00Z", "2024-01-01T03:30:00Z", by=["k"]).collect())
    assert got == [("None", f"0{h}:00:00", int(h == 1)) for h in range(4)] + [("a", f"0{h}:00:00", int(h in (0, 2))) for h in range(4)]
    assert [r.n for r in events.histogram_filled(rows.limit(0), "1d", "2024-01-01", "2024-01-03").collect()] == [0, 0, 0]
    with pytest.raises(ValueError, match="buckets"):
        events.histogram_filled(rows, "1m", "2024-01-01", "2024-01-03")
    assert events.between(rows, "2024-01-01T03:00:00+02:00", "2024-01-01T02:00:00Z").count() == 1  # as texts these are the wrong way round
    for bad in (("2024-01-02", "2024-01-01"), ("2024-01-01T01:00:00+02:00", "2023-12-31T23:00:00Z"), ("2024-01-01", "2024-03-01")):
        with pytest.raises(ValueError):
            events.between(rows, *bad)
