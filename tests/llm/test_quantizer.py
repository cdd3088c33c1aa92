import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from karst.llm import quantizer


def plainly(rows, entries=256, rounds=4, parts=4):
    kept = [(i, e, label) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    q = [[math.floor(1024 * x) for x in e] for _, e, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, np.array(q[i], "<i4").tobytes()))
    w = len(q[0]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(q[i], p) for i in order[:entries]] for p in range(parts)]

    def assign(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for v in q:
                own.setdefault(assign(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, vs in own.items():
                books[p][e] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    coded = [[assign(cut(v, p), books[p]) for p in range(parts)] for v in q]
    error = [sum(d for d, _ in c) for c in coded]
    by_label = {}
    for (_, _, label), x in zip(kept, error, strict=True):
        by_label[label] = by_label.get(label, 0) + x
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((str(i), "".join(f"{e:02x}" for _, e in c), x, by_label[label], sha) for (i, _, label), c, x in zip(kept, coded, error, strict=True))


SCHEMA = "vec_id long, embedding array<float>, label int"


def told(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("seed,step", [(0, 1 / 1024), (1, 0.05), (2, 40.0)])
def test_against_full_scans(spark, seed, step):
    """Coarse steps make ties and repeated parts; the last has components in the ten thousands."""
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-6, 7) * step for _ in range(8)], rng.choice([None, 1, 2])) for i in range(500)]
    rows += [rows[3], rows[3], (None, rows[4][1], 1), (None, rows[5][1], None), (9, None, 1), (10, [*rows[0][1][:7], None], 1), (11, [*rows[0][1][:7], float("nan")], 1), (12, [*rows[0][1][:7], float("-inf")], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as v", "2 as s", "3 as part", "4 as code", "5 as error").repartition(5)
    assert told(quantizer.digest(df, entries=40)) == plainly(rows, 40)


def test_fewer_vectors_than_entries_and_none(spark):
    rows = [(i, [float(i), 0.5, -1.25, 2.0], None) for i in range(5)]
    assert told(quantizer.digest(spark.createDataFrame(rows, SCHEMA))) == plainly(rows)
    assert told(quantizer.digest(spark.createDataFrame(rows[:1], SCHEMA))) == plainly(rows[:1])
    assert quantizer.digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-100000, 100000)) for _ in range(8)], 1) for i in range(80)]
    assert told(quantizer.digest(spark.createDataFrame(rows, SCHEMA), entries=9)) == plainly(rows, 9)


@pytest.mark.parametrize("rows", [[(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 5, 1)], [(1, [3e38] * 4, 1)]])
def test_refused_vectors(spark, rows):
    with pytest.raises(Exception, match="width|too large"):
        quantizer.digest(spark.createDataFrame(rows, SCHEMA)).collect()


def test_bounds_spare_scans():
    rng = np.random.default_rng(1)
    x = rng.integers(-1000, 1000, (3000, 4)) + 5000 * rng.integers(0, 8, (3000, 1))
    c = x[:16].copy()
    code, upper, lower = np.zeros(3000, np.int64), np.full(3000, np.inf), np.zeros(3000)
    before, scanned = None, []
    for _ in range(8):
        b = quantizer.Bounds(before, c)
        scanned.append(b.assign(x, code, upper, lower))
        assert (code == quantizer.squares(x, c).argmin(1)).all()
        before, c = c, np.array([x[code == e].sum(0) // max(1, (code == e).sum()) if (code == e).any() else c[e] for e in range(16)])
    assert scanned[-1] < scanned[0] / 2


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted((str(r[0]), *r[1:]) for r in con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({quantizer.SQL})").fetchall())
    assert told(quantizer.digest(spark.read.parquet(f"{sf}/embeddings.parquet"))) == want
