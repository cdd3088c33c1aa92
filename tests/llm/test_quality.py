import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from karst.llm import quality

from .conftest import SCHEMA, prose


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + t for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for t in range(3)}
    counts = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))
    return counts, len(w) < 50 or 100 * len(covered) > 50 * len(w)


def texts(rng):
    out = [prose(rng, rng.randrange(1, 300)).replace(" re ", "\n") for _ in range(150)]
    out += ["a b c\n" * 30, "x y\nx y\n\n x y", "", None, "\n\n", "é ü z\x0b|<>", "one two three one two three four", "#$%" * 9]
    return out


def test_base_counts(spark, odd_docs):
    rows = [(i, t) for i, t in enumerate(texts(random.Random(1)))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in quality.digest(docs).collect()}
    for i, t in rows:
        counts, failed = base(t)
        assert tuple(got[i][c] for c in quality.COUNTS) == counts, t
        assert got[i].base_failed == failed and not (failed and got[i].kept)
    want = Counter(base(r.text)[0] for r in odd_docs.select("text").collect())
    assert Counter(tuple(r[c] for c in quality.COUNTS) for r in quality.digest(odd_docs).collect()) == want


def test_outliers_go_and_the_rest_stays(spark, no_docs):
    rng = random.Random(2)
    rows, bad = [], set()
    for i in range(600):
        words = prose(rng, rng.randrange(60, 300)).capitalize().split()
        lines = [" ".join(words[k : k + 12]) + "." for k in range(0, len(words), 12)]
        text = "\n".join(lines)
        if i % 10 == 0:
            bad.add(i)
            text = " ".join(w + rng.choice(["###", "%%%", "|&"]) for w in text.split(" "))
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice(["a", "b", "b", "c"]), 0))
    rows.append((600, rows[1][1], "fr", "a", 0))  # a group of its own, too small for a fit
    got = quality.digest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in got if not r.kept} == bad
    assert quality.digest(no_docs).collect() == []


def exact_fit(v, within=0.999):
    """Distances by the minimum covariance determinant with sorted distances instead of bins, from the same two starts."""
    n, p = v.shape
    floors = np.array([s for _, s in quality.STATISTICS])

    def distance(mu, cov):
        d = v - mu
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov + np.diag(floors**2)), d)

    def of(x, share):
        q = quality.chi2_quantile(share, p)
        return x.mean(0), np.cov(x.T, bias=True) * share / quality.chi2_cdf(q, p + 2)

    mu = np.median(v, 0)
    mad = 1.4826 * np.median(np.abs(v - mu), 0)
    y = np.tanh((v - mu) / np.maximum(mad, floors))
    corr = np.nan_to_num(np.corrcoef(y.T)) * 0.99 + 0.01 * np.eye(p)
    np.fill_diagonal(corr, 1)
    best = None
    half = int((n + p + 1) / 2)
    for start in (np.eye(p), corr):
        m, cov = mu, start * np.outer(mad, mad)
        for _ in range(50):
            m, cov = of(v[np.argsort(distance(m, cov))[:half]], half / n)
        size = np.linalg.slogdet(cov + np.diag(floors**2))[1]
        if best is None or size < best[0]:
            best = size, m, cov
    m, cov = of(v[distance(*best[1:]) <= quality.chi2_quantile(within, p)], 0.975)
    return np.sqrt(distance(m, cov))


def test_verdicts_against_an_exact_fit(spark):
    rng = random.Random(3)
    kinds = ("", " |||" * 30, " 12345" * 20, " A.B.C!" * 25, " é" * 3, " x#" * 2)
    rows = [(i, prose(rng, rng.randrange(60, 400)).capitalize() + kinds[rng.choices(range(6), (80, 4, 4, 4, 4, 4))[0]], "en", "a", 0) for i in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in quality.digest(docs).collect()}
    _, vector = quality.statistics(pa.array([r[1] for r in rows]))
    want = exact_fit(vector[[not got[i].base_failed for i in range(500)]])
    rows_in = [i for i in range(500) if not got[i].base_failed]
    cut = np.sqrt(quality.chi2_quantile(1 - 1e-7, quality.P))
    assert np.abs(want / np.array([got[i].distance for i in rows_in]) - 1).max() < 0.1
    clear = np.abs(want / cut - 1) > 0.05
    assert clear.mean() > 0.9 and 10 < (want > cut).sum() < 120
    assert all(got[i].kept == (d <= cut) for i, d, c in zip(rows_in, want, clear) if c)
    assert abs(quality.chi2_cdf(quality.chi2_quantile(0.9, 8), 8) - 0.9) < 1e-9


def test_small_groups_use_the_fit_to_all_rows(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(60, 300)).capitalize(), "en", "a", 0) for i in range(200)]
    rows += [(200, prose(rng, 100).capitalize(), "xx", "b", 0), (201, " ".join(w + "###" for w in prose(rng, 100).split()), "xx", "b", 0)]
    got = {r.doc_id: r.kept for r in quality.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[200] and not got[201]
    few = quality.digest(spark.createDataFrame(rows[:3], SCHEMA)).collect()
    assert all(r.kept for r in few)


def test_groups_with_nearly_half_junk(spark):
    """Junk that passes the base rules goes, whether varied or copies of one text, and the rest stays."""
    rng = random.Random(4)
    rows, bad = [], set()
    for source, share, copies in (("a", 0.33, False), ("b", 0.33, True), ("c", 0.45, False), ("d", 0.45, True), ("e", 0.28, True)):
        one = None
        for i in range(300):
            words = prose(rng, rng.randrange(60, 300)).capitalize().split()
            text = "\n".join(" ".join(words[k : k + 12]) + "." for k in range(0, len(words), 12))
            if i < 300 * share:
                bad.add(len(rows))
                text = " ".join(w + rng.choice(["###", "%%%", "|&"]) for w in text.split(" "))
                text = one = (one or text) if copies else text
            rows.append((len(rows), text, "en", source, 0))
    got = quality.digest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert not any(r.base_failed for r in got)
    assert {r.doc_id for r in got if not r.kept} == bad
