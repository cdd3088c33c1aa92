import random
import re

import numpy as np
import pyarrow as pa
import pytest
from karst.llm import minhash
from karst.llm.common import utf8

from .conftest import SCHEMA, prose


def shingled(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    """Least doc_id of each row's class."""
    texts = list(dict.fromkeys((t or "") for _, t in rows))
    sets = [shingled(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    at = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for d, t in rows:
        k = at[t or ""]
        if d is not None:
            least[k] = min(d, least.get(k, d))
    return [(d, least.get(at[t or ""])) for d, t in rows]


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = prose(rng, 1)
    return " ".join(w)


def corpus(rng):
    texts = [prose(rng, rng.randrange(1, 200)) for _ in range(60)]
    common = prose(rng, 80)
    texts += [common + " " + prose(rng, rng.randrange(20, 60)) for _ in range(40)]  # alike, but not enough
    base = prose(rng, 300)
    texts += [edited(rng, base, rng.randrange(1, 14)) for _ in range(60)] + [base]
    for _ in range(10):
        b = prose(rng, rng.randrange(30, 250))
        texts += [b, b, edited(rng, b, 1), edited(rng, b, 2), b + " " + prose(rng, 5)]
    chain = prose(rng, 200)
    for _ in range(8):
        chain = edited(rng, chain, 4)
        texts.append(chain)
    rng.shuffle(texts)
    return texts


def test_against_brute_force(spark):
    for seed in range(2):
        rng = random.Random(seed)
        rows = list(enumerate(corpus(rng)))
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(4)
        got = sorted(map(tuple, minhash.digest(docs).collect()))
        assert got == sorted(brute(rows))
    # the last open buckets in small blocks
    blocks = minhash.left_over
    try:
        minhash.left_over = lambda *a, **k: blocks(*a, **k, block=2000)
        assert sorted(map(tuple, minhash.digest(docs).collect())) == got
    finally:
        minhash.left_over = blocks


def test_odd_tables(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in minhash.digest(odd_docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert minhash.digest(no_docs).collect() == []
    kept = minhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len({c for _, c in got if c is not None}) + (1 if any(c is None for _, c in got) else 0)


def test_registers_estimate_the_probability_jaccard():
    rng = np.random.default_rng(3)
    items = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    a, b = rng.integers(1, 9, 300).astype(float), rng.integers(1, 9, 300).astype(float)
    a[200:], b[:100] = 0, 0
    exact = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in range(300) if a[i] and b[i])
    m = 6000
    found = [minhash.registers(np.zeros((x > 0).sum(), np.int64), items[x > 0], x[x > 0], 1, m)[0] for x in (a, b)]
    assert abs((found[0] == found[1]).mean() - exact) < 0.02
    raw, at = utf8(pa.array(["a b c d e f", "a b", ""]))
    row, item, count = minhash.sets(raw, at)
    assert row.tolist() == [0, 0, 1] and count.tolist() == [1, 1, 1]


def test_copies_that_differ_in_how_often_a_line_repeats(spark):
    """Their sets of shingles are alike however far apart the counts are."""
    rng = random.Random(9)
    texts = []
    for _ in range(20):
        body, line = prose(rng, 200), prose(rng, 8)
        texts += [" ".join([body] + [line] * k) for k in (3, 30, 120)]
        texts.append(" ".join([edited(rng, body, 2)] + [line] * 60))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(4)
    got = sorted(map(tuple, minhash.digest(docs).collect()))
    assert got == sorted(brute(rows))
    assert len({c for _, c in got}) == 20


def test_probability_jaccard_of_weights():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x, y = (rng.integers(0, 4, 12).astype(float) for _ in range(2))
        a, b = np.flatnonzero(x), np.flatnonzero(y)
        want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(12) if x[i] and y[i])
        assert abs(minhash.alike(a, x[a], b, y[b]) - want) < 1e-12
        ones = len(set(a) & set(b)) / max(1, len(set(a) | set(b)))
        assert abs(minhash.alike(a, np.ones(len(a)), b, np.ones(len(b))) - ones) < 1e-12


def test_classes_by_counts(spark):
    """With weights by count, texts that differ in how often a line repeats are apart, and a heavy shared line joins others."""
    rng = random.Random(10)
    body, line = prose(rng, 200), prose(rng, 8)
    texts = [body, edited(rng, body, 1), " ".join([body] + [line] * 80), " ".join([prose(rng, 20)] + [line] * 80), " ".join([prose(rng, 20)] + [line] * 80)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert dict(map(tuple, minhash.digest(docs, weights="count").collect())) == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}
    assert dict(map(tuple, minhash.digest(docs).collect())) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}


@pytest.mark.parametrize("weights", ["once", "count"])
def test_links_within_a_task_lose_no_pair(weights):
    """Components of the links are those of all pairs, with components found before, and across two blocks."""
    rng = random.Random(6)
    for turn in range(60):
        base = rng.sample(range(400), 60)
        n = 40
        items = [np.array(sorted(set(rng.sample(base, rng.randrange(20, 60)) + rng.sample(range(400), rng.randrange(12)))), np.uint64) for _ in range(n)]
        sets = [(x, np.array([1.0 if weights == "once" else rng.choice([1, 1, 1, 2, 9]) for _ in x])) for x in items]
        root = [rng.choice([i, i, 0]) for i in range(n)] if turn % 2 else list(range(n))
        mine = [rng.randrange(2) for _ in range(n)]
        for across in (False, True):
            near = {(i, j) for i in range(n) for j in range(i) if (not across or mine[i] != mine[j]) and minhash.alike(*sets[i], *sets[j]) >= 0.8}
            given = list(minhash._links(list(range(n)), root, sets, mine, across, 0.8, weights))
            assert {(max(p), min(p)) for p in given} <= near

            def classes(links, root=root):
                label = {r: r for r in root}
                for i, j in links:
                    a, b = label[root[i]], label[root[j]]
                    label = {k: b if v == a else v for k, v in label.items()}
                return [label[r] for r in root]

            got, want = classes(given), classes(near)
            assert [(got[i] == got[j]) == (want[i] == want[j]) for i in range(n) for j in range(i)].count(False) == 0


def templated(rng, n, words, own):
    """n texts of `words` words of which the last `own` are their own."""
    template = prose(rng, words - own)
    return [template + " " + " ".join(f"{i}w{k}" for k in range(own)) for i in range(n)]


def test_templated_texts_below_the_threshold_are_not_compared(spark):
    """20,000 texts of 24 words, of which three are their own: alike by 0.739. Near copies among them meet."""
    import time

    rng = random.Random(7)
    texts = templated(rng, 20_000, 24, 3)
    near = {20_000 + i: i * 100 for i in range(40)}
    texts += [texts[i] + " more" for i in near.values()]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(8)
    began = time.time()
    got = dict(map(tuple, minhash.digest(docs).collect()))
    took = time.time() - began
    print("20,000 templated texts:", took)
    assert {i: c for i, c in got.items() if i != c} == near and took < 60
    row, item, count = minhash.sets(*utf8(pa.array(texts[:3000])))
    sets = [(x, np.ones(len(x))) for x in np.split(item, np.flatnonzero(np.diff(row)) + 1)]
    assert minhash._Prefixes(sets, np.arange(3000), 0.8, "once").ask == {}


def test_a_bucket_of_templated_texts(spark):
    """Texts of one template that are not alike enough stay apart; near copies among them meet."""
    rng = random.Random(7)
    for words, own in ((180, 60), (24, 3), (60, 8)):
        texts = templated(rng, 150, words, own)
        texts += [edited(rng, texts[i], 1) for i in range(0, 150, 10)]
        rows = list(enumerate(texts))
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
        assert sorted(map(tuple, minhash.digest(docs).collect())) == sorted(brute(rows))
