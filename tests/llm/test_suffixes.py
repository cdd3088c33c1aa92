import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from karst.llm import suffixes
from karst.llm.common import utf8

from .conftest import SCHEMA, prose


def brute(texts, length=200):
    """Per text: bytes, removed, runs, digest of what stays."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def corpus(rng):
    passages = [prose(rng, rng.randrange(20, 120)) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [prose(rng, rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            parts += [rng.choice([p, p[a:b], p[:b], p[a:]]), prose(rng, rng.randrange(0, 30))]
        texts.append(rng.choice([" ", "\n", ""]).join(parts))
    base = prose(rng, 150)
    for _ in range(12):  # near copies
        i = rng.randrange(len(base))
        texts.append(base[:i] + rng.choice(["", "x", "édit"]) + base[i + 1 :])
    texts += ["a" * 500, "a" * 199, "a" * 200, "ab" * 300, "ba" * 99, base, base, None, "", passages[0][:200], passages[0][1:201], passages[0][3:203] + "\0\0" + passages[0][:210], "\0" * 450]
    return texts


def test_against_brute_force(spark):
    for seed in range(2):
        rng = random.Random(seed)
        texts = corpus(rng)
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
        want = brute(texts)
        for options in ({}, {"hot": 1}, {"hot": 3}):
            if options:
                rows, _ = suffixes.repeated(docs, **options)
                got = {r.node: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows.collect()}
                for t, w in zip(texts, want):
                    node = hashlib.md5((t or "").encode()).digest()
                    assert got.get(node, (w[0], 0, 0, w[3])) == w
            else:
                got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(docs).collect()}
                assert [got[i] for i in range(len(texts))] == want


def test_odd_tables(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want = brute([r.text for r in rows])
    got = suffixes.digest(odd_docs).collect()
    assert sorted((str(r.doc_id), *w) for r, w in zip(rows, want)) == sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert suffixes.digest(no_docs).collect() == []
    cut = suffixes.cut(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == len(rows)


def test_every_window_has_one_anchor_by_content():
    rng = random.Random(4)
    text = prose(rng, 300)
    a, b = "x" * 37 + text, prose(rng, 40) + text[50:]
    raw, at = utf8(pa.array([a, b]))
    row, place, found, first, last = suffixes.anchors(raw, at)
    by = {}
    for r, p, f, x, y in zip(row, place, found, first, last):
        for s in range(x, y + 1):
            by.setdefault(raw[s : s + 200].tobytes(), set()).add((int(f), int(p - s)))
    assert all(len(v) == 1 for v in by.values())
    assert sum(last - first + 1) == sum(max(0, len(t.encode()) - 199) for t in (a, b))


def aligned(rng, n):
    """Strings around anchors, as places in one buffer, with few symbols so that they share much."""
    raw = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(60)) * 40 + bytes(rng.choice(b"abc\0") for _ in range(2000)), np.uint8)
    place = np.array([rng.randrange(20, len(raw) - 40) for _ in range(n)])
    low, high = np.array([rng.randrange(0, 8) for _ in range(n)]), np.array([rng.randrange(8, 20) for _ in range(n)])
    return raw, place, low, high


def test_merged_transforms_are_the_transform_of_the_whole():
    rng = random.Random(8)
    for _ in range(30):
        n, length = rng.randrange(1, 60), 24
        raw, place, low, high = aligned(rng, n)
        group = np.sort(np.array([rng.randrange(3) for _ in range(n)]))
        symbols = suffixes.strings(raw, place, low, high, length)
        # shards within each group, in order
        shard = np.zeros(n, int)
        for i in range(1, n):
            shard[i] = shard[i - 1] + (group[i] != group[i - 1] or rng.random() < 0.3)
        merged = np.empty_like(symbols)
        string, near, far = suffixes.merge(group, shard, suffixes.transform(shard, symbols), length, merged)
        assert (merged == suffixes.transform(group, symbols)).all()
        # the transform of the whole, by sorting suffixes: each level's symbols in the order of what follows them
        ended = np.where(symbols == 0, -1 - np.arange(n), symbols)  # ends differ, the first of them least
        for t in (0, 1, 7, length - 1, length, len(symbols) - 1):
            order = sorted(range(n), key=lambda i: (group[i], [x if x > 0 else -n - 1 - x for x in ended[:t, i][::-1].tolist()], i))
            assert merged[t].tolist() == symbols[t, order].tolist()
        # repeated windows, by comparing all
        want = set()
        for i in range(n):
            for d in range(low[i], high[i] + 1):
                own = raw[place[i] - d : place[i] - d + length].tobytes()
                if any(j != i and group[j] == group[i] and low[j] <= d <= high[j] and raw[place[j] - d : place[j] - d + length].tobytes() == own for j in range(n)):
                    want.add((i, d))
        assert {(int(i), d) for i, a, b in zip(string, near, far) for d in range(a, b + 1)} == want


def test_a_frequent_passage_in_texts_that_differ(spark):
    rng = random.Random(12)
    short, long = prose(rng, 30)[:120], prose(rng, 60)[:230]
    texts = [prose(rng, 20) + rng.choice([short, long, long[:210]]) + prose(rng, 20) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    want = {hashlib.md5(t.encode()).digest(): w for t, w in zip(texts, brute(texts))}
    for hot in (1, 5, 30, 1000):
        rows, _ = suffixes.repeated(docs, hot=hot)
        got = {bytes(r.node): (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows.collect()}
        assert all(got.get(node, (w[0], 0, 0, w[3])) == w for node, w in want.items())


def test_a_long_text(spark):
    rng = random.Random(13)
    words = [prose(rng, 1) for _ in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(600_000))  # of some megabytes
    docs = spark.createDataFrame([(0, text, "en", "s", 0), (1, text[1_000_000:1_000_300], "en", "s", 0), (2, text[:-1], "en", "s", 0)], SCHEMA)
    got = {r.doc_id: r for r in suffixes.digest(docs).collect()}
    n = len(text.encode())
    assert (got[2].n_bytes, got[2].n_removed, got[1].n_removed) == (n - len(text[-1].encode()), n - len(text[-1].encode()), len(text[1_000_000:1_000_300].encode()))
    assert got[0].n_removed == got[2].n_removed and got[0].n_spans == 1
