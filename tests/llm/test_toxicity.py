import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from karst.llm import toxicity
from pyspark.sql import functions as F

from .conftest import SCHEMA, prose


def area(rows):
    """Share of pairs of a label-1 and a label-0 row in the right order."""
    good, bad = [s for s, x in rows if x], [s for s, x in rows if not x]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def corpus(rng, n=1200):
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.15)
        w = prose(rng, rng.randrange(20, 120)).split()
        for _ in range(rng.randrange(2, 6) * toxic):
            w[rng.randrange(len(w))] = rng.choice(["zorfte", "Zorftig", "zorften", "kwelm"])
        docs.append((i, " ".join(w), "de", "s", 0))
        labels.append((i, 0, toxic))
    return docs, labels


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = corpus(random.Random(1))
    d = spark.createDataFrame(docs, SCHEMA).cache()
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.digest(d, y, trees=8).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in got if got[i].held_out} == set(held)
    assert area([(got[i].score, labels[i][2]) for i in held]) > 0.97
    assert sum(got[i].predicted == labels[i][2] for i in held) / len(held) > 0.95
    flipped = y.withColumn("toxic", F.when(toxicity.remainder(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.digest(d, flipped, trees=8).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in got)


def test_odd_tables(spark, odd_docs, no_docs):
    y = spark.createDataFrame([(i, 0, i % 2) for i in range(60)] + [(None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.digest(odd_docs, y, trees=3).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and not (r.doc_id is None and r.held_out) for r in got)
    none = y.filter("false")
    assert {r.score for r in toxicity.digest(odd_docs, none).collect()} == {0.0}
    assert toxicity.digest(no_docs, y, trees=3).collect() == []


def slow(text, known):
    """The features by their definitions, word by word. known: the log odds of whole words and beginnings."""
    raw = (text or "").encode()
    lower = re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text or "")
    found = [(m.start(), m[0]) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", lower.encode())]
    w = [x for _, x in found]
    per, chars = len(w) + 5.0, len(raw) + 50.0

    def best(x):
        terms = [x, *(x[:n] for n in toxicity.BEGINNINGS)]
        return max(((known.get(t, 0.0), -i, t) for i, t in enumerate(terms)), default=(0.0, 0, b""))

    scored = [best(x) for x in w]
    learned = [s > 0 for s, _, _ in scored]
    insult, second = [[x.decode("utf-8", "replace") in words for x in w] for words in (toxicity.INSULTS, toxicity.SECOND_PERSON)]
    near = sum((learned[i] or insult[i]) and any(second[max(0, i - 5) : i + 6]) for i in range(len(w)))
    low = lower.encode()
    alpha = [chr(b).isalpha() and b < 128 or b >= 128 for b in raw]
    inner = range(1, len(raw) - 1)
    rate = lambda hit: sum(map(hit, raw)) / chars
    wordy = lambda b: chr(b).isalnum() and b < 128 or b >= 128
    return [
        sum(insult) / per, sum(insult), sum(learned) / per, sum(learned), len({t for (s, _, t), hit in zip(scored, learned) if hit}), sum(s for s, _, _ in scored) / per, max((s for s, _, _ in scored), default=0.0),
        near, sum(second) / per, rate(lambda b: 65 <= b <= 90), sum(len(x) >= 3 and all(65 <= b <= 90 for b in raw[a : a + len(x)]) for a, x in found) / per,
        rate(lambda b: b == 33), rate(lambda b: b == 63), rate(lambda b: b > 32 and not wordy(b)),
        sum(raw[i] in b"*@$#!0123456789" and alpha[i - 1] and alpha[i + 1] for i in inner) / per, sum(alpha[i] and low[i - 1] == low[i] == low[i + 1] for i in inner) / per,
        rate(lambda b: 48 <= b <= 57), math.log1p(len(w)), sum(map(len, w)) / len(w) if w else 0.0,
    ]


def test_features_against_slow_ones():
    rng = random.Random(5)
    vocabulary = ["you", "IDIOT", "idiot", "dein", "Über", "ÜBLE", "tú", "sch*t", "l0ser", "soooo", "kwelm", "kwelmish", "zorf", "ab", "x", "9", "é!", "?!", "--", "\n", "日本"]
    texts = [None, "", " ", "you", "!!!", *(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))) for _ in range(150))]
    known = {b"kwelm": 2.5, b"kwel": 2.0, b"zorf": 1.5, "üble".encode(): 3.0, b"soooo"[:4]: 0.5}
    keys = toxicity._hashes(tuple(k.decode() for k in known))
    order = np.argsort(keys)
    got = toxicity.features(pa.array(texts), keys[order], np.array(list(known.values()))[order])
    for text, row in zip(texts, got):
        assert np.allclose(row, slow(text, known)), text
