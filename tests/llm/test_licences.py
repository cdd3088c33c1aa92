import random
import re
import time

import regex
from karst.llm import licences

from .conftest import SCHEMA, prose


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + "q" + text[i:], text[:i] + "q" + text[i + 1 :]])
    return text


def corpus(rng):
    out = []
    for label, notice in licences.NOTICES:
        k = licences.edits_allowed(notice, 0.09)
        for n in (0, 1, k, 3 * k):
            out.append(prose(rng, rng.randrange(0, 30)) + " " + edited(rng, notice, n).replace("license", rng.choice(["license", "License"])) + rng.choice([".", "\n" + prose(rng, 20)]))
    return out + ["GNU\nGeneral  Public-License cc by CC-BY", "cc by cc by", "xcc by", "mit licenses", "", None, "The MIT License, and Apache License"]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    w = words(text)
    places = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    low = (text or "").encode().lower().decode()
    found = {label for label, n in licences.NOTICES if regex.search(f"(?:{regex.escape(n, special_only=True)}){{e<={licences.edits_allowed(n, 0.09)}}}", low)}
    base = {x for _, x in places}
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found))


def test_against_brute_force(spark, odd_docs, no_docs):
    rows = list(enumerate(corpus(random.Random(7))))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in licences.digest(docs).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == brute(t), t
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    for r in licences.spans(docs).collect():
        own = rows[r.doc_id][1].encode().lower().decode()[r.begin : r.end]
        assert regex.fullmatch(f"(?:{regex.escape(r.notice, special_only=True)}){{e<={r.edits}}}", own)
    odd = licences.digest(odd_docs)
    assert odd.count() == odd_docs.count() and licences.digest(no_docs).collect() == []


def test_texts_that_repeat_a_seed():
    scanner = licences.Scanner(licences.NOTICES, 0.09)
    rng = random.Random(3)
    begin = time.perf_counter()
    for word in ("permission ", "gnu ", "licensed under the ", "released under the mit license "):
        text = word * (1_000_000 // len(word))
        found = scanner.find(text)
        assert all(a[3] <= b[2] for a, b in zip(found, found[1:]) if a[1] == b[1])
        if word.startswith("released"):
            assert [(s[2], s[4]) for s in found if s[0] == "mit"] == [(i * len(word), 0) for i in range(1_000_000 // len(word))]
    mixed = " ".join(rng.choice(["permission", "gnu", "license", "under", "the", str(rng.random())]) for _ in range(20_000))
    scanner.find(mixed)
    assert time.perf_counter() - begin < 30
