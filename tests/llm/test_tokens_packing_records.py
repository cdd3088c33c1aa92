import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from karst.llm import packing, records
from karst.llm.common import Scratch
from karst.llm.tokens import Encoder, tokenizer_path
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def test_ids_are_the_librarys(library):
    rng = random.Random(1)
    texts = ["", " ", "it's we're  'twas 's 'sx", "a\t b\n\nc  ", "<|endoftext|>", "日本", None, "x\xa0y", "''s '''s 9's é'll"]
    texts += ["".join(rng.choice(["'", "s", "re", "ll", " ", "  ", "\n", "é", "1", "!", "a", "×"]) for _ in range(rng.randrange(14))) for _ in range(2000)]
    ids, at = Encoder.of(tokenizer_path()).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_plan_uses_every_piece_once_and_fits():
    rng = random.Random(2)
    lengths = [rng.choice([rng.randrange(1, 2049), rng.randrange(1, 200), 2048, 1000]) for _ in range(5000)]
    histogram = defaultdict(int)
    for n in lengths:
        histogram[n] += 1
    used, bins = defaultdict(int), 0
    for items, count in packing.plan(dict(histogram)):
        assert sum(n * k for n, k in items) <= 2048
        assert sum(k for n, k in items if 3 * n > 2048) <= 2
        bins += count
        for n, k in items:
            used[n] += k * count
    assert used == histogram
    assert bins <= 1.02 * max(-(-sum(lengths) // 2048), sum(2 * n > 2048 for n in lengths)) + 1


def expected(odd_docs, library, end):
    out = []
    for r in odd_docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, end]
        out.append((r["doc_id"], r["text"], ids))
    return out


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_packing(odd_docs, no_docs, library):
    got = packing.digest(odd_docs).collect()
    want = []
    for doc, _, ids in expected(odd_docs, library, 0):
        head = len(ids) % 2048 or min(2048, len(ids))
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        want += [(doc, i, a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by) <= 1 + 1.1 * sum(r.length for r in got) / 2048
    assert packing.digest(no_docs).collect() == []
    whole = packing.pack_documents(odd_docs).collect()
    assert sorted(crc(np.frombuffer(r.ids, "<u2")) for r in whole) == sorted(r.ids_crc32 for r in got)
    with pytest.raises(Exception, match="2 bytes"):
        packing.pack_documents(odd_docs, end_id=70_000).collect()


def test_a_hash_that_two_pieces_share_changes_no_ids(library, monkeypatch):
    from karst.llm import tokens

    monkeypatch.setattr(tokens, "range_hash", lambda sums, begin, end: (end - begin).astype(np.uint64))  # pieces of a length collide
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["cat", "dog", "bird", "1", "x"]) for _ in range(rng.randrange(6))) for _ in range(50)]
    encoder = Encoder(tokenizer_path())
    for _ in range(2):
        ids, at = encoder.encode(pa.array(texts))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_records(spark, odd_docs, no_docs, library):
    got = records.digest(odd_docs).orderBy("start").collect()
    want = expected(odd_docs, library, 2)
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(((doc, len(ids), crc(ids)) for doc, _, ids in want), key=key)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((doc is not None, doc or 0) for doc, _, _ in want)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert records.digest(no_docs).collect() == []


def test_shuffled_reads_and_wide_ids(spark, odd_docs):
    root = Scratch(spark, "test").root
    records.write_records(odd_docs, root, width=4)
    plain = sorted(map(tuple, records.read_records(spark, root).collect()), key=str)
    dealt = records.read_records(spark, root, seed=3)
    assert sorted(map(tuple, dealt.collect()), key=str) == plain
    assert [r.start for r in dealt.collect()] != sorted(r.start for r in dealt.collect())


def test_framing():
    assert records.crc32c([b"123456789"])[0] == 0xE3069283
    rng = np.random.default_rng(1)
    payloads = [rng.bytes(n) for n in (4, 5, 255, 256, 257, 1000, 70000)]
    data = b"".join(framed := records.frame(payloads))
    at = np.cumsum([0, *map(len, framed[:-1])])
    assert records.unframe(data, at) == payloads
    with pytest.raises(ValueError):
        records.unframe(data[:300] + b"\x00\x01" + data[302:], at)
