import hashlib
from collections import Counter, defaultdict

import pytest
from karst.llm import alignment
from karst.llm.tokens import tokenizer_path


def plainly(texts):
    """Whole texts, token by token, pair by pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(c): c for c in own} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in own)}
    rows, pairs = [], []
    for text in texts:
        want = (" " + text).encode() if text else b""
        a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)] if text else []
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want or not want:
            rows.append((0, 0, 0, []))
            pairs.append(Counter())
            continue
        ends = []
        for side in (a, b):
            n, out = 0, []
            for _, x in side:
                n += len(x)
                out.append(n)
            ends.append(out)
        cuts = sorted({*ends[0]} & {*ends[1]})
        groups = [([], []) for _ in cuts]
        for s, side in enumerate((a, b)):
            g = 0
            for (i, _), e in zip(side, ends[s], strict=True):
                while e > cuts[g]:
                    g += 1
                groups[g][s].append(i)
        rows.append((len(a), len(b), len(groups), groups))
        pairs.append(Counter((x, y) for p, q in groups for x in p for y in q))
    count, best = Counter(k for p in pairs for k in p), defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    told = []
    for (n_a, n_b, n_g, groups), p in zip(rows, pairs, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        told.append((n_a, n_b, n_g, sum(p.values()), sum(n for k, n in p.items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in p.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return told


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check(spark, docs, **how):
    rows = docs.select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), *x) for r, x in zip(rows, plainly([r.text for r in rows]), strict=True))
    got = sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in alignment.align(docs, **how)[0].collect())
    assert got == want


def test_odd_documents_against_brute_force(spark, odd_docs):
    check(spark, odd_docs)
    check(spark, odd_docs, chunk_bytes=3000)


def test_whole_table_against_brute_force(spark):
    check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), chunk_bytes=1 << 18)


ODD = [
    " ", "  ", "x ", "x  ", "\n", "\n\n x", "\t\tx\n  y\r\n", " ▁ x", "a▁b", "  x  \nfoo", "x \n y", "日本語のテキスト と 空白　です", "🙂🙂 🙂\n🙂", "<|endoftext|>", "a<|endoftext|> b</s> <s><0x41> <unk>",
    "it's we'll 'tis o'clock's", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20, "0123456789" * 30, "\x00\x01\x1c x\x1f y\x85z", "é é ﬁ ñ", "--- *** ===   ###\n\n\n", "x y z", "a" + " " * 40 + "b", "\v\f x", "﻿x", "क्षत्रिय भाषा\nनई",
]


def test_odd_texts_against_brute_force(spark):
    check(spark, spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, *ODD[::-1], "".join(ODD), "\n".join(ODD), None, ""])], "doc_id long, text string"))


def test_empty(spark, no_docs):
    assert alignment.align(no_docs)[0].collect() == []


def test_words_that_share_a_hash(monkeypatch):
    import numpy as np

    monkeypatch.setattr(alignment, "range_hash", lambda sums, begin, end: (end - begin).astype(np.uint64) % np.uint64(2))
    raw = np.frombuffer(b" ab cd abc ab de", np.uint8)
    begin = np.array([0, 3, 6, 10, 13])
    words, which = alignment._distinct(raw, begin)
    assert [words[i] for i in which] == [b" ab", b" cd", b" abc", b" ab", b" de"] and len({*which}) == 4


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_against_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    texts = ["".join(rng.choice(" \n\t\r  abcABC'.,-0123é×÷ſ日 ▁<>|") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    check(spark, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
