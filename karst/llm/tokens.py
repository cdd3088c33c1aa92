"""Token ids of whole texts, by the tokenizers library, with a cache of word pieces."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import U, prefix, range_hash, utf8

#: Byte classes of the byte-level pre-tokenizer's pattern.
LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = LETTER
_CLASS[ord("A") : ord("Z") + 1] = LETTER
_CLASS[0xC3:0xC9] = LETTER  # lead bytes of U+00C0 to U+023F
_CLASS[0x80:0xC0] = LETTER  # bytes that follow them
_CLASS[ord("0") : ord("9") + 1] = DIGIT
_CLASS[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = SPACE

#: Texts with other bytes, or with U+00D7 or U+00F7, are encoded whole.
_PLAIN = np.ones(256, bool)
_PLAIN[0xC0:0xC3] = False
_PLAIN[0xC9:] = False


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes batches of texts.

    The pre-tokenizer cuts a text into pieces that are encoded one by one, so a piece has the same ids
    wherever it stands. The cuts are made here for whole batches; the library encodes each piece it has not
    met yet. Texts with characters outside ASCII and U+00C0 to U+023F, or with a special token's string, go
    to the library whole. The cache finds a piece by a hash and compares its bytes with those it was made from; a text
    with a piece that differs goes to the library whole. It is emptied when it holds `most` pieces: that changes speed,
    not ids.
    """

    _kept: dict[str, "Encoder"] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One for each Python worker and file."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.most = most
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre = told.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and told.get("normalizer") is None and not (told.get("model") or {}).get("dropout")
        self.special = [x["content"].encode() for x in told.get("added_tokens") or [] if x["content"]]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, U)
        #: of each key: where its ids begin and how many they are, where its bytes begin and how many they are
        self.first, self.count, self.at, self.size = (np.empty(0, np.int64) for _ in range(4))
        self.ids, self.bytes = np.empty(0, np.uint32), np.empty(0, np.uint8)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows in turn as uint32, and each row's bounds in them; null counts as empty."""
        raw, at = utf8(column)
        n = len(at) - 1
        whole = np.zeros(n, bool) if self.by_piece else np.ones(n, bool)
        if self.by_piece and len(raw):
            odd = ~_PLAIN[raw]
            two = (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
            odd[:-1] |= two
            if odd.any():
                whole[np.searchsorted(at, np.flatnonzero(odd), side="right") - 1] = True
            text = raw.tobytes()
            for s in self.special:
                i = text.find(s)
                while i >= 0:
                    whole[np.searchsorted(at, i, side="right") - 1] = True
                    i = text.find(s, i + 1)
        ids: list = [None] * n
        rest = np.flatnonzero(~whole)
        if len(rest):
            sub, sub_at = raw, at
            if len(rest) < n:
                parts = [raw[at[r] : at[r + 1]] for r in rest]
                sub_at = np.zeros(len(rest) + 1, np.int64)
                np.cumsum([len(p) for p in parts], out=sub_at[1:])
                sub = np.concatenate(parts)
            found, bounds, differs = self._by_piece(sub, sub_at)
            if len(rest) == n and not len(differs):
                return found, bounds
            for i, r in enumerate(rest):
                ids[r] = found[bounds[i] : bounds[i + 1]]
            whole[rest[differs]] = True
        rows = np.flatnonzero(whole)
        texts = [bytes(raw[at[r] : at[r + 1]]).decode("utf-8", "replace") for r in rows]
        for i in range(0, len(rows), 64):
            for r, e in zip(rows[i : i + 64], self.library.encode_batch(texts[i : i + 64], add_special_tokens=False), strict=True):
                ids[r] = np.asarray(e.ids, np.uint32)
        out = np.zeros(n + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=out[1:])
        return (np.concatenate(ids) if n else np.empty(0, np.uint32)), out

    @staticmethod
    def cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where pieces begin. Pieces: a contraction, else an optional space and a run of letters, digits or
        other characters, else white space; of white space before something else the last character stands apart."""
        n = len(raw)
        kind = _CLASS[raw]
        fresh = np.zeros(n + 1, bool)  # a text begins here
        fresh[at] = True
        begin = np.ones(n, bool)
        np.not_equal(kind[1:], kind[:-1], out=begin[1:])
        begin |= fresh[:n]
        space = kind == SPACE
        # the last of a run of white space, with something after it in the same text
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:] & ~fresh[1:n]
        at_last = np.flatnonzero(last)
        begin[at_last] = True
        joins = at_last[raw[at_last] == 0x20]
        begin[joins + 1] = False
        # contractions
        quote = np.flatnonzero((raw == 0x27) & begin)
        if len(quote):
            one = np.minimum(quote + 1, n - 1)
            two = np.minimum(quote + 2, n - 1)
            in1 = (quote + 1 < n) & ~fresh[np.minimum(quote + 1, n)]
            in2 = in1 & (quote + 2 < n) & ~fresh[np.minimum(quote + 2, n)]
            a, b = raw[one], raw[two]
            short = in1 & np.isin(a, np.frombuffer(b"stmd", np.uint8))
            long = in2 & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
            for hit, size in ((short, 2), (long & ~short, 3)):
                q = quote[hit]
                begin[q + 1] = False
                after = q + size
                after = after[after < n]
                begin[after[(kind[after] == LETTER)]] = True
        return np.flatnonzero(begin)

    def _by_piece(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all rows in turn, each row's bounds in them, and the rows with a piece that isn't what its key stands for."""
        if not len(raw):
            return np.empty(0, np.uint32), np.zeros(len(at), np.int64), np.empty(0, np.int64)
        begin = self.cuts(raw, at)
        end = np.append(begin[1:], len(raw))
        key = range_hash(prefix(raw), begin, end)
        known, where, back = np.unique(key, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.keys, known)
        found = slot < len(self.keys)
        found[found] = self.keys[slot[found]] == known[found]
        if not found.all():
            if len(self.keys) > self.most:
                self._clear()
                found[:] = False
            new = np.flatnonzero(~found)
            pieces = [raw[begin[w] : end[w]].tobytes() for w in where[new]]
            got = [e.ids for e in self.library.encode_batch_fast([p.decode("utf-8") for p in pieces], add_special_tokens=False)]
            count = np.fromiter(map(len, got), np.int64, len(got))
            size = np.fromiter(map(len, pieces), np.int64, len(pieces))
            first = len(self.ids) + np.cumsum(count) - count
            place = len(self.bytes) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in got for i in x), np.uint32, int(count.sum()))])
            self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(pieces), np.uint8)])
            put = np.searchsorted(self.keys, known[new])
            self.keys = np.insert(self.keys, put, known[new])
            self.first, self.count = np.insert(self.first, put, first), np.insert(self.count, put, count)
            self.at, self.size = np.insert(self.at, put, place), np.insert(self.size, put, size)
            slot = np.searchsorted(self.keys, known)
        own = slot[back]
        size = end - begin
        longer = self.size[own] != size
        # pieces stand side by side, so a byte's own place and its piece's shift give the byte it is compared with
        source = np.repeat(np.where(longer, 0, self.at[own] - begin), size) + np.arange(len(raw))
        unlike = raw != self.bytes[np.minimum(source, len(self.bytes) - 1)]
        differs = np.unique(np.searchsorted(at, np.concatenate([begin[longer], np.flatnonzero(unlike)]), side="right") - 1)
        first, count = self.first[own], self.count[own]
        ends = np.cumsum(count)
        total = int(ends[-1])
        ids = self.ids[np.arange(total) + np.repeat(first - (ends - count), count)]
        bounds = np.concatenate([[0], ends])
        return ids, bounds[np.searchsorted(begin, at)], differs
