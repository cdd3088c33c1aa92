"""License scans: fuzzy search of short notices.

A notice within k edits of its wording holds at least one of k + 1 pieces of it unchanged. So each notice is cut into
k + 1 seeds, one automaton finds all seeds in a text, and around each hit the regex library matches the whole
notice with at most k errors and reports the span. Each hit's window is matched by itself, so a text that repeats a seed
costs time in proportion to its hits; equal windows are matched once. Of overlapping spans of a notice that with the
fewest edits stays (the first of equals). Beside it, the phrases of PHRASES are found word by word.

Letters A-Z count as a-z. Null text counts as empty; a text without a hit has no labels and score 0. Notices are
found in whole texts, wherever they stand; repeated rows give repeated results. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidied, utf8

#: Base phrases, as words, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short notices in lower case, and their labels. Wordings of public licenses.
NOTICES = (
    ("apache", "licensed under the apache license, version 2.0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("gpl", "under the terms of the gnu general public license"),
    ("gpl", "gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms, with or without modification"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("isc", "permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("epl", "made available under the terms of the eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("boost", "distributed under the boost software license"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("cc-by", "this work is licensed under cc by 4.0"),
    ("cc0", "creative commons zero public domain dedication"),
)

#: Words are runs of these bytes of a text in lower case: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ as UTF-8.
_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[ord("0") : ord("9") + 1] = True
_WORD_BYTES[ord("a") : ord("z") + 1] = True
_WORD_BYTES[ord("A") : ord("Z") + 1] = True
_WORD_BYTES[0x80:] = True
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")

SPAN = "struct<label:string,notice:string,begin:int,end:int,edits:int>"


def edits_allowed(notice: str, rate: float) -> int:
    return max(1, int(len(notice) * rate))


class Scanner:
    """The automaton and the patterns; one for each Python worker."""

    _kept: dict = {}

    @classmethod
    def of(cls, notices: tuple, rate: float) -> Scanner:
        if (notices, rate) not in cls._kept:
            cls._kept[notices, rate] = cls(notices, rate)
        return cls._kept[notices, rate]

    def __init__(self, notices: tuple, rate: float):
        import ahocorasick
        import regex

        self.notices = [(label, text, edits_allowed(text, rate)) for label, text in notices]
        self.patterns = [regex.compile(f"(?e)(?:{regex.escape(text, special_only=True)}){{e<={k}}}") for _, text, k in self.notices]
        by_seed = defaultdict(list)
        for i, (_, text, k) in enumerate(self.notices):
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                by_seed[text[a:b]].append((i, a))
        self.automaton = ahocorasick.Automaton()
        for seed, places in by_seed.items():
            self.automaton.add_word(seed, (len(seed), places))
        self.automaton.make_automaton()
        self._window = lru_cache(1 << 14)(self._match)

    def _match(self, i: int, window: str) -> tuple:
        # an edit spoils three of the notice's trigrams at most, so with fewer of them in the window there is no match
        _, notice, k = self.notices[i]
        held = {window[j : j + 3] for j in range(len(window) - 2)}
        if sum(notice[j : j + 3] in held for j in range(len(notice) - 2)) < len(notice) - 2 - 3 * k:
            return ()
        return tuple((m.start(), m.end(), sum(m.fuzzy_counts)) for m in self.patterns[i].finditer(window))

    def find(self, text: str) -> list[tuple]:
        """(label, notice, begin, end, edits) of each place, in code points of the text in lower case."""
        windows: dict[int, set] = defaultdict(set)
        for last, (size, places) in self.automaton.iter(text):
            for i, a in places:
                windows[i].add(last - size + 1 - a)
        found = []
        for i, begins in windows.items():
            label, notice, k = self.notices[i]
            spans = set()
            for begin in begins:
                a = max(0, begin - k)
                spans |= {(n, a + s, a + e) for s, e, n in self._window(i, text[a : begin + len(notice) + k])}
            taken: list[tuple] = []  # (begin, end), in order
            for n, s, e in sorted(spans):
                at = bisect_left(taken, (s, e))
                if (at == 0 or taken[at - 1][1] <= s) and (at == len(taken) or e <= taken[at][0]):
                    taken.insert(at, (s, e))
                    found.append((label, notice, s, e, n))
        return sorted(found, key=lambda x: (x[2], x[3], x[0], x[1]))


def base(lower: bytes) -> tuple[list[str], list[int]]:
    """Labels and starting words of the places of PHRASES."""
    if not (b"license" in lower or b"cc" in lower):
        return [], []
    found = _WORDS.findall(lower)
    labels, starts = [], []
    heads = {p.split()[0].encode(): ([w.encode() for w in p.split()], label) for p, label in PHRASES.items()}
    for i, w in enumerate(found):
        if w in heads:
            phrase, label = heads[w]
            if found[i : i + len(phrase)] == phrase:
                labels.append(label)
                starts.append(i)
    return labels, starts


COLUMNS = f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<{SPAN}>"


def scan(docs: DataFrame, notices: tuple = NOTICES, rate: float = 0.09) -> DataFrame:
    """doc_id, counts and labels of each text, and the spans of its notices (in code points).

    rate: edits allowed for each character of a notice. The score is 1 for a text with a base phrase, else the best
    notice's share of characters that needed no edit, else 0.
    """
    kind = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))

    def run(batches):
        scanner = Scanner.of(notices, rate)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                raw, at = utf8(part.column("text"))
                inside = _WORD_BYTES[raw]
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                edge = at[1:-1]
                edge = edge[edge < len(raw)]
                begins[edge] = inside[edge]
                seen = np.concatenate([[0], np.cumsum(begins)])
                n_words = seen[at[1:]] - seen[at[:-1]]
                text = raw.tobytes().lower()
                rows = []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = text[a:b]
                    labels, starts = base(own)
                    spans = scanner.find(own.decode("utf-8", "replace"))
                    best = max((1 - s[4] / len(s[1]) for s in spans), default=0.0)
                    rows.append((len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(set(labels))), ",".join(sorted({*labels, *(s[0] for s in spans)})), 1.0 if starts else best, [dict(zip(("label", "notice", "begin", "end", "edits"), s, strict=True)) for s in spans]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), kind)
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), f"doc_id long, {COLUMNS}")


def spans(docs: DataFrame, **options) -> DataFrame:
    """A row for each notice found: doc_id, label, notice, begin, end, edits."""
    return scan(docs, **options).select("doc_id", F.inline("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """What op5 returns, with the notices' number and spans."""
    return scan(docs).withColumn("n_notices", F.size("spans"))
