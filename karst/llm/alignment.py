"""Alignment of two tokenizers: token occurrences that share bytes, and how many documents hold each id pair linked.

A is a byte-level BPE that gets a space and the text; B adds the space itself. Offsets where a token of either ends cut the
bytes into groups; every A token of a group is linked with every B token of it.

No token of either tokenizer crosses a place where a run of other characters ends and a space, tab or line feed begins, so a
text is a row of words (white space, then the rest), and a word has the same tokens and groups wherever it stands. Each Arrow
partition is taken in chunks of about `chunk_bytes` of text. Of a chunk, DuckDB gets the token intervals of the words that
the worker hasn't met yet: an ASOF join finds the B token under each A token's first byte, a window sum over the offsets
where both begin numbers the groups, a range join puts B tokens into them. It then joins words with documents and counts
each document's links by id pair. How many of the chunk's documents hold a pair is written as a partial count; the
partial counts are summed in Spark, and go back to the chunks, whose documents are summed up with them.

Defined results: a null or empty text, or one whose tokens don't spell a space and the text (U+2581 in it), has no tokens:
zeros and an empty digest; it counts for no pair. Repeated rows are documents of their own, null doc_id stay null. An empty
table gives an empty result. Other columns aren't read. A text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prefix, range_hash, slices, tidied, utf8
from .tokens import _PLAIN, tokenizer_path

WHITE, OPENS = np.zeros((2, 256), bool)
WHITE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
#: White space that a word can begin with; some pieces of B end in others (");\\r").
OPENS[[0x09, 0x0A, 0x20]] = True
#: Fixed value: what the piece tokenizer writes for a space.
SPACE_MARK = "▁"

#: a and b: word, id, start, stop; words stand side by side, so no token touches another word's.
GROUPS = """
CREATE OR REPLACE TEMP TABLE ga AS
SELECT word, id, start, stop, sum(opens) OVER (ORDER BY start ROWS UNBOUNDED PRECEDING)::BIGINT AS grp
FROM (SELECT a.word, a.id, a.start, a.stop, (b.start = a.start)::INT AS opens FROM a ASOF JOIN b ON a.start >= b.start);
CREATE OR REPLACE TEMP TABLE spans AS SELECT grp, any_value(word) AS word, min(start) AS lo, max(stop) AS hi FROM ga GROUP BY grp;
CREATE OR REPLACE TEMP TABLE gb AS SELECT s.word, b.id, b.start, s.grp FROM b JOIN spans s ON b.start >= s.lo AND b.start < s.hi;
INSERT INTO linked
SELECT x.word, (x.id::BIGINT << 32) | y.id AS pair, sum(x.n * y.n)::BIGINT AS n
FROM (SELECT word, grp, id, count(*) AS n FROM ga GROUP BY ALL) x JOIN (SELECT grp, id, count(*) AS n FROM gb GROUP BY ALL) y USING (grp)
GROUP BY ALL;
"""
HELD = "SELECT doc, pair, sum(times * n)::BIGINT AS n FROM held JOIN linked USING (word) GROUP BY doc, pair"


class ByteTable:
    """The bytes of each id."""

    def __init__(self, entries: list[bytes]):
        self.size = np.fromiter(map(len, entries), np.int64, len(entries))
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes in turn, and where each token ends in them."""
        size = self.size[ids]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.data[np.arange(total) + np.repeat(self.at[ids] - (end - size), size)], end


class ByteTokens:
    """The byte-level tokenizer, for which special tokens' strings are text like any other. Where merges stand in the order of
    their ids, tiktoken gives the same ids from the file's vocabulary in less time."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre, model = told.get("pre_tokenizer") or {}, told["model"]
        #: whether no token goes on behind a word's end
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and told.get("normalizer") is None and not model.get("dropout")
        # printable stand-ins of bytes, as the byte-level alphabet gives them: printable Latin-1 stands for itself
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        back = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*own}))}
        ids = {bytes(back[c] for c in entry): i for entry, i in model["vocab"].items() if all(c in back for c in entry)}
        entries = [b""] * (1 + max(ids.values()))
        for entry, i in ids.items():
            entries[i] = entry
        self.table = ByteTable(entries)
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        if all(model["vocab"].get(m) == 256 + i for i, m in enumerate(merged)):
            import public_tokenizers
            import tiktoken

            special = {t["content"].encode() for t in told.get("added_tokens") or []}
            ranks = {e: i for e, i in ids.items() if i < 256 + len(merged) and e not in special}
            self._encode = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            self._encode = lambda text: library.encode(text, add_special_tokens=False).ids

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [self._encode(w.decode()) for w in words]
        count = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int64, int(count.sum())), count


class PieceTokens:
    """The piece tokenizer on words that begin with white space."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not self.library.is_byte(i) and not self.library.is_control(i)]
        #: whether no piece goes on behind a word's end, so that words can be encoded one by one
        self.by_word = not any(SPACE_MARK in p.lstrip(SPACE_MARK) or any(c in p for c in "\t\n ") for p in plain) and self.library.encode("a b  c") == self.library.encode("a") + self.library.encode("b") + self.library.encode(" c")
        self.table = ByteTable([bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)])
        self.mark = self.library.piece_to_id(SPACE_MARK)

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words in turn, and how many each has. The library puts a space in front, which is the word's own if it
        begins with one."""
        got = self.library.encode([(w[1:] if w[:1] == b" " else w).decode() for w in words], num_threads=1)
        for i, w in enumerate(words):
            if w[:1] != b" ":
                got[i] = got[i][1:]
            elif len(w) == 1:
                got[i] = [self.mark]
        count = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int64, int(count.sum())), count


def _intervals(ids: np.ndarray, count: np.ndarray, table: ByteTable, words: list[bytes], sizes: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """Token intervals over the words side by side, and whether each word is spelled by its tokens."""
    spelled, end = table.spell(ids)
    told = np.append(0, end)[np.cumsum(count)]
    want = np.cumsum(sizes)
    ok = np.diff(told, prepend=0) == sizes
    if ok.all():
        unlike = np.flatnonzero(spelled != np.frombuffer(b"".join(words), np.uint8))
        ok[np.searchsorted(want, unlike, side="right")] = False
    else:
        for i in np.flatnonzero(ok):
            ok[i] = spelled[told[i] - sizes[i] : told[i]].tobytes() == words[i]
    word = np.repeat(np.arange(len(words)), count)
    # a word that isn't spelled by its tokens may be of another length: tokens are placed by the words' own places
    size = table.size[ids]
    start = (want - sizes)[word] + end - size - np.append(0, told[:-1])[word]
    return pa.table({"word": word, "id": ids, "start": start, "stop": start + size}), ok


_DECIMAL = ByteTable([f"{i},".encode() for i in range(1 << 16)])


def _told(ga: dict, gb: dict, words: int) -> list[bytes]:
    """Each word's groups as text, each with ; behind it. ga, gb: word, grp and id of tokens in order."""
    a, b = ga["grp"], gb["grp"]
    item = np.empty(len(a) + len(b), np.int64)
    behind = np.full(len(item), ord(","), np.uint8)
    of_a = np.arange(len(a)) + np.searchsorted(b, a, side="left")
    of_b = np.arange(len(b)) + np.searchsorted(a, b, side="right")
    item[of_a], item[of_b] = ga["id"], gb["id"]
    for grp, place, mark in ((a, of_a, "|"), (b, of_b, ";")):
        behind[place[np.append(grp[1:] != grp[:-1], True)] if len(grp) else place] = ord(mark)
    if len(item) and item.max() >= len(_DECIMAL.size):
        raise ValueError("an id of 65,536 or more")
    text, end = _DECIMAL.spell(item)
    text[end - 1] = behind
    last = np.searchsorted(ga["word"], np.arange(words), side="right") + np.searchsorted(gb["word"], np.arange(words), side="right")
    at = np.append(0, end)[np.append(0, last)].tolist()
    whole = text.tobytes()
    return [whole[i:j] for i, j in zip(at, at[1:], strict=False)]


class Words:
    """Words that a Python worker has met, with their tokens and links; the links stay in DuckDB. It is emptied when it
    holds `most` words, which changes speed, not results."""

    _kept: dict = {}

    @classmethod
    def of(cls, *paths: str) -> Words:
        if paths not in cls._kept:
            cls._kept[paths] = cls(*paths)
        return cls._kept[paths]

    def __init__(self, path_a: str, path_b: str, most: int = 450_000, memory: str = "300MB"):
        import duckdb

        self.a, self.b, self.most = ByteTokens(path_a), PieceTokens(path_b), most
        if not (self.a.by_word and self.b.by_word):
            raise ValueError("the tokenizers' tokens go on behind words' ends")
        self.con = duckdb.connect(":memory:")
        self.con.execute(f"SET threads = 1; SET memory_limit = '{memory}'; SET temp_directory = ''; SET preserve_insertion_order = false")
        self._clear()

    def _clear(self) -> None:
        self.con.execute("CREATE OR REPLACE TEMP TABLE linked (word BIGINT, pair BIGINT, n BIGINT)")
        self.place: dict[bytes, int] = {}
        self.told: list[bytes] = []
        self.ok, self.numbers = np.empty(0, bool), np.empty((4, 0), np.int64)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The words' places in told, ok and numbers (A tokens, B tokens, groups, links)."""
        if len(self.place) > self.most:
            self._clear()
        new = [w for w in words if w not in self.place]
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        for i in range(0, len(new), 1 << 16):
            self._add(new[i : i + (1 << 16)])
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def _add(self, words: list[bytes]) -> None:
        base, n = len(self.told), len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        fine, numbers = np.ones(n, bool), np.zeros((4, n), np.int64)
        for k, (name, side) in enumerate((("a", self.a), ("b", self.b))):
            ids, count = side.tokens(words)
            table, ok = _intervals(ids, count, side.table, words, sizes)
            self.con.register(f"{name}_all", table)
            fine &= ok
            numbers[k] = count
        self.con.register("fine", pa.table({"word": np.flatnonzero(fine)}))
        for name in "ab":
            self.con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT word + {base} AS word, id, start, stop FROM {name}_all" + ("" if fine.all() else " SEMI JOIN fine USING (word)"))
        self.con.execute(GROUPS)
        ga, gb = (self.con.execute(f"SELECT word - {base} AS word, grp, id FROM {t} ORDER BY start").fetchnumpy() for t in ("ga", "gb"))
        firsts = np.append(True, ga["grp"][1:] != ga["grp"][:-1])[: len(ga["grp"])]
        np.add.at(numbers[2], ga["word"][firsts], 1)
        links = self.con.execute(f"SELECT word - {base} AS word, sum(n)::BIGINT AS n FROM linked WHERE word >= {base} GROUP BY word").fetchnumpy()
        numbers[3][links["word"]] = links["n"]
        self.told += _told(ga, gb, n)
        self.ok, self.numbers = np.append(self.ok, fine), np.concatenate([self.numbers, numbers], axis=1)


def _words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and the word each row begins with. A word begins at white space behind a byte that surely is none:
    in texts of plain letters any other byte, else an ASCII character (some longer ones are white space for A)."""
    n = len(raw)
    begin = np.zeros(n, bool)
    white = WHITE[raw]
    begin[1:] = OPENS[raw[1:]] & ~white[:-1] & (raw[:-1] > 0x20)
    odd = np.unique(np.searchsorted(at, np.flatnonzero(~_PLAIN[raw]), side="right") - 1)
    for r in odd:
        own = slice(at[r] + 1, at[r + 1])
        begin[own] &= raw[at[r] : at[r + 1] - 1] < 0x7F
    begin[at[:-1][at[:-1] < at[1:]]] = True
    begin = np.flatnonzero(begin)
    return begin, np.searchsorted(begin, at)


def _distinct(raw: np.ndarray, begin: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different words, and which of them each word is. Found by a hash, then compared byte by byte."""
    end = np.append(begin[1:], len(raw))
    _, where, which = np.unique(range_hash(prefix(raw), begin, end), return_index=True, return_inverse=True)
    size = end - begin
    like = where[which]
    longer = size[like] != size
    source = np.repeat(np.where(longer, 0, begin[like] - begin).astype(np.int32 if len(raw) < 1 << 31 else np.int64), size)
    source += np.arange(len(raw), dtype=source.dtype)
    differ = np.flatnonzero(np.add.reduceat(raw != raw[source], begin) > 0) if len(begin) else np.empty(0, np.int64)
    words = [raw[begin[w] : end[w]].tobytes() for w in where]
    extra: dict[bytes, int] = {}
    for w in {*np.flatnonzero(longer).tolist(), *differ.tolist()}:  # words that share a hash with another
        which[w] = extra.setdefault(raw[begin[w] : end[w]].tobytes(), len(words) + len(extra))
    return [*words, *extra], which


ALIGNED = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, width int, steps binary, times binary, pairs array<long>, docs array<int>"


def _chunk(known: Words, chunk: int, doc_ids: pa.Array, texts: pa.Array):
    """A row for each document, and one with the chunk's pairs. A document's pairs are steps along the chunk's, with its links
    of each, in as many bytes as the chunk's largest needs."""
    raw, at = utf8(texts)
    n = len(at) - 1
    full = at[1:] > at[:-1]
    spaced = np.insert(raw, at[:-1][full], 0x20)  # a space in front of each text that isn't empty
    at = at + np.append(0, np.cumsum(full))
    begin, first = _words(spaced, at)
    words, which = _distinct(spaced, begin)
    which = known.find(words)[which] if words else which
    row = np.repeat(np.arange(n), np.diff(first))
    lost = np.zeros(n, bool)
    lost[row[~known.ok[which]]] = True
    keep = ~lost[row]
    row, which = row[keep], which[keep]
    bounds = np.searchsorted(row, np.arange(n + 1))
    sums = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(known.numbers[:, which], axis=1)], axis=1)
    numbers = sums[:, bounds[1:]] - sums[:, bounds[:-1]]
    told, digests = known.told, [""] * n
    for r in np.flatnonzero(np.diff(bounds)):
        text = b"".join([told[w] for w in which[bounds[r] : bounds[r + 1]].tolist()])
        digests[r] = hashlib.sha256(memoryview(text)[:-1]).hexdigest()
    spread = max(1, len(known.told))
    key, times = np.unique(row * spread + which, return_counts=True)
    doc, word = np.divmod(key, spread)
    del sums, key, row, which, begin, spaced
    known.con.register("held", pa.table({"doc": doc, "word": word, "times": times}))
    got = known.con.execute(HELD).fetchnumpy()
    pairs, own = np.unique(got["pair"], return_inverse=True)
    order = np.argsort(got["doc"] * max(1, len(pairs)) + own)
    doc, own, times = got["doc"][order], own[order], got["n"][order]
    at_doc = np.searchsorted(doc, np.arange(n + 1))
    steps = np.diff(own, prepend=0)
    steps[at_doc[:-1][at_doc[:-1] < at_doc[1:]]] = own[at_doc[:-1][at_doc[:-1] < at_doc[1:]]]
    width = 2 if not len(own) or max(len(pairs), times.max()) < 1 << 16 else 8
    columns = [pa.array(np.full(n, chunk)), doc_ids, *map(pa.array, numbers), pa.array(digests, pa.string()), pa.array(np.full(n, width, np.int32))]
    for x in (steps.astype(f"<u{width}"), times.astype(f"<u{width}")):
        columns.append(pa.array([x[i:j].tobytes() for i, j in zip(at_doc[:-1], at_doc[1:], strict=True)], pa.binary()))
    names, kinds = [c.split()[0] for c in ALIGNED.split(", ")], [pa.list_(pa.int64()), pa.list_(pa.int32())]
    yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, k) for k in kinds)], names)
    docs = np.bincount(own, minlength=len(pairs)).astype(np.int32)
    for i in range(0, len(pairs), 1 << 16):
        some = [pa.array([x[i : i + (1 << 16)]], k) for x, k in zip((pairs, docs), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([chunk]), *(pa.nulls(1, c.type) for c in columns[1:]), *some], names)


def _summed(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one chunk, with the counts of their links summed up. counts: of the chunk's pairs."""
    order = np.argsort(counts["pair"].to_numpy())
    count, top = counts["count"].to_numpy()[order], counts["top"].to_numpy()[order]
    n = docs.num_rows
    best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r, (width, steps, times) in enumerate(zip(*(docs[c].to_pylist() for c in ("width", "steps", "times")), strict=True)):
        own = np.cumsum(np.frombuffer(steps, f"<u{width}").astype(np.int64))
        links = np.frombuffer(times, f"<u{width}").astype(np.int64)
        best[r], total[r] = links[top[own]].sum(), (links * count[own]).sum()
    told = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return told.append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total)).append_column("groups_sha256", docs["groups_sha256"])


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk_bytes: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """Documents with their alignment (see RESULT), and id pairs (pair, a_id, b_id, count, top: no pair of its A id has more)."""
    path_a, path_b = path_a or tokenizer_path(), path_b or tokenizer_path("piece_bpe_32k.model")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "alignment")

    def work(batches):
        known, chunk = Words.of(path_a, path_b), TaskContext.get().partitionId() << 32
        kept, size = [], 0
        for batch in batches:
            for rows in slices(batch, "text", chunk_bytes // 4):
                more = len(utf8(rows.column("text"))[0])
                if kept and size + more > chunk_bytes:
                    yield from flush(known, chunk, kept)
                    chunk, kept, size = chunk + 1, [], 0
                kept.append(rows)
                size += more
        if kept:
            yield from flush(known, chunk, kept)

    def flush(known, chunk, kept):
        whole = pa.concat_batches([b.set_column(1, "text", b.column("text").cast(pa.large_string())) for b in kept])
        yield from _chunk(known, chunk, whole["doc_id"], whole["text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    aligned = scratch.write(rows.mapInArrow(tidied(work), ALIGNED), "aligned")
    held = aligned.filter(F.col("pairs").isNotNull()).select("chunk", F.explode(F.arrays_zip("pairs", "docs")).alias("own"))
    partial = held.select("chunk", F.col("own.pairs").alias("pair"), F.col("own.docs").alias("docs"))
    counted = partial.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a_id", F.shiftright("pair", 32))
    most = counted.groupBy("a_id").agg(F.max("count").alias("most"))
    pairs = counted.join(most, "a_id").select("pair", "a_id", F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"), "count", (F.col("count") == F.col("most")).alias("top"))
    counts = scratch.write(pairs, "counts")
    answers = partial.join(counts, "pair").select("chunk", "pair", "count", "top")
    out = spark.read.schema(aligned.schema).parquet(scratch.path("aligned")).filter(F.col("steps").isNotNull()).drop("pairs", "docs")
    return out.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_summed, RESULT), counts


def digest(docs: DataFrame) -> DataFrame:
    """What op13 returns."""
    return align(docs)[0]
