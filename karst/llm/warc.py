"""WARC archives compressed with Zstandard: one frame for each record, behind a skippable frame that holds the dictionary.

A page becomes a record. Pages with equal payloads (by SHA-256) of `least` bytes or more are stored once: the one with the
smallest page_id is a response, the others are revisits, whose block is the HTTP header alone and which name the response
they refer to. The reader finds frames by their block headers, decodes each by itself, and checks headers, lengths, and
the payload's digest; what doesn't hold raises an error, or with strict=False comes back as the record's `error`.

Each archive's dictionary is trained on the first records of its part (at most `sample` bytes of them); an archive too
small for that has none. A manifest (a Parquet table) names the archives of the attempts that were committed.

Defined results: null html is an empty payload, null page_id counts as the largest and is written as none, a null url gives
no target of its own. Of equal pages with the smallest page_id one is the response. Rows are kept, repeated ones too;
other columns aren't read. An empty table gives an empty manifest and an empty result.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, tidied
from .records import _place

#: Fixed values of the formats: frame magics, bytes in a frame's parts, the revisit profile.
DICTIONARY_FRAME = 0x184D2A5D
FRAME, DICTIONARY = 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPES = ("response", "revisit", "warcinfo", "request", "resource", "metadata", "conversion", "continuation")
MANIFEST = "part int, file string, records long, bytes long"
RECORD = "file string, offset long, record_type string, record_id string, target string, page_id long, refers_to long, payload binary, payload_bytes long, payload_digest string, error string"


class Damage(ValueError):
    """A record or frame that isn't as the format says."""


# --------------------------------------------------------------------------- frames


def frame_end(data: memoryview, at: int) -> int | None:
    """Where the frame that begins at `at` ends, by its block headers; None if the data end before."""
    import zstandard

    head = data[at : at + 18]
    if len(head) < 5:
        return None
    if int.from_bytes(head[:4], "little") != FRAME:
        raise Damage("no frame begins here")
    flags = head[4]
    size = zstandard.frame_header_size(bytes(head)) if len(head) >= 18 or len(data) > at + 5 else None
    if size is None:
        return None
    at += size
    while True:
        if at + 3 > len(data):
            return None
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        if kind == 3:
            raise Damage("a block of a reserved type")
        at += 3 + (1 if kind == 1 else size)  # a repeated byte is stored once
        if last:
            at += 4 if flags & 4 else 0  # a checksum follows
            return at if at <= len(data) else None


def frames(source, limit: int = 1 << 30):
    """The dictionary of an archive's leading skippable frame, or None, then (offset, bytes) of each frame, read in pieces."""
    head = source.read(8)
    held, base, dictionary = bytearray(head), 0, None
    if int.from_bytes(head[:4], "little") == DICTIONARY_FRAME:
        size = int.from_bytes(head[4:8], "little")
        dictionary = source.read(size)
        if len(dictionary) < size:
            raise Damage("the dictionary is cut off")
        held, base = bytearray(), 8 + size
    yield dictionary
    at, ended = 0, False
    while True:
        end = frame_end(memoryview(held), at) if len(held) > at else None
        if end is not None:
            yield base + at, bytes(held[at:end])
            at = end
            continue
        if ended:
            if len(held) > at:
                raise Damage("the archive is cut off")
            return
        if len(held) - at > limit:
            raise Damage("a frame is longer than allowed")
        del held[:at]
        base, at = base + at, 0
        more = source.read(max(1 << 20, len(held)))
        held += more
        ended = not more


def _dictionary(raw: bytes | None):
    """As zstandard takes it; the frame holds it as it is, or compressed itself."""
    import zstandard

    if raw is None:
        return None
    if int.from_bytes(raw[:4], "little") == FRAME:
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if int.from_bytes(raw[:4], "little") != DICTIONARY:
        raise Damage("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(raw)


# --------------------------------------------------------------------------- records


def _header(lines: list[tuple[str, str]], first: str) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in lines), "\r\n"]).encode()


def _uri(url: str) -> str:
    """The url without what would end its header line: white space and controls are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record_id(page_id: int | None, digest: str, copy: int | None = None) -> str:
    return f"<urn:karst:page:{'none' if page_id is None else page_id}:{digest}{'' if copy is None else f':{copy}'}>"


def compose(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, copy: int | None, date: str) -> bytes:
    """One record. refers_to: the id of the response that holds the payload; its absence makes this a response."""
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http if refers_to else http + payload
    own = record_id(page_id, digest, copy)
    lines = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", _uri(url) if url else own[1:-1])]
    if refers_to:
        lines += [("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)]
    lines += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(lines, "WARC/1.1") + block + b"\r\n\r\n"


def _fields(head: bytes, what: str) -> tuple[str, dict[str, str]]:
    """The first line, and the fields by lower-case name; a line that begins with white space goes on with the one before."""
    try:
        first, *lines = head.decode("utf-8").split("\r\n")
    except UnicodeDecodeError:
        raise Damage(f"{what} isn't UTF-8") from None
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name or name in out:
            raise Damage(f"{what} has a line that is no field, or a field twice")
        out[name] = value.strip()
    return first, out


def _length(fields: dict[str, str], what: str) -> int:
    told = fields.get("content-length", "")
    if not (told.isascii() and told.isdigit()):
        raise Damage(f"{what} states no length")
    return int(told)


def _page_of(urn: str | None) -> int | None:
    parts = (urn or "").strip("<>").split(":")
    return int(parts[3]) if parts[:3] == ["urn", "karst", "page"] and len(parts) > 4 and parts[3].lstrip("-").isdigit() else None


def parse(record: bytes) -> dict:
    """A record's fields, checked. A payload is what follows the HTTP header, or the block of other records."""
    end = record.find(b"\r\n\r\n")
    if end < 0:
        raise Damage("the header doesn't end")
    first, fields = _fields(record[:end], "the header")
    if first not in ("WARC/1.0", "WARC/1.1"):
        raise Damage("no WARC version in the first line")
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]
    if missing:
        raise Damage(f"{missing[0]} is missing")
    n = _length(fields, "the header")
    block, tail = record[end + 4 : end + 4 + n], record[end + 4 + n :]
    if len(block) < n or tail != b"\r\n\r\n":
        raise Damage("the block isn't as long as stated")
    told = fields.get("warc-block-digest", "")
    if told.startswith("sha256:") and told[7:].lower() != hashlib.sha256(block).hexdigest():
        raise Damage("the block's digest does not hold")
    kind, payload, digest = fields["warc-type"], block, fields.get("warc-payload-digest", "")
    size = n
    if kind in ("response", "revisit") and fields.get("content-type", "").startswith("application/http"):
        stop = block.find(b"\r\n\r\n")
        if stop < 0:
            raise Damage("the HTTP header doesn't end")
        _, http = _fields(block[:stop], "the HTTP header")
        payload = block[stop + 4 :]
        size = _length(http, "the HTTP header") if kind == "revisit" or "content-length" in http else len(payload)
        if kind == "response" and size != len(payload):
            raise Damage("the payload isn't as long as stated")
    if kind == "revisit":
        if "warc-refers-to" not in fields and "warc-refers-to-target-uri" not in fields:
            raise Damage("a revisit that refers to nothing")
        payload = None
    else:
        own = hashlib.sha256(payload).hexdigest()
        if digest.startswith("sha256:") and digest[7:].lower() != own:
            raise Damage("the payload's digest does not hold")
        digest = f"sha256:{own}"
    return {
        "record_type": kind, "record_id": fields["warc-record-id"], "target": fields.get("warc-target-uri"), "page_id": _page_of(fields["warc-record-id"]),
        "refers_to": _page_of(fields.get("warc-refers-to")), "payload": payload, "payload_bytes": size, "payload_digest": digest.removeprefix("sha256:").lower() or None, "error": None,
    }


# --------------------------------------------------------------------------- tables


def responses(pages: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """pages (uid, page_id, url, payload, digest) with the first page_id and uid of their payload's group, where there is one."""
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "uid")
    groups = pages.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
    # written, so that both sides of the join are shuffled by it and a hot digest's rows can be split
    firsts = scratch.write(groups.filter("copies > 1").select(F.col("digest").alias("of"), F.col("first.page_id").alias("first_page"), F.col("first.uid").alias("first_uid")), "firsts")
    return pages.join(firsts, F.col("digest") == F.col("of"), "left")


def write_warc(pages: DataFrame, root: str, least: int = 100, dictionary_bytes: int = 32 << 10, sample: int = 4 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes archives of all pages (page_id, url, html) under root; returns the manifest, which is kept there too.

    date: of the records, as pages have none.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc-pages")
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    staged = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    staged = scratch.write(staged.select("*", F.sha2("payload", 256).alias("digest"), F.monotonically_increasing_id().alias("uid")), "pages")
    # equal pages are told apart by their place, which is written first so that it is one and the same for all readers
    dealt = responses(staged, least, scratch)
    first = F.col("first_uid").isNull() | (F.col("uid") == F.col("first_uid"))
    dealt = dealt.select("page_id", "url", "payload", "digest", "uid", first.alias("response"), "first_page", F.col("first_uid").isNotNull().alias("shared"))

    def archive(batches):
        import zstandard

        part = TaskContext.get().partitionId()
        files, where = _place(root)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.warc.zst"
        state = {"out": None, "size": 0, "records": 0}
        waiting: list[bytes] = []

        def start():
            files.create_dir(f"{where}/data", recursive=True)
            state["out"] = files.open_output_stream(f"{where}/data/{name}", compression=None)
            made = None
            if len(waiting) >= 8 and sum(map(len, waiting)) >= 8 * dictionary_bytes:
                made = zstandard.train_dictionary(dictionary_bytes, waiting, level=level)
                raw = made.as_bytes()
                put(DICTIONARY_FRAME.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw)
            state["zstd"] = zstandard.ZstdCompressor(level=level, dict_data=made, write_checksum=True, write_content_size=True)
            for r in waiting:
                put(state["zstd"].compress(r))
            waiting.clear()

        def put(data: bytes):
            state["out"].write(data)
            state["size"] += len(data)

        held = 0
        for batch in batches:
            for rows in slices(batch, "payload"):
                for page_id, url, text, digest, uid, response, first_page, shared in zip(*(rows.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "uid", "response", "first_page", "shared")), strict=True):
                    # ids are unique: the response of a group has none but the page's and the payload's, all others their place too
                    refers = None if response else record_id(first_page, digest)
                    r = compose(page_id, url, text.encode(), digest, refers, None if response and shared else uid, date)
                    state["records"] += 1
                    if state["out"] is None:
                        waiting.append(r)
                        held += len(r)
                        if held >= sample:
                            start()
                    else:
                        put(state["zstd"].compress(r))
        if waiting:
            start()
        if state["out"] is not None:
            state["out"].close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([state["records"]], pa.int64()), pa.array([state["size"]], pa.int64())], [c.split()[0] for c in MANIFEST.split(", ")])

    dealt.mapInArrow(tidied(archive), MANIFEST).write.parquet(f"{root}/manifest")
    scratch.drop()
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def read_files(spark: SparkSession, root: str, files: DataFrame, strict: bool = True) -> DataFrame:
    """The records (see RECORD) of the archives that `files` names in its column file, found under root/data.

    strict=False: a damaged record is a row with an error; behind a damaged frame the rest of its archive can't be found, and
    is one row with an error.
    """
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in RECORD.split(", ")]

    def read(batches):
        import zstandard

        store, where = _place(root)
        rows: list[dict] = []
        size = 0

        def told():
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_stream(f"{where}/data/{name}", compression=None) as f:
                    found = frames(f)
                    try:
                        zstd = zstandard.ZstdDecompressor(dict_data=_dictionary(next(found)))
                        for offset, frame in found:
                            row = {"file": name, "offset": offset}
                            try:
                                row |= parse(zstd.decompressobj().decompress(frame))
                            except (Damage, zstandard.ZstdError) as e:
                                if strict:
                                    raise ValueError(f"{name} at {offset}: {e}") from e
                                row["error"] = str(e)
                            rows.append(row)
                            size += len(row.get("payload") or b"") + 500
                            if size > 1 << 21:
                                yield told()
                                rows, size = [], 0
                    except Damage as e:
                        if strict:
                            raise ValueError(f"{name}: {e}") from e
                        rows.append({"file": name, "error": str(e)})
        if rows:
            yield told()

    n = max(1, files.count())
    return files.select("file").repartition(n, "file").mapInArrow(tidied(read), RECORD)


def read_warc(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """The records of all archives in the manifest under root."""
    return read_files(spark, root, spark.read.schema(MANIFEST).parquet(f"{root}/manifest"), strict)


def unresolved(records: DataFrame) -> DataFrame:
    """Revisits without a response of the same page, digest and length."""
    held = records.filter("record_type = 'response'").select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"))
    same = F.col("refers_to").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b"))
    return records.filter("record_type = 'revisit'").join(held, same, "left_anti")


def digest(pages: DataFrame) -> DataFrame:
    """What op11 returns, as read back from the archives."""
    spark = pages.sparkSession
    root = Scratch(spark, "warc").root
    write_warc(pages, root)
    return read_warc(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first_page
  FROM p WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST)
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND place > 1 THEN first_page END AS refers_to
FROM g
"""
