"""MPEG audio columns: frames found again after damage, tags and variable-bitrate tables parsed, checksums verified.

parse() reads any MPEG audio (versions 1, 2 and 2.5, layers I to III, free bitrates too): it skips ID3v2 tags (2.2 to 2.4,
with extended headers and unsynchronisation), finds frame headers again after bytes that are none, reads a Xing, Info or
VBRI table in the first frame, verifies the CRC-16 of protected frames of every layer, and gives the exact number of
samples (without an encoder's delay and padding, where the table tells them) and the offset of every frame.

A frame counts if another header of the stream's kind, or the end, stands behind it. At the place where the frame before
it ends, one without that counts too, unless a frame that has it begins inside of it: so header-like bytes that slipped in
don't hide a true frame.

store() keeps bytes in such a stream without loss: MPEG-1 Layer III, 48 kHz, mono, protected, with empty granules and
the bytes as ancillary data, 192 bytes a unit and one to three units a frame (so the bitrate varies), after an ID3v2 tag with a
private frame and a frame with a Xing table. load() reads them back from the frames.

Null text counts as empty; an empty text is one unit of spaces. Equal texts have equal streams. Extra columns are
ignored. Damaged or empty media parse to what frames they have, none at worst; describe() gives them a null payload and says
why.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, tidied

#: Fixed values of the format: kilobits a second by version 1 or 2, layer and index; samples a second by version.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
VERSIONS = {0: 2.5, 2: 2, 3: 1}
LAYERS = {1: 3, 2: 2, 3: 1}

UNIT = 192
OWNER = b"payload"
#: Bitrate index by units in a frame, at 48 kHz: frames of 240, 480 and 672 bytes.
INDEX = {1: 6, 2: 10, 3: 12}
HEAD = 4 + 2 + 17  # header, checksum, side information


#: Fixed values of Layer II: bits of a subband's allocation, for the tables of version 1 and that of version 2.
ALLOCATION = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "low": (4,) * 4 + (3,) * 7 + (2,) * 19,
}


class Header(NamedTuple):
    version: float
    layer: int
    protected: bool
    bitrate: int  # 0: free, and the size is not told
    rate: int
    mode: int
    extension: int
    padding: int
    size: int
    samples: int

    @property
    def mono(self) -> bool:
        return self.mode == 3

    @property
    def kind(self) -> tuple:
        """What all frames of a stream share."""
        return self.version, self.layer, self.rate

    @property
    def side(self) -> int:
        """Bytes of side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """A frame header, or None if these bytes are none."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(four[1] >> 3 & 3), LAYERS.get(four[1] >> 1 & 3)
    index, rate_index = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer is None or index == 15 or rate_index == 3 or four[3] & 3 == 2:
        return None
    bitrate, rate, padding = BITRATES[min(2, int(version)), layer][index], RATES[version][rate_index], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    size = (12_000 * bitrate // rate + padding) * 4 if layer == 1 else samples // 8 * 1000 * bitrate // rate + padding
    return Header(version, layer, not four[1] & 1, bitrate, rate, four[3] >> 6, four[3] >> 4 & 3, padding, size if bitrate else 0, samples)


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """Polynomial 0x8005, from 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _crc16_bits(bits: str) -> int:
    crc = 0xFFFF
    for bit in bits:
        crc = (crc << 1 ^ 0x8005 if (crc >> 15) ^ (bit == "1") else crc << 1) & 0xFFFF
    return crc


def _bits(data: bytes) -> str:
    return "".join(f"{x:08b}" for x in data)


def _checked_bits(data: bytes, at: int, h: Header) -> str:
    """What the checksum of a Layer I or II frame covers: the header's second half and the allocation, and in Layer II
    which scale factors follow."""
    channels = 1 if h.mono else 2
    per_channel = h.bitrate // channels
    if h.layer == 1:
        sizes = (4,) * 32
    elif h.version != 1:
        sizes = ALLOCATION["low"]
    elif h.bitrate and per_channel <= 48:
        sizes = ALLOCATION["d" if h.rate == 32000 else "c"]
    else:
        sizes = ALLOCATION["a" if h.rate == 48000 or h.bitrate and per_channel <= 80 else "b"]
    bound = min(len(sizes), 4 * (h.extension + 1)) if h.mode == 1 else len(sizes)
    body = _bits(data[at + 6 : at + 6 + 120])
    i = chosen = 0
    for subband, n in enumerate(sizes):
        own = channels if subband < bound else 1
        for _ in range(own):
            chosen += (int(body[i : i + n] or "0", 2) > 0) * (channels if own < channels else 1)
            i += n
    return _bits(data[at + 2 : at + 4]) + body[: i + (2 * chosen if h.layer == 2 else 0)]


def _intact(data: bytes, at: int, h: Header) -> bool:
    """Whether a protected frame's checksum holds."""
    told = int.from_bytes(data[at + 4 : at + 6], "big")
    return (crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) if h.layer == 3 else _crc16_bits(_checked_bits(data, at, h))) == told


def _syncsafe(data: bytes) -> int:
    out = 0
    for byte in data:
        out = out << 7 | byte & 127
    return out


class Stream(NamedTuple):
    tags: dict  # of ID3v2 tags: frame id to the list of its frames' bytes; of an ID3v1 tag: "title", "artist"
    table: dict  # of a Xing, Info or VBRI table
    offsets: list  # of the frames that hold sound
    headers: list
    samples: int
    rate: int
    bad: int  # frames whose checksum does not hold
    skipped: int  # bytes that are in no frame and no tag

    @property
    def duration_us(self) -> int:
        return self.samples * 1_000_000 // self.rate if self.rate else 0


def _id3v2(data: bytes, begin: int, tags: dict) -> int:
    """Puts the frames of an ID3v2 tag into tags; where it ends, or begin if there is none."""
    if data[begin : begin + 3] != b"ID3" or len(data) < begin + 10:
        return begin
    version, flags = data[begin + 3], data[begin + 5]
    end = begin + 10 + _syncsafe(data[begin + 6 : begin + 10])
    body = data[begin + 10 : end]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 0x40 and version == 3:
        at = 4 + int.from_bytes(body[:4], "big")
    elif flags & 0x40 and version == 4:
        at = _syncsafe(body[:4])
    letters, digits, head = (3, 3, 6) if version == 2 else (4, 4, 10)
    number = _syncsafe if version == 4 else lambda x: int.from_bytes(x, "big")
    while at + head <= len(body) and body[at] != 0:
        size = number(body[at + letters : at + letters + digits])
        own = body[at + head : at + head + size]
        if version == 4:
            if body[at + 9] & 1:  # the length before unsynchronisation stands in front
                own = own[4:]
            if body[at + 9] & 2 or flags & 0x80:
                own = own.replace(b"\xff\0", b"\xff")
        tags.setdefault(body[at : at + letters].decode("latin-1"), []).append(own)
        at += head + size
    return end + (10 if flags & 0x10 and version == 4 else 0)


def _table(data: bytes, at: int, h: Header) -> dict:
    """A Xing or Info table behind the side information (with or without a checksum before it), or a VBRI table."""
    for start in (at + 4 + h.side, at + 6 + h.side):
        if data[start : start + 4] in (b"Xing", b"Info"):
            out, flags, i = {"kind": data[start : start + 4].decode()}, int.from_bytes(data[start + 4 : start + 8], "big"), start + 8
            for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit:
                    out[name] = list(data[i : i + n]) if name == "toc" else int.from_bytes(data[i : i + n], "big")
                    i += n
            if data[i : i + 4].isalpha() and i + 24 <= at + h.size:
                # an encoder's name, and 12 bits each of its delay and padding
                both = int.from_bytes(data[i + 21 : i + 24], "big")
                out |= {"encoder": data[i : i + 9].rstrip(b"\0 ").decode("latin-1"), "delay": both >> 12, "padding": both & 0xFFF}
            return out
    if data[at + 36 : at + 40] == b"VBRI":
        number = lambda a, n: int.from_bytes(data[at + a : at + a + n], "big")
        entries, scale, width = number(54, 2), number(56, 2), number(58, 2)
        toc = [number(62 + width * i, width) * scale for i in range(entries)] if 62 + width * entries <= h.size else []
        return {"kind": "VBRI", "bytes": number(46, 4), "frames": number(50, 4), "frames_an_entry": number(60, 2), "toc": toc}
    return {}


class _Frames:
    """Frames of a stream by their places."""

    def __init__(self, data: bytes, stop: int):
        self.data, self.stop = data, stop
        self.kind: tuple | None = None
        self.free: int | None = None  # bytes of a frame of a free bitrate, without padding

    def slot(self, h: Header) -> int:
        return h.padding * (4 if h.layer == 1 else 1)

    def alike(self, at: int, kind: tuple | None) -> Header | None:
        h = header(self.data[at : at + 4])
        return h if h is not None and at + 4 <= self.stop and (kind is None or h.kind == kind) else None

    def at(self, at: int) -> Header | None:
        """The header here, of the stream's kind, if its frame is whole; a free bitrate's size is told by the next header."""
        h = self.alike(at, self.kind)
        if h is None:
            return None
        if h.bitrate == 0:
            size = self.free
            if size is None:
                then = self.data.find(b"\xff", at + 24, self.stop)
                while then >= 0 and not ((g := self.alike(then, h.kind)) and g.bitrate == 0):
                    then = self.data.find(b"\xff", then + 1, self.stop)
                size = then - at - self.slot(h) if then >= 0 else 0
            if size <= 0:
                return None
            h = h._replace(size=size + self.slot(h))
        return h if at + h.size <= self.stop else None

    def sure(self, at: int) -> Header | None:
        """The header here, if the stream goes on or ends behind its frame."""
        h = self.at(at)
        return h if h is not None and (at + h.size == self.stop or self.alike(at + h.size, h.kind)) else None

    def hidden(self, begin: int, end: int) -> bool:
        """Whether a sure frame begins between these places."""
        at = self.data.find(b"\xff", begin, end)
        while at >= 0:
            if self.sure(at):
                return True
            at = self.data.find(b"\xff", at + 1, end)
        return False


def parse(data: bytes) -> Stream:
    tags: dict = {}
    at = 0
    while (then := _id3v2(data, at, tags)) > at:
        at = then
    stop = len(data)
    if stop - at >= 128 and data[stop - 128 : stop - 125] == b"TAG":
        stop -= 128
        tags |= {"title": data[stop + 3 : stop + 33].rstrip(b"\0 "), "artist": data[stop + 33 : stop + 63].rstrip(b"\0 ")}
    frames = _Frames(data, stop)
    table, offsets, headers = {}, [], []
    samples = bad = skipped = 0
    follows = False  # a frame ends here
    first = True
    while at + 4 <= stop:
        h = frames.sure(at)
        if h is None and follows and (h := frames.at(at)) and frames.hidden(at + 1, at + h.size):
            h = None
        if h is not None:
            frames.kind, follows = h.kind, True
            if h.bitrate == 0:
                frames.free = h.size - frames.slot(h)
            bad += h.protected and not _intact(data, at, h)
            if first and (table := _table(data, at, h)):
                pass  # it holds no sound
            else:
                offsets.append(at)
                headers.append(h)
                samples += h.samples
            first = False
            at += h.size
            continue
        follows = False
        again = data.find(b"\xff", at + 1, stop)
        again = stop if again < 0 else again
        skipped += again - at
        at = again
    samples = max(0, samples - table.get("delay", 0) - table.get("padding", 0))
    return Stream(tags, table, offsets, headers, samples, headers[0].rate if headers else 0, bad, skipped + max(0, stop - at))


@lru_cache(8)
def _front(units: int) -> bytes:
    """Header, checksum and side information of a frame."""
    head = bytes([0xFF, 0xFA, INDEX[units] << 4 | 1 << 2, 0xC4])
    side = bytes(17)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


@lru_cache(8)
def _room(units: int) -> int:
    return header(_front(units)[:4]).size


def store(payload: bytes, n_bytes: int) -> bytes:
    """A stream with the payload (a positive multiple of 192 bytes) in its frames."""
    private = OWNER + b"\0" + len(payload).to_bytes(8, "big") + n_bytes.to_bytes(8, "big") + zlib.crc32(payload).to_bytes(4, "big")
    safe = lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    frame = b"PRIV" + safe(len(private)) + b"\0\0" + private
    tag = b"ID3\x04\0\0" + safe(len(frame)) + frame
    whole, rest = divmod(len(payload) // UNIT, 3)
    grid = np.zeros((whole, _room(3)), np.uint8)
    grid[:, :HEAD] = np.frombuffer(_front(3), np.uint8)
    grid[:, HEAD : HEAD + 3 * UNIT] = np.frombuffer(payload, np.uint8, whole * 3 * UNIT).reshape(whole, 3 * UNIT)
    body = grid.tobytes()
    if rest:
        body += (_front(rest) + payload[whole * 3 * UNIT :]).ljust(_room(rest), b"\0")
    frames, size = whole + (rest > 0), _room(1) + len(body)
    toc = bytes(min(255, 256 * (_room(1) + _room(3) * (frames * i // 100)) // size) for i in range(100))
    xing = b"Xing" + (7).to_bytes(4, "big") + frames.to_bytes(4, "big") + size.to_bytes(4, "big") + toc
    return tag + (_front(1) + xing).ljust(_room(1), b"\0") + body


def payload_of(data: bytes, stream: Stream) -> tuple[bytes | None, int | None, str | None]:
    """The payload and the number of its bytes before padding; or None and why there is none."""
    private = next((x for x in stream.tags.get("PRIV", ()) if x.startswith(OWNER + b"\0")), None)
    if private is None:
        return None, None, "no payload is told of"
    if len(private) < 28:
        return None, None, "the payload's tag is cut off"
    size, n, crc = (int.from_bytes(private[a:b], "big") for a, b in ((8, 16), (16, 24), (24, 28)))
    payload = b"".join(data[o + HEAD : o + HEAD + (h.size - HEAD) // UNIT * UNIT] for o, h in zip(stream.offsets, stream.headers, strict=True))
    if stream.bad:
        return None, None, "a frame's checksum does not hold"
    if len(payload) != size:
        return None, None, "frames are missing or too many"
    if zlib.crc32(payload) != crc:
        return None, None, "the payload's checksum does not hold"
    return payload, n, None


def load(data: bytes, stream: Stream | None = None) -> tuple[bytes, int]:
    """The payload, and the number of its bytes before padding; raises if there is none or a checksum does not hold."""
    payload, n, why = payload_of(data, stream or parse(data))
    if payload is None:
        raise ValueError(why)
    return payload, n


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a stream."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                sizes, media = [], []
                for text in part.column("text").to_pylist():
                    data = (text or "").encode("utf-8", "surrogatepass")
                    sizes.append(len(data))
                    media.append(store(data.ljust(max(1, -(-len(data) // UNIT)) * UNIT), len(data)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, n_bytes long, media binary")


FEATURES = "samples long, rate int, duration_us long, frames int, table string, table_frames int, bad_frames int, skipped long, bitrates map<int,int>, seek array<long>, damage string"


def describe(rows: DataFrame) -> DataFrame:
    """Adds what parse() finds in the column media: exact samples and duration, frame offsets, tables and checks.

    For streams that store() made, payload is what the frames hold; where it can't be read it is null, and damage says why.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, {FEATURES}, payload binary"
    names = [x.split()[0] for x in FEATURES.replace("map<int,int>", "map").split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.map_(pa.int32(), pa.int32()), pa.list_(pa.int64()), pa.string()]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "media", 4 << 20):
                found, payloads = [], []
                for data in part.column("media").to_pylist():
                    s = parse(data or b"")
                    rates: dict = {}
                    for h in s.headers:
                        rates[h.bitrate] = rates.get(h.bitrate, 0) + 1
                    payload, _, why = payload_of(data or b"", s)
                    found.append((s.samples, s.rate, s.duration_us, len(s.offsets), s.table.get("kind"), s.table.get("frames"), s.bad, s.skipped, sorted(rates.items()), s.offsets, why))
                    payloads.append(payload)
                columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns, pa.array(payloads, pa.binary())], [*part.schema.names, *names, "payload"])

    return rows.mapInArrow(tidied(run), schema)


def digest(docs: DataFrame) -> DataFrame:
    """What op8 returns: checksums of the payload that is read back from the stored streams, and the streams' features."""
    scratch = Scratch(docs.sparkSession, "media")
    kept = scratch.write(encode(docs), "media")
    read = describe(kept)
    feature = F.format_string(
        "mpeg1-layer3 rate=%d samples=%d duration_us=%d frames=%d table=%s/%d bad=%d skipped=%d bitrates=%s seek=%s",
        "rate", "samples", "duration_us", "frames", "table", "table_frames", "bad_frames", "skipped", F.to_json("bitrates"), F.sha2(F.array_join(F.col("seek").cast("array<string>"), ","), 256),
    )
    return read.select(
        "doc_id", "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
