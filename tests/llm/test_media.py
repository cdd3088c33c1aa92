import hashlib
import random
import zlib

import pytest
from karst.llm import media


def padded(data):
    return data.ljust(max(1, -(-len(data) // 192)) * 192)


def test_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 191, 192, 193, 575, 576, 577, 5000, 100_000):
        data = rng.randbytes(n)
        stored = media.store(padded(data), n)
        s = media.parse(stored)
        assert media.load(stored) == (padded(data), n)
        assert s.bad == 0 and s.skipped == 0 and s.table["frames"] == len(s.offsets) and s.samples == 1152 * len(s.offsets)
        assert all(media.header(stored[o : o + 4]) for o in s.offsets)
        assert s.table["bytes"] == len(stored) - 10 - int.from_bytes(stored[9:10], "big")


def test_resynchronises_and_verifies():
    data = padded(bytes(range(256)) * 20)
    stored = media.store(data, len(data))
    s = media.parse(stored)
    at = s.offsets[3]
    junk = stored[:at] + b"\xff\x00junk\xff\xfb" + stored[at:]
    t = media.parse(junk)
    assert len(t.offsets) == len(s.offsets) and t.skipped == 8 and t.samples == s.samples
    flipped = bytearray(stored)
    flipped[at + 8] ^= 1  # in the side information, which the frame's checksum covers
    assert media.parse(bytes(flipped)).bad == 1
    flipped = bytearray(stored)
    flipped[at + 100] ^= 1  # in the payload
    with pytest.raises(ValueError):
        media.load(bytes(flipped))
    false = stored[:at] + stored[at : at + 4] + bytes(10) + stored[at:]  # a header without its frame, where one is due
    t = media.parse(false)
    assert t.offsets == [o if o < at else o + 14 for o in s.offsets] and t.skipped == 14
    tagged = stored + b"TAG" + b"title".ljust(30, b"\0") + b"artist".ljust(30, b"\0") + bytes(65)
    assert media.parse(tagged).tags["title"] == b"title" and media.parse(tagged).samples == s.samples
    assert media.parse(stored[: s.offsets[2] + 50]).samples == 2 * 1152  # a frame that is cut off doesn't count


def test_headers_of_other_kinds():
    # size and samples of frames by the format's formulas
    for four, want in (("fffb9064", (1, 3, 128, 44100, 417, 1152)), ("fffd9064", (1, 2, 160, 44100, 522, 1152)), ("ffff9064", (1, 1, 288, 44100, 312, 384)), ("fff39064", (2, 3, 80, 22050, 261, 576)), ("ffe39064", (2.5, 3, 80, 11025, 522, 576))):
        h = media.header(bytes.fromhex(four))
        assert (h.version, h.layer, h.bitrate, h.rate, h.size, h.samples) == want
    assert media.header(b"\xff\xfb\xf0\x00") is None and media.header(b"\xff\xe8\x90\x00") is None and media.header(b"ab") is None


def test_digest(odd_docs, no_docs):
    got = media.digest(odd_docs).collect()
    want = sorted((str(r.doc_id), len(d := (r.text or "").encode()), len(p := padded(d)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m := media.store(p, len(d))), hashlib.sha256(m).hexdigest()) for r in odd_docs.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in got) == want
    assert all(f"frames={r.payload_bytes // 576 + (r.payload_bytes % 576 > 0)} " in r.feature for r in got)
    assert media.digest(no_docs).collect() == []


def frames(four, n, body=b""):
    h = media.header(bytes.fromhex(four))
    return (bytes.fromhex(four) + body).ljust(h.size, b"\0") * n


def test_a_damaged_row_beside_good_ones(spark):
    good = media.store(padded(b"good"), 4)
    flipped = bytearray(good)
    flipped[media.parse(good).offsets[0] + 100] ^= 1
    rows = spark.createDataFrame([(0, good), (1, bytes(flipped)), (2, good[:-30]), (3, b""), (4, None), (5, frames("fffb9064", 3)), (6, b"ID3\x04\0\0\0\0\0\0")], "id int, media binary")
    got = {r.id: r for r in media.describe(rows).collect()}
    assert bytes(got[0].payload) == padded(b"good") and got[0].damage is None
    assert all(got[i].payload is None and got[i].damage for i in range(1, 7))
    assert got[1].damage == "the payload's checksum does not hold" and got[2].damage == "frames are missing or too many"
    assert (got[5].frames, got[5].samples, got[3].frames) == (3, 3 * 1152, 0)


def test_tags_of_every_version():
    sound = frames("fffb9064", 2)
    safe = lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    tag = lambda version, flags, body: b"ID3" + bytes([version, 0, flags]) + safe(len(body)) + body
    two = b"TT2\0\0\x03abc" + b"TP1\0\0\x01x"
    three = b"TIT2\0\0\0\x03\0\0abc"
    loud = b"PRIV" + safe(3) + b"\0\x02" + b"\xff\0\xe0"
    cases = (
        (tag(2, 0, two + bytes(20)), {"TT2": [b"abc"], "TP1": [b"x"]}),
        (tag(3, 0, three + three), {"TIT2": [b"abc", b"abc"]}),
        (tag(3, 0x40, b"\0\0\0\x06" + bytes(6) + three), {"TIT2": [b"abc"]}),
        (tag(3, 0x80, b"TIT2\0\0\0\x02\0\0\xff\0\xe0"), {"TIT2": [b"\xff\xe0"]}),
        (tag(4, 0x40, safe(6) + b"\x01\0" + b"TIT2" + safe(1) + b"\0\0z"), {"TIT2": [b"z"]}),
        (tag(4, 0, loud), {"PRIV": [b"\xff\xe0"]}),
        (tag(4, 0, b"TIT2" + safe(5) + b"\0\x01" + safe(1) + b"z"), {"TIT2": [b"z"]}),
        (tag(4, 0x10, b"") + b"3DI\x04\0\x10\0\0\0\0" + tag(3, 0, three), {"TIT2": [b"abc"]}),
    )
    for front, tags in cases:
        s = media.parse(front + sound)
        assert s.tags == tags and s.offsets == [len(front), len(front) + 417] and s.skipped == 0


def test_tables_of_encoders():
    side = bytes(32)
    xing = b"Xing" + (15).to_bytes(4, "big") + (3).to_bytes(4, "big") + (1251).to_bytes(4, "big") + bytes(range(100)) + (57).to_bytes(4, "big")
    lame = b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    s = media.parse(frames("fffb9064", 1, side + xing + lame) + frames("fffb9064", 3))
    assert (s.table["frames"], s.table["quality"], s.table["toc"], s.table["encoder"]) == (3, 57, list(range(100)), "LAME3.100")
    assert (s.table["delay"], s.table["padding"], s.samples) == (576, 1000, 3 * 1152 - 1576)
    vbri = b"VBRI" + b"\0\1" + b"\0\0" + b"\0\x4b" + (900).to_bytes(4, "big") + (4).to_bytes(4, "big") + (2).to_bytes(2, "big") + (3).to_bytes(2, "big") + (2).to_bytes(2, "big") + (2).to_bytes(2, "big") + b"\0\x0a\0\x0b"
    s = media.parse(frames("fffb9064", 1, side + vbri) + frames("fffb9064", 4))
    assert s.table == {"kind": "VBRI", "bytes": 900, "frames": 4, "frames_an_entry": 2, "toc": [30, 33]} and s.samples == 4 * 1152


def slow_crc(bits):
    """By long division of the message, after the initial state, by the polynomial."""
    work = [int(b) for b in bits] + [0] * 16
    for i in range(16):
        work[i] ^= 1
    for i in range(len(bits)):
        if work[i]:
            for j, b in enumerate("11000000000000101"):
                work[i + j] ^= int(b)
    return int("".join(map(str, work[-16:])), 2)


def test_checksums_of_all_layers():
    rng = random.Random(3)
    bits = "".join(rng.choice("01") for _ in range(90))
    assert media._crc16_bits(bits) == slow_crc(bits) and media.crc16(b"\x12\x34") == slow_crc(f"{0x1234:016b}")
    # Layer I, stereo: 32 allocations of 4 bits in each of two channels
    four, body = bytes.fromhex("fffe9004"), rng.randbytes(32)
    told = slow_crc(f"{0x9004:016b}" + "".join(f"{x:08b}" for x in body))
    one = (four + told.to_bytes(2, "big") + body).ljust(media.header(four).size, b"\x55")
    assert (media.parse(one * 2).bad, len(media.parse(one * 2).offsets)) == (0, 2)
    assert media.parse(one + one[:10] + b"\0" + one[11:] if one[10] else one + one[:10] + b"\1" + one[11:]).bad == 1
    # Layer II, mono, 64 kbit/s at 48 kHz: 11 allocations of 4 bits, 12 of 3 and 4 of 2, and 2 bits for each that isn't 0
    four = bytes.fromhex("fffc44c4")
    assert media.header(four).bitrate == 64
    allocation = "".join(f"{rng.randrange(1 << n):0{n}b}" for n in [4] * 11 + [3] * 12 + [2] * 4)
    chosen, i = 0, 0
    for n in [4] * 11 + [3] * 12 + [2] * 4:
        chosen += "1" in allocation[i : i + n]
        i += n
    covered = allocation + "".join(rng.choice("01") for _ in range(2 * chosen))
    rest = covered + "1" * (-len(covered) % 8)
    body = int(rest, 2).to_bytes(len(rest) // 8, "big")
    two = (four + slow_crc(f"{0x44C4:016b}" + covered).to_bytes(2, "big") + body).ljust(media.header(four).size, b"\x55")
    assert (media.parse(two * 3).bad, len(media.parse(two * 3).offsets)) == (0, 3)
    wrong = bytearray(two * 3)
    wrong[7] ^= 0x10
    assert media.parse(bytes(wrong)).bad == 1


def test_free_bitrates():
    four = bytes.fromhex("fffb0064")
    stream = (four + bytes(296)) * 3 + four[:2] + b"\x02" + four[3:] + bytes(297)
    s = media.parse(stream)
    assert s.offsets == [0, 300, 600, 900] and s.samples == 4 * 1152 and s.skipped == 0
