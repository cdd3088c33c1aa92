import hashlib
import io
import random

import duckdb
import pytest
import zstandard
from karst.llm import warc
from karst.llm.common import Scratch

from .conftest import prose

SCHEMA = "page_id long, url string, html string"


def plainly(rows):
    firsts = {}
    for n, (i, _, h) in enumerate(rows):
        p = (h or "").encode()
        key = (i is None, i or 0, n)
        if len(p) >= 100:
            firsts[p] = min(firsts.get(p, (key, i)), (key, i), key=lambda x: x[0])
    out = []
    for n, (i, _, h) in enumerate(rows):
        p = (h or "").encode()
        revisit = len(p) >= 100 and firsts[p][0] != (i is None, i or 0, n)
        out.append((str(i), len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", str(firsts[p][1]) if revisit else "None"))
    return sorted(out)


def told(df):
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    rows = [(i, f"http://x/{i}", "<p>" + prose(rng, rng.randrange(1, 200)) + "</p>") for i in range(100, 160)]
    rows += [(i, None, rows[5][2]) for i in range(60, 90)] + [(None, "u", rows[5][2]), (None, "v", rows[6][2])] + [rows[7]] * 3
    rows += [(1, "a b\r\nWARC-Type: x", "short"), (2, "", "short"), (3, "é　", ""), (4, "x", None), (None, None, None), (5, "x", "x" * 99), (6, "x", "x" * 99), (7, "x", "é" * 50), (8, "x", "é" * 50), (9, "x", "a\r\n\r\nb" * 40), (10, "x", prose(rng, 300_000))]
    rows += [(None, None, "n" * 200)] * 3 + [(-5, "x", rows[8][2])]
    return rows


def test_pages_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as uid", "2 as digest", "3 as payload", "4 as first_page", "5 as shared", "6 as of").repartition(3)
    assert told(warc.digest(df)) == plainly(rows)
    assert warc.digest(df.limit(0)).collect() == []


def test_round_trip_dictionary_and_references(spark, rows):
    root = Scratch(spark, "t").root
    many = [*rows, *((1000 + i, f"http://y/{i}", f"<html><head><title>{i}</title></head><body><p>{h}</p></body></html>") for i, (_, _, h) in enumerate(rows * 8))]
    manifest = warc.write_warc(spark.createDataFrame(many, SCHEMA).coalesce(1), root, dictionary_bytes=4096).collect()
    assert sum(m.records for m in manifest) == len(many)
    path = root.removeprefix("file://")
    with_dictionary = 0
    for m in manifest:
        with open(f"{path}/data/{m.file}", "rb") as f:
            dictionary, *all_frames = warc.frames(f)
        assert len(all_frames) == m.records  # a frame for each record
        with_dictionary += dictionary is not None
        if dictionary is not None:  # and it is needed
            with pytest.raises(zstandard.ZstdError):
                for _, frame in all_frames:
                    zstandard.ZstdDecompressor().decompressobj().decompress(frame)
    assert with_dictionary
    records = warc.read_warc(spark, root).cache()
    assert warc.unresolved(records).count() == 0
    assert len({r.record_id for r in records.select("record_id").collect()}) == len(many)
    got = sorted(((str(r.page_id), bytes(r.payload)) for r in records.filter("record_type = 'response'").collect()))
    assert {p for _, p in got} == {(h or "").encode() for _, _, h in many}


def archive(records, dictionary=None, compressed=False):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    raw = (zstandard.ZstdCompressor().compress(dictionary) if compressed else dictionary) if dictionary else b""
    head = warc.DICTIONARY_FRAME.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw if dictionary else b""
    return head + b"".join(zstandard.ZstdCompressor(dict_data=d, write_checksum=i % 2 == 0, write_content_size=i % 3 > 0).compress(r) for i, r in enumerate(records))


def one(payload=b"hello", **how):
    return warc.compose(7, "http://x/", payload, hashlib.sha256(payload).hexdigest(), how.get("refers"), None, "2020-01-01T00:00:00Z")


@pytest.mark.parametrize("compressed", [False, True])
def test_foreign_archives(compressed):
    rng = random.Random(1)
    records = [one(prose(rng, 300).encode()) for _ in range(200)] + [one(b""), one(rng.randbytes(1 << 20)), one(b"\0" * (1 << 20))]
    made = zstandard.train_dictionary(2048, records).as_bytes()
    for dictionary in (None, made):
        dictionary_found, *found = warc.frames(io.BytesIO(archive(records, dictionary, compressed)))
        zstd = zstandard.ZstdDecompressor(dict_data=warc._dictionary(dictionary_found))
        assert [zstd.decompressobj().decompress(f) for _, f in found] == records
        assert all(warc.parse(r)["payload_digest"] == hashlib.sha256(warc.parse(r)["payload"]).hexdigest() for r in records)


GOOD = one()


@pytest.mark.parametrize(
    "record,reason",
    [
        (GOOD[:-1], "as long as stated"), (GOOD + b"x", "as long as stated"), (GOOD.replace(b"WARC/1.1", b"WARC/9"), "version"), (GOOD.replace(b"WARC-Date", b"WARC-Data"), "warc-date is missing"),
        (GOOD.replace(b"hello", b"hullo"), "digest does not hold"), (GOOD.replace(b"WARC-Type: response", b"WARC-Type response"), "no field"), (GOOD.replace(b"WARC-Date: ", b"WARC-Type: x\r\nWARC-Date: "), "twice"),
        (b"nothing", "doesn't end"), (GOOD.replace(b"WARC-Date: 2", b"WARC-Date: \xff"), "UTF-8"), (one(refers="<urn:karst:page:1:x>").replace(b"WARC-Refers-To: <", b"X: <"), "refers to nothing"),
    ],
)
def test_damaged_records(record, reason):
    with pytest.raises(warc.Damage, match=reason):
        warc.parse(record)


def test_damaged_archives(spark):
    root = Scratch(spark, "t").root
    path = root.removeprefix("file://")
    import os

    os.makedirs(f"{path}/data")
    whole = archive([GOOD] * 3)
    files = {"cut": whole[:-3], "odd": archive([GOOD, b"nothing", GOOD]), "flipped": whole[:30] + bytes([whole[30] ^ 255]) + whole[31:], "none": b"", "junk": b"junkjunkjunk", "short": warc.DICTIONARY_FRAME.to_bytes(4, "little") + b"\xff\0\0\0x"}
    for name, data in files.items():
        with open(f"{path}/data/{name}", "wb") as f:
            f.write(data)
    names = spark.createDataFrame([(n,) for n in files], "file string")
    got = {}
    for r in warc.read_files(spark, root, names, strict=False).collect():
        got.setdefault(r.file, []).append(r.error)
    assert got["cut"] == [None, None, "the archive is cut off"] and got["odd"] == [None, "the header doesn't end", None] and "none" not in got
    assert got["junk"] == ["no frame begins here"] and got["short"] == ["the dictionary is cut off"] and any(got["flipped"])
    for name in ("cut", "odd", "junk", "short"):
        with pytest.raises(Exception, match=name):
            warc.read_files(spark, root, names.filter(f"file = '{name}'")).collect()


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted((str(a), b, c, d, str(e)) for a, b, c, d, e in con.execute(warc.SQL).fetchall())
    assert told(warc.digest(spark.read.parquet(f"{sf}/pages.parquet"))) == want
