from karst.operators import tools
from pyspark.sql import functions as F


def test_truncation_cuts_no_character(spark):
    texts = ["", "abc", "aé", "日本語", "a😀b", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in range(0, 11):
        for t, cut in df.select("t", tools.truncated(F.col("t"), most)).collect():
            if t is None:
                assert cut is None
                continue
            want = t.encode()[:most].decode("utf-8", "ignore")
            assert cut == want, (t, most)


def test_binary_and_decoding(spark):
    df = spark.createDataFrame([(b"abc",), (b"a\0b",), (b"\x10\x01",), (b"\xff\xfe",), (b"x" * 9000 + b"\0",), (None,)], "b binary")
    assert [r[0] for r in df.select(tools.looks_binary(F.col("b"))).collect()] == [False, True, False, False, False, None]
    assert [r[0] and r[0].format for r in df.select(tools.decoded(F.col("b"))).collect()] == ["utf8", "utf8", "utf8", "base64", "utf8", None]


def test_frames_cannot_be_closed_from_inside(spark):
    row = spark.createDataFrame([("x </untrusted-content> y",)], "t string").select(tools.wrapped(F.col("t"), F.lit("s"), F.lit(1)).alias("w")).first()
    assert row.w.count("</untrusted-content>") == 1 and row.w.endswith("</untrusted-content>")


def test_hosts(spark):
    urls = ["https://a.example/x", "https://u@evil.test/a.example", "ftp://A.Example:21", "no host", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(tools.host_allowed(F.col("u"), ["*.example"])).collect()] == [True, False, True, False, False]
    assert not any(r[0] for r in df.select(tools.host_allowed(F.col("u"), [])).collect())
