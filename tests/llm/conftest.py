import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    syllables = ["re", "mo", "ta", "lin", "qua", "é", "ss", "ober", "un", "ing"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns with clashing names."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(1, 400)), rng.choice(["en", "de"]), rng.choice(["a", "b"]), 0) for i in range(60)]
    long = prose(rng, 9000)
    rows += [(60, long, "en", "a", None), (61, "", "en", "a", 0), (62, None, "en", "a", 0), (63, "  \n\t ", None, None, 0), (None, "it's we'll 'tis", "en", None, 1), (None, None, None, None, None)]
    rows += [rows[3], rows[3], (64, rows[3][1], "de", None, 5), (65, "日本 text — x <|endoftext|> ñ", "en", "ü", 1)]
    wide = spark.createDataFrame(rows, SCHEMA)
    return wide.selectExpr("*", "1 as length", "2 as size", "3 as ids", "4 as piece", "5 as __key", "6 as __n", "7 as copies", "8 as block", "9 as label", "10 as score", "11 as rank", "'x' as shard", "12 as `group`", "13 as kept", "14 as uid", "15 as count").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
