import random

import pytest
from karst.operators import postings, search
from karst.sources.shared import new_folder

TEXTS = [
    "the MIT License of the house", "mit mit license", "license mit", "", None, "a a a a a", "A-b c_d É é", "the the of the gnu", "mit license mit license gnu", "日本 the 日本", "of", "b a b a b a b",
]
QUERIES = ['"mit license"', "the", "the -gnu", "-gnu", '"a a"', '"a b a"', "mit or of", '"the of" or -the', '"mit license" -gnu or 日本', "nothing", "", "é", '-"mit license"', "the the", '"b a b"']


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    more = [" ".join(rng.choice(["a", "b", "the", "mit", "license"]) for _ in range(rng.randrange(40))) for _ in range(200)]
    return spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, *more])], "id long, text string").selectExpr("*", "1 as key", "2 as term", "3 as words")


@pytest.fixture(scope="module")
def folder(spark, rows):
    path = new_folder(spark, "t")
    postings.build(rows, "text", "id", path)
    return path


@pytest.mark.parametrize("query", QUERIES)
def test_same_rows_as_a_scan(spark, rows, folder, query):
    want = [(r.id, r.rank_score) for r in search.keyword_search(rows, "text", "id", 500, query).collect()]
    assert [(r["key"], r.rank_score) for r in postings.search(spark, folder, query, 500).collect()] == want


def test_reads_the_asked_words_only(spark, folder):
    plan = postings.search(spark, folder, "mit -gnu", 5)._jdf.queryExecution().toString()
    assert "In(term, [gnu,mit])" in plan and "text" not in plan


def test_live_keys_and_nothing(spark, rows, folder):
    live = rows.filter("id < 3").selectExpr("id AS key")
    assert {r["key"] for r in postings.search(spark, folder, "mit", 50, live).collect()} == {0, 1, 2}
    path = new_folder(spark, "t")
    postings.build(rows.limit(0), "text", "id", path)
    assert postings.search(spark, path, "mit or -the", 5).collect() == []


def test_texts_are_read_once_and_equal_keys_are_one(spark):
    """They were cut into words three times: for their lengths, for the bounds of ranges, and for the postings."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    path = new_folder(spark, "t")
    rows = spark.createDataFrame([(1, "a b a"), (1, "b"), (2, ""), (3, None), (None, "a"), (4, "é B")], "id long, text string").mapInArrow(seen, "id long, text string")
    postings.build(rows, "text", "id", path)
    assert read.value == 6
    found, documents = postings.opened(spark, path)
    assert sorted((r.term, r.key, list(r.positions)) for r in found.collect()) == [("a", 1, [0, 2]), ("b", 1, [0]), ("b", 1, [1]), ("b", 4, [1]), ("é", 4, [0])]
    assert sorted((r.key, r.words) for r in documents.collect()) == [(1, 1), (1, 3), (2, 0), (4, 2)]
    assert [(r["key"], r.found["b"]) for r in postings.asked(found, ["b"]).orderBy("key").collect()] == [(1, [0, 1]), (4, [1])]
