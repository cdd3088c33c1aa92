from datetime import UTC, datetime

import pytest
from karst.operators import issueql
from karst.operators.compilers import Refused
from pyspark.sql import functions as F

ROWS = [(0, "Open", "crash on start", ["a", "B"], "2024-01-05 00:00:00", "ann"), (1, "closed", "slow start", [], "2024-01-03 12:00:00", None), (2, None, None, None, None, "bob"), (3, "open", "Crash, again", ["b"], "2023-12-01 00:00:00", "")]
NOW = datetime(2024, 1, 6, 12, tzinfo=UTC)


@pytest.fixture(scope="module")
def issues(spark):
    return spark.createDataFrame(ROWS, "id int, status string, summary string, labels array<string>, u string, who string").withColumn("u", F.col("u").cast("timestamp")).cache()


def fields():
    return {"status": issueql.Field(F.col("status")), "Summary": issueql.Field(F.col("summary"), "text"), "labels": issueql.Field(F.col("labels"), "list"), "updated": issueql.Field(F.col("u"), "time"), "assignee": issueql.Field(F.col("who")), "id": issueql.Field(F.col("id"))}


@pytest.mark.parametrize(
    "query,want",
    [
        ("status = OPEN", [0, 3]), ("status != open", [1]), ("not status = open", [1]), ("status in (open, 'closed') order by updated", [3, 1, 0]), ("status not in (open)", [1]), ("status is empty", [2]), ("status IS NOT NULL", [0, 1, 3]),
        ("summary ~ crash", [0, 3]), ('summary ~ "start crash"', [0]), ('summary ~ "\\"on start\\""', [0]), ("summary !~ crash", [1]), ("labels = b", [0, 3]), ("labels != a", [3]), ("labels is EMPTY", [1, 2]), ("labels in (a, c)", [0]),
        ("updated >= -3d", [0, 1]), ("updated > '2024-01-03 12:00'", [0]), ("updated < startOfDay()", [0, 1, 3]), ("updated <= now() AND updated >= 2024/01/01", [0, 1]), ("assignee = currentUser()", [0]), ("assignee = EMPTY", [1, 3]),
        ("(status = open or status = closed) and not (labels = a)", [3]), ("status = open OR status = closed AND labels = zzz", [0, 3]), ("", [0, 1, 2, 3]), ("order by id desc", [3, 2, 1, 0]), ("id >= 2", [2, 3]), ("id = 2", [2]), ("order by updated DESC, id", [0, 1, 3, 2]),
    ],
)
def test_queries(issues, query, want):
    assert [r.id for r in issueql.searched_by(issues, query, fields(), "id", 10, now=NOW, user="ANN").collect()] == want


@pytest.mark.parametrize("bad", ["who = x", "status", "status =", "status = open and", "(status = open", "status = open)", "status was open", "status in open", "updated > soon", "updated > evil()", "labels > a", "summary = open order by", "status = 'x", "status = a b", "cf[1] = 2", "updated ~ x", "status is x"])
def test_refused(issues, bad):
    with pytest.raises(Refused):
        issueql.searched_by(issues, bad, fields(), "id", 10, now=NOW)


def test_what_was_not_given(issues):
    for query in ("updated > -1d", "assignee = currentUser()"):
        with pytest.raises(Refused):
            issueql.searched_by(issues, query, fields(), "id", 10)
    assert [r.id for r in issueql.searched_by(issues, "order by id", fields(), "id", 2, 1).collect()] == [1, 2]
