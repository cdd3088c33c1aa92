import pytest
from karst.operators import compilers, pipes, search
from pyspark.sql import functions as F

ROWS = [(0, "error", "disk is full on node a", 5.0), (1, "info", "node b is up", 50.0), (2, None, "Disk, full!", None), (3, "warn", "", 7.0)]


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(ROWS, "id int, level string, message string, value double").cache()


def ids(df):
    return sorted(r.id for r in df.collect())


def test_query_strings(logs):
    columns = {c: F.col(c) for c in ("level", "message", "value")}
    cases = {
        "disk": [0, 2], '"disk is full"': [0], "level:error OR level:warn": [0, 3], "full AND node": [0], "full -node": [2], "NOT full": [1, 3], "nod*": [0, 1], "n?de": [0, 1],
        "value:>5": [1, 3], "value:[5 TO 7]": [0, 3], "value:{5 TO 7]": [3], "value:[* TO 7}": [0], "(level:info OR full) AND node": [0, 1], "+node disk": [0, 1], "disk up": [0, 1, 2], "nothing": [],
        "-level:view level:error (+node)": [0, 1], "-level:warn level:error (+disk)": [0, 2], "+level:error (disk up)": [0], "level:info (+disk +full)": [0, 1, 2],
    }
    for text, want in cases.items():
        assert ids(logs.filter(compilers.query_string(text, columns, ["message"]))) == want, text
    for bad in ("*disk", "who:x", "(disk", "disk)", "AND", "/x/", "disk~2", "disk^3", "", "[1 TO 2]"):
        with pytest.raises(compilers.Refused):
            compilers.query_string(bad, columns, ["message"])


def test_search_bodies(logs):
    columns = {c: F.col(c) for c in ("level", "message", "value")}
    run = lambda body, **o: [r.id for r in compilers.search_body(logs, body, columns, "id", **o).collect()]
    assert run({"query": {"match": {"message": "disk up"}}, "sort": [{"value": {"order": "desc"}}]}) == [1, 0, 2]
    assert run({"query": {"match": {"message": {"query": "node full", "operator": "and"}}}}) == [0]
    assert run({"query": {"match_phrase": {"message": "disk full"}}}) == [2]
    assert run({"query": {"bool": {"should": [{"exists": {"field": "level"}}], "must_not": [{"prefix": {"level": "e"}}]}}}) == [1, 3]
    assert run({"query": {"ids": {"values": [1, 2]}}, "from": 1}) == [2]
    assert run({"query": {"wildcard": {"level": "?nfo"}}}) == [1] and run({}, limit=2) == [0, 1]
    for bad in ({"aggs": {}}, {"query": {"bool": {"must": [{"script": {}}]}}}, {"query": {"terms": {"level": {"index": "x"}}}}, {"size": 1, "from": 5000}, {"query": {"fuzzy": {"level": "x"}}}, {"query": {"term": {"none": 1}}}, {"size": 30}, {"size": "9"}, {"query": {"range": {"value": {"gte": {"script": 1}}}}},
                {"query": {"term": {"level": {"value": "x", "boost": 2}}}}, {"query": {"bool": {"must": [], "script": {}}}}, {"sort": [{"_script": {}}]}, {"sort": [{"value": {"script": 1}}]}, {"_source": [{"script": 1}]},
                {"query": {"match": {"message": {"query": {"script": 1}}}}}, {"query": {"ids": {"values": [{"x": 1}]}}}, {"query": [1]}, {"query": {"match_all": {"script": 1}}}, {"query": {"terms": {"level": [["x"]]}}}):
        with pytest.raises(compilers.Refused):
            run(bad)


def test_pipes(logs):
    got = pipes.log_query(logs, "fields id, level as l, message | filter l like /err|warn/ | sort id desc | limit 1").collect()
    assert [(r.id, r.l) for r in got] == [(3, "warn")]
    got = pipes.log_query(logs, 'filter message != "a | b" | stats count(*) as n, sum(value) by level | sort n desc, level asc').collect()
    assert [(r.level, r.n) for r in got] == [(None, 1), ("error", 1), ("info", 1), ("warn", 1)] and "sum_value" in got[0].asDict()
    got = pipes.log_query(logs, 'parse @message "* on node *" as what, node | filter node = "a" | dedup level | display what').collect()
    assert [r.what for r in got] == ["disk is full"]
    got = pipes.log_query(logs, "fields id, strlen(message) as n, value * 2 + 1 as v, upper(level) as u | filter v in [11, 15] and not (u = 'INFO') | sort n desc").collect()
    assert [(r.id, r.n, r.v, r.u) for r in got] == [(0, 22, 11.0, "ERROR"), (3, 0, 15.0, "WARN")]
    assert ids(pipes.log_query(logs, "filter message like 'node' and level not like /^e/")) == [1]
    assert ids(pipes.log_query(logs, "filter value / 0 > 1 or -value = -5 or value ^ 2 = 49 or value % 50 = 0")) == [0, 1, 3]


def test_pipes_take_strings_and_patterns_as_they_are(spark):
    texts = ["bin(5m) @x", "it's", "a|b", 'say "x"', "count(*) as n", "x/y", "pct(v, 9)"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, message string")
    for i, query in enumerate(["= 'bin(5m) @x'", "like /it's/", "= 'a|b'", '= "say \\"x\\""', '= "count(*) as n"', r"like /x\/y/", r"=~ /^pct\(/"]):
        assert ids(pipes.log_query(rows, f"filter message {query}")) == [i], query


@pytest.mark.parametrize(
    "bad",
    [
        "delete x", "fields id | drop y", "", "fields id | ", 'fields java_method("java.lang.System", "getProperty", "user.home") as x', "fields (select count(1) from parquet.`/tmp`) as n", "fields reflect('a', 'b') as x", "fields nothing",
        "filter message = 'open", "fields id as", "stats count(*) by", "limit 5000", "limit x", "fields abs(id, id)", "fields id id", "filter message like /(/", "filter level in ['a'", "parse message 'a' as b", "parse message '* *' as b", "fields id; drop", "fields raise_error('x')", "stats pct(value, 101)", "fields bin(5m)",
    ],
)
def test_pipes_refuse(logs, bad):
    with pytest.raises(compilers.Refused):
        pipes.log_query(logs, bad)


def test_web_searches(logs):
    assert search.websearch('a "b c" -d or -"e f" G-1') == [[(True, ("a",)), (True, ("b", "c")), (False, ("d",))], [(False, ("e", "f")), (True, ("g", "1"))]]
    run = lambda q: [r.id for r in search.keyword_search(logs, "message", "id", 10, q).collect()]
    assert run("disk full") == [0, 2] and run('"disk full"') == [2] and run("full -node") == [2] and run("up or full") == [0, 1, 2] and run("") == [] and run("- or") == []
    none = search.keyword_top(logs, "message", "id", 10, [], none_of=["disk"])
    assert [(r.id, r.rank_score) for r in none.collect()] == [(1, 0.0), (3, 0.0)]
