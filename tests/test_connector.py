"""The source of paged items, against a small server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from karst.sources.connector import PagedItems
from pyspark.sql import functions as F


@pytest.fixture
def items():
    """A list that a server shows in pages, and its address."""
    held, asked = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append(q["limit"])
            body = json.dumps({"results": held[q["start"] : q["start"] + q["limit"]], "size": len(held)}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield held, asked, f"http://127.0.0.1:{server.server_port}/x?start={{start}}&limit={{size}}"
    server.shutdown()


def test_batch(spark, items):
    held, asked, url = items
    spark.dataSource.register(PagedItems)
    load = lambda: spark.read.format("karst_items").options(url=url, items="results", total="size", size=5, pages=2).load()
    assert load().collect() == []
    held += [{"id": i, "title": f"é {i}"} for i in range(23)]
    df = load()
    assert df.rdd.getNumPartitions() == 3
    got = df.select("position", F.from_json("item", "id long, title string").alias("x")).select("position", "x.*").collect()
    assert sorted(map(tuple, got)) == [(i, i, f"é {i}") for i in range(23)]
    assert max(asked) == 5
    with pytest.raises(Exception, match="url is needed"):
        spark.read.format("karst_items").load().collect()


def test_stream_reads_what_is_new(spark, items, tmp_path):
    held, _, url = items
    spark.dataSource.register(PagedItems)

    def run():
        stream = spark.readStream.format("karst_items").options(url=url, items="results", total="size", size=4, pages=1).load()
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination(60)
        return sorted(r.position for r in spark.read.parquet(f"{tmp_path}/out").collect())

    held += [{"id": i} for i in range(6)]
    assert run() == list(range(6))
    held += [{"id": i} for i in range(6, 11)]
    assert run() == list(range(11))


@pytest.fixture
def timed():
    """Items listed by (updated, id); their list, the starts and cursors asked for, and the address."""
    held, asked = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append((int(q["start"]), int(q["limit"]), q.get("since")))
            shown = sorted(held, key=lambda x: (x["updated"] or "", str(x["id"])))
            if q.get("since"):
                shown = [x for x in shown if x["updated"] and x["updated"] >= q["since"][:19] + "Z"]
            body = json.dumps({"items": shown[int(q["start"]) :][: int(q["limit"])], "total": len(shown)}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield held, asked, f"http://127.0.0.1:{server.server_port}/x?start={{start}}&limit={{size}}"
    server.shutdown()


def at(hour):
    return f"2024-01-{1 + hour // 24:02d}T{hour % 24:02d}:00:00Z"


def test_a_cursor_is_pushed_down(spark, timed):
    held, asked, url = timed
    spark.dataSource.register(PagedItems)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = lambda u=url: spark.read.format("karst_items").options(url=u, updated="updated", pushdown="true", size=10, pages=2).load()
        assert load().filter("updated >= timestamp '2024-01-02'").collect() == []
        held += [{"id": i, "updated": at(i)} for i in range(400)] + [{"id": 900, "updated": None}]
        everything = load().collect()
        assert len(everything) == 401 and sum(r.updated is None for r in everything) == 1
        whole = len(asked)
        asked.clear()
        got = load().filter("updated >= timestamp '2024-01-16 00:00:00'").collect()
        assert sorted(json.loads(r.item)["id"] for r in got) == list(range(360, 400))
        pages = [a for a in asked if a[1] > 1]
        assert len(pages) == 4 and min(p[0] for p in pages) == 361 and len(asked) < 20 < whole  # the rest are looks for the first item
        assert load().filter("updated > timestamp '2024-01-16 00:00:00'").count() == 39  # one item stands at the cursor itself
        asked.clear()
        assert load(url + "&since={since}").filter("updated >= timestamp '2024-01-16 00:00:00'").count() == 40
        assert all(a[2].startswith("2024-01-16T00:00:00") for a in asked) and len(asked) < 10
        assert load().filter("updated >= timestamp '2034-01-16'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_stream_brings_changed_items_again(spark, timed, tmp_path):
    held, asked, url = timed
    spark.dataSource.register(PagedItems)

    def run():
        stream = spark.readStream.format("karst_items").options(url=url, updated="updated", size=3, pages=1).load()
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination(60)
        return sorted((json.loads(r.item)["id"], json.loads(r.item)["updated"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    held += [{"id": i, "updated": at(i // 2)} for i in range(10)]
    assert run() == [(i, at(i // 2)) for i in range(10)]
    held[2]["updated"] = at(30)  # changed: it stands at the end now
    held.append({"id": 10, "updated": at(30)})
    asked.clear()
    assert run() == sorted([*((i, at(i // 2)) for i in range(10)), (2, at(30)), (10, at(30))])
    assert sum(a[1] > 1 for a in asked) <= 2
    assert len(run()) == 12


def test_items_that_move_while_a_range_is_read():
    from karst.sources.connector import KeySpan, Pages

    held = [{"id": f"{i:02d}", "updated": at(i)} for i in range(20)]
    pages = Pages({"url": "-", "updated": "updated", "size": 4})
    asked = []

    def page(start, size):
        asked.append(start)
        if len(asked) > 8 and held[3]["updated"] == at(3):  # meanwhile one that was read is changed
            held[3]["updated"] = at(50)
        shown = sorted(held, key=lambda x: (x["updated"], x["id"]))
        return {"items": shown[start : start + size], "total": len(shown)}

    pages.page = page
    span = KeySpan(("", ""), pages.key(held[15]))
    got = [json.loads(x)["id"] for b in pages.between(span) for x in b.column("item").to_pylist()]
    assert got == [f"{i:02d}" for i in range(16)] or got == [f"{i:02d}" for i in range(16) if i != 3]
    assert held[3]["updated"] == at(50)
