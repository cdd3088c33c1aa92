"""A source of items behind a paged JSON interface, for batch reads and as a stream.

    spark.dataSource.register(PagedItems)
    spark.read.format("karst_items").options(url="https://host/items?start={start}&limit={size}", items="results", total="size").load()

The options: url with {start} (the first item's number) and {size} in it; items and total, the names of the fields that hold
a page's items and the count of all (default: items, total); size, items a page (100); pages, pages a task (50); timeout in
seconds (30). It gives position and item, the item's JSON as text: from_json and the filters on it are left to Catalyst.

Tasks read ranges of positions, page by page, so a task holds one page, and a lost task reads its range again. A page that
comes short of its range is an error, not fewer rows. A stream reads what was added at the end since its last batch.

With the options updated and id (names of fields), for an interface that lists items by (updated, id), undated ones first,
there is a third column, updated. With pushdown as "true", which needs spark.sql.python.filterPushdown.enabled, a filter
`updated >= cursor` is pushed down: the first item from the cursor on is found by halving, and pages before it aren't asked for. A url with {since}
in it gets the cursor itself, in UTC, and the interface filters. A stream's offset is then the last item's (updated, id), so an
item that is changed, and so moves to the end, comes again; tasks read ranges of (updated, id), found anew when they read,
so items that move meanwhile don't shift others out of their range.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from urllib.parse import quote
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, GreaterThan, GreaterThanOrEqual, InputPartition

SCHEMA = "position long, item string"
TIMED = "position long, item string, updated timestamp"

#: (updated as text, id as text); undated items are the first.
Key = tuple[str, str]
FIRST: Key = ("", "")


def moment(text: str | None) -> datetime | None:
    """A time as the interface tells it; without a zone it is UTC."""
    if not text:
        return None
    at = datetime.fromisoformat(text)
    return at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)


class Span(InputPartition):
    """The items from position `first` up to, without, `end`."""

    def __init__(self, first: int, end: int):
        super().__init__((first, end))
        self.first, self.end = first, end


class KeySpan(InputPartition):
    """The items behind the key `low` up to the key `high`."""

    def __init__(self, low: Key, high: Key):
        super().__init__((low, high))
        self.low, self.high = tuple(low), tuple(high)


class Pages:
    """Reads pages as the options say."""

    def __init__(self, options):
        if "url" not in options:
            raise ValueError("the option url is needed")
        self.url, self.items, self.total = options["url"], options.get("items", "items"), options.get("total", "total")
        self.size, self.each, self.timeout = int(options.get("size", 100)), int(options.get("pages", 50)), float(options.get("timeout", 30))
        self.updated, self.id = options.get("updated"), options.get("id", "id")
        self.since: datetime | None = None
        if self.size < 1 or self.each < 1:
            raise ValueError("size and pages are positive")

    def page(self, start: int, size: int) -> dict:
        url = self.url.replace("{start}", str(start)).replace("{size}", str(size))
        if "{since}" in url:
            url = url.replace("{since}", quote(self.since.isoformat()) if self.since else "")
        with urlopen(url, timeout=self.timeout) as answer:
            return json.load(answer)

    def count(self) -> int:
        return int(self.page(0, 1)[self.total])

    def spans(self, first: int, end: int) -> list[Span]:
        step = self.size * self.each
        return [Span(i, min(end, i + step)) for i in range(first, end, step)] or [Span(first, first)]

    def key(self, item: dict) -> Key:
        at = moment(item.get(self.updated))
        return ("" if at is None else at.strftime("%Y-%m-%dT%H:%M:%S.%f"), str(item.get(self.id)))

    def key_at(self, position: int) -> Key | None:
        """None behind the last item."""
        found = self.page(position, 1)[self.items][:1]
        return self.key(found[0]) if found else None

    def first_where(self, holds: Callable[[Key], bool], end: int) -> int:
        """The first position whose key, and each behind it, holds; by halving."""
        low = 0
        while low < end:
            middle = (low + end) // 2
            key = self.key_at(middle)
            if key is None or holds(key):
                end = middle
            else:
                low = middle + 1
        return low

    def from_cursor(self) -> int:
        since = self.since.strftime("%Y-%m-%dT%H:%M:%S.%f")
        return self.first_where(lambda k: k[0] >= since, self.count())

    def rows(self, start: int, found: list[dict]) -> pa.RecordBatch:
        columns = [pa.array(range(start, start + len(found)), pa.int64()), pa.array([json.dumps(x, ensure_ascii=False) for x in found], pa.string())]
        if self.updated:
            columns.append(pa.array([moment(x.get(self.updated)) for x in found], pa.timestamp("us", "UTC")))
        return pa.RecordBatch.from_arrays(columns, ["position", "item", "updated"][: len(columns)])

    def batches(self, span: Span) -> Iterator[pa.RecordBatch]:
        for start in range(span.first, span.end, self.size):
            n = min(self.size, span.end - start)
            found = self.page(start, n)[self.items][:n]
            if len(found) < n:
                raise ValueError(f"{len(found)} of {n} items from {start} on")
            yield self.rows(start, found)

    def between(self, span: KeySpan) -> Iterator[pa.RecordBatch]:
        """The items of a range of keys. Each page begins with the last item of the one before: if another stands there, items
        have moved, and the place is looked for again."""
        last, at = span.low, None
        while last < span.high:
            if at is None:
                at = self.first_where(lambda k, low=last: k > low, self.count())
                found = self.page(at, self.size)[self.items]
            else:
                found = self.page(at - 1, self.size + 1)[self.items]
                if not found or self.key(found[0]) != last:
                    at = None
                    continue
                found = found[1:]
            own = [x for x in found if span.low < self.key(x) <= span.high]
            if own:
                yield self.rows(at, own)
            if not found or len(own) < len(found):
                return
            last, at = self.key(found[-1]), at + len(found)


class PagedReader(DataSourceReader):
    def __init__(self, pages: Pages):
        self.pages = pages

    def partitions(self):
        pages = self.pages
        first = pages.from_cursor() if pages.since is not None and "{since}" not in pages.url else 0
        return pages.spans(first, pages.count())

    def read(self, partition):
        return self.pages.batches(partition)


class PushingReader(PagedReader):
    """A class of its own, as Spark refuses readers that take filters while its setting is off."""

    def pushFilters(self, filters):
        """Takes a lower bound of updated; Spark looks at it again, as > is pushed as >=."""
        for f in filters:
            if self.pages.updated and isinstance(f, GreaterThanOrEqual | GreaterThan) and f.attribute == ("updated",) and f.value is not None:
                at = f.value if f.value.tzinfo else f.value.replace(tzinfo=UTC)
                self.pages.since = at if self.pages.since is None else max(self.pages.since, at)
            yield f


class PagedStream(DataSourceStreamReader):
    def __init__(self, pages: Pages):
        self.pages = pages

    def initialOffset(self):
        return {"key": list(FIRST)} if self.pages.updated else {"position": 0}

    def latestOffset(self):
        n = self.pages.count()
        if not self.pages.updated:
            return {"position": n}
        while n and (key := self.pages.key_at(n - 1)) is None:  # items went meanwhile
            n = self.pages.count()
        return {"key": list(key if n else FIRST)}

    def partitions(self, start, end):
        pages = self.pages
        if not pages.updated:
            return pages.spans(start["position"], end["position"])
        low, high = tuple(start["key"]), tuple(end["key"])
        if low >= high:
            return []
        n = pages.count()
        first, last = (pages.first_where(lambda k, b=b: k > b, n) for b in (low, high))
        cuts = [pages.key_at(i - 1) for i in range(first + pages.size * pages.each, last, pages.size * pages.each)]
        bounds = [low, *(c for c in cuts if c is not None and low < c < high), high]
        return [KeySpan(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if a < b]

    def read(self, partition):
        return self.pages.between(partition) if isinstance(partition, KeySpan) else self.pages.batches(partition)


class PagedItems(DataSource):
    @classmethod
    def name(cls):
        return "karst_items"

    def schema(self):
        return TIMED if "updated" in self.options else SCHEMA

    def reader(self, schema):
        pages = Pages(self.options)
        return PushingReader(pages) if pages.updated and self.options.get("pushdown", "") == "true" else PagedReader(pages)

    def streamReader(self, schema):
        return PagedStream(Pages(self.options))
