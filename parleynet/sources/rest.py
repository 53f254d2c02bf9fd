"""A paged REST source of articles: filters in the request, any fetch function, in batch by month or as a stream by page."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)

SCHEMA = "month string, page int, section string, type string, published date, result string"
#: Columns that a request can hold to one value, and the parameters that do it.
PARAMETERS = {"section": "section", "type": "kind"}


class Month(InputPartition):
    def __init__(self, month: str, start: str, end: str, page: int = 0, last: int = 0):
        super().__init__(month)
        self.start, self.end, self.page, self.last = start, end, page, last


def _row(month: str, page: int, result: dict) -> tuple:
    try:
        published = date.fromisoformat((result.get("webPublicationDate") or "")[:10])
    except ValueError:
        published = None
    return month, page, result.get("sectionId") or "", result.get("type") or "", published, json.dumps(result)


class Pushed:
    """What a query's filters ask of a source: days, one value of a column, months; each is part of the request and holds for every row that is read."""

    def __init__(self):
        self.low: date | None = None
        self.high: date | None = None
        self.equal: dict[str, str] = {}
        self.month: str | None = None
        self.dated = False

    def take(self, f: Filter) -> bool:
        """Whether the source answers the filter itself."""
        column = getattr(f, "attribute", ("",))[-1]
        if isinstance(f, IsNotNull):
            self.dated = self.dated or column == "published"
            return column in ("month", "page", "section", "type", "published", "result")
        if isinstance(f, EqualTo) and column in PARAMETERS and self.equal.get(column, f.value) == f.value and f.value:
            self.equal[column] = f.value
            return True
        if isinstance(f, EqualTo) and column == "month" and self.month in (None, f.value):
            self.month = f.value
            return True
        if column != "published" or not isinstance(getattr(f, "value", None), date):
            return False
        day = timedelta(days=1)
        if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
            low = f.value + day if isinstance(f, GreaterThan) else f.value
            self.low = max(self.low or low, low)
        if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
            high = f.value - day if isinstance(f, LessThan) else f.value
            self.high = min(self.high or high, high)
        return isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan, LessThanOrEqual, LessThan))

    def window(self, month: tuple[str, str, str]) -> tuple[str, str, str] | None:
        """The month's days that are asked for; None if there are none."""
        name, start, end = month
        start = max(start, self.low.isoformat()) if self.low else start
        end = min(end, self.high.isoformat()) if self.high else end
        return (name, start, end) if start <= end and self.month in (None, name) else None

    def holds(self, row: tuple) -> bool:
        """A source that takes no notice of a parameter gives no wrong rows."""
        published = row[4]
        if (self.low or self.high or self.dated) and published is None:
            return False
        if (self.low and published < self.low) or (self.high and published > self.high):
            return False
        return all(row[2 if c == "section" else 3] == v for c, v in self.equal.items())


def rest_source(name: str, fetch: Callable[[dict], dict], months: list[tuple[str, str, str]], parameters: Callable[..., dict], pages_of: Callable[[dict], int] | None = None, batch_pages: int = 10, task_pages: int = 1) -> type[DataSource]:
    """A data source class whose rows are the results of all pages of all months.

    fetch(parameters) returns {"pages": n, "results": [...]}; it carries retries, keys and
    pacing. In batch, months are read independently, so a lost executor repeats its months
    alone, and filters on published, section, type and month become request parameters
    (with spark.sql.python.filterPushdown.enabled; see `read_rest`). As a stream, a batch
    takes `batch_pages` pages, `task_pages` that follow one another in a task, and the offset is the month and
    page to go on from, so a run that was stopped reads no page again but those of the batch
    that it was in. pages_of(parameters) tells a month's number of pages for that; it is
    asked once a month and run.
    """
    count = pages_of or (lambda p: int(fetch(p).get("pages", 0)))

    class Reader(DataSourceReader):
        def __init__(self):
            self.pushed = Pushed()

        def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
            return [f for f in filters if not self.pushed.take(f)]

        def partitions(self) -> list[Month]:
            return [Month(*w) for m in months if (w := self.pushed.window(m))]

        def read(self, partition: Month) -> Iterator[tuple]:
            fixed = {PARAMETERS[c]: v for c, v in self.pushed.equal.items()}
            page, pages = 1, 1
            while page <= pages:
                answer = fetch(parameters(partition.start, partition.end, page=page, **fixed))
                pages = int(answer.get("pages", 0))
                for result in answer.get("results", []):
                    row = _row(partition.value, page, result)
                    if self.pushed.holds(row):
                        yield row
                page += 1

    class PageStream(DataSourceStreamReader):
        def __init__(self):
            self.at: dict | None = None
            self.counts: dict[int, int] = {}

        def _pages(self, window: int) -> int:
            if window not in self.counts:
                self.counts[window] = count(parameters(*months[window][1:], page=1))
            return self.counts[window]

        def initialOffset(self) -> dict:
            return {"window": 0, "page": 1}

        def latestOffset(self) -> dict:
            at = dict(self.at or self.initialOffset())
            left = batch_pages
            while left and at["window"] < len(months):
                here = max(0, self._pages(at["window"]) - at["page"] + 1)
                taken = min(left, here)
                at["page"] += taken
                left -= taken
                if taken == here:
                    at = {"window": at["window"] + 1, "page": 1}
            self.at = at
            return at

        def partitions(self, start: dict, end: dict) -> list[Month]:
            # A run that goes on is told its last batch here before it is asked for a new one.
            if self.at is None:
                self.at = dict(end)
            out = []
            for w in range(start["window"], min(end["window"], len(months) - 1) + 1):
                first = start["page"] if w == start["window"] else 1
                last = end["page"] - 1 if w == end["window"] else self._pages(w)
                out += [Month(*months[w], page=p, last=min(p + task_pages - 1, last)) for p in range(first, last + 1, task_pages)]
            return out

        def read(self, partition: Month) -> Iterator[tuple]:
            for page in range(partition.page, partition.last + 1):
                answer = fetch(parameters(partition.start, partition.end, page=page))
                for result in answer.get("results", []):
                    yield _row(partition.value, page, result)

    class Rest(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> Reader:
            return Reader()

        def streamReader(self, schema) -> PageStream:
            return PageStream()

    return Rest


def read_rest(spark: SparkSession, source: type[DataSource], where: str | None = None) -> DataFrame:
    """The source's rows that `where` keeps; what a request can say of it goes into the requests.

    Read anew for each condition: Spark keeps what was pushed into a loaded source, so
    another query over the same loaded rows, without a filter, would be read with it.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    rows = spark.read.format(source.name()).load()
    return rows if where is None else rows.where(where)


def collect_pages(spark: SparkSession, source: type[DataSource], path: str, checkpoint: str) -> None:
    """Appends all pages not yet read to the store, batch by batch, and stops."""
    spark.dataSource.register(source)
    stream = spark.readStream.format(source.name()).load()
    query = stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


class Rejected(Exception):
    """A key that won't be taken again."""


def with_retries(fetch: Callable[[dict, str], dict], keys: list[str], tries: int = 4, pause: float = 0.0, floor: int = 0, wait: Callable[[float], None] = time.sleep) -> Callable[[dict], dict]:
    """A fetch that stays with a key while it is good for calls and goes on to the next when it isn't.

    A rejected key is left at once; other failures are tried again with it, `tries` times in
    all, after a pause that grows by itself with each. An answer whose `remaining` is below
    `floor` is the key's last.
    """

    def run(parameters: dict) -> dict:
        last: Exception | None = None
        while run.at < len(keys):
            for attempt in range(tries):
                try:
                    answer = fetch(parameters, keys[run.at])
                except Rejected as e:
                    last = e
                    break
                except Exception as e:
                    last = e
                    wait(pause * (attempt + 1))
                    continue
                if answer.get("remaining") is not None and answer["remaining"] < floor:
                    run.at += 1
                return answer
            run.at += 1
        raise RuntimeError(f"no key could fetch {parameters}") from last

    run.at = 0
    return run
