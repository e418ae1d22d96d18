"""A paginated HTTP interface as a Spark data source: keyset pages, batch or streaming.

``spark.read.format("pages")`` or ``spark.readStream.format("pages")`` with the
options ``url`` (``{after}`` and ``{count}`` are filled in), ``after`` (0),
``count`` (500), ``tries`` (5) and ``pause`` (0.5 s between pages, ten times
that after a failure). A page is a JSON list of objects with an ``id``; an empty
page ends the listing. The stream's offset is the last id, so its checkpoint is
the resume point.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

SCHEMA = "id STRING, packet_id STRING, text STRING, created_at STRING, record STRING"


class _Pages:
    def __init__(self, options: dict) -> None:
        self.url, self.after = options["url"], int(options.get("after", 0))
        self.count, self.tries, self.pause = int(options.get("count", 500)), int(options.get("tries", 5)), float(options.get("pause", 0.5))

    def page(self, after: int) -> list[dict]:
        """The records after ``after`` in ascending order; fails after so many tries in a row."""
        for attempt in range(self.tries):
            try:
                with urllib.request.urlopen(self.url.format(after=after, count=self.count), timeout=30) as answer:
                    return sorted(json.loads(answer.read()), key=lambda r: int(r["id"]))
            except (OSError, ValueError):
                if attempt + 1 == self.tries:
                    raise
                time.sleep(10 * self.pause)
        return []

    @staticmethod
    def row(record: dict) -> tuple:
        text = lambda key: None if record.get(key) is None else str(record[key])
        return (*(text(k) for k in ("id", "packet_id", "text", "created_at")), json.dumps(record, ensure_ascii=False))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.pages = _Pages(options)

    def read(self, partition) -> Iterator[tuple]:
        after = self.pages.after
        while records := self.pages.page(after):
            yield from map(self.pages.row, records)
            after = int(records[-1]["id"])
            time.sleep(self.pages.pause)


class _StreamReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.pages = _Pages(options)

    def initialOffset(self) -> dict:
        return {"after": self.pages.after}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        records = self.pages.page(int(start["after"]))
        return iter([self.pages.row(r) for r in records]), {"after": int(records[-1]["id"]) if records else int(start["after"])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        after = int(start["after"])
        while after < int(end["after"]) and (records := self.pages.page(after)):
            yield from (self.pages.row(r) for r in records if int(r["id"]) <= int(end["after"]))
            after = int(records[-1]["id"])


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _StreamReader(self.options)
