"""A paged search API as a Python data source: one partition per page, retries in the task."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = 100
TRIES = 10


def page_ranges(total: int, limit: int) -> list[tuple[int, int]]:
    """(page, rows wanted) for a total and a limit (-1: no limit); none if either leaves nothing."""
    wanted = total if limit < 0 else min(total, limit)
    return [(k + 1, min(PAGE, wanted - k * PAGE)) for k in range(-(-wanted // PAGE))] if wanted > 0 else []


def fetch(url: str, opener: Callable = urlopen, wait: float = 5.0) -> dict:
    """A page's JSON; after ``TRIES`` failures in a row the task fails, and Spark runs it again elsewhere."""
    for attempt in range(TRIES):
        try:
            with opener(url) as answer:
                return json.loads(answer.read())
        except OSError:
            if attempt + 1 == TRIES:
                raise
            time.sleep(wait)
    return {}


class SearchSource(DataSource):
    """Options: ``url`` (with the query), ``limit`` (default -1), ``total`` (default: what the first page says), ``stop``.

    ``stop`` names a file in a shared folder; once it is there, pages that haven't been fetched yet are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "page int, position int, id string, source string"

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(self.options)


class SearchReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        total = self.options.get("total")
        if total is None:
            total = fetch(self.options["url"]).get("hits", {}).get("total", {}).get("value", 0)
        return [InputPartition(p) for p in page_ranges(int(total), int(self.options.get("limit", -1)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page, rows = partition.value
        if "stop" in self.options and os.path.exists(self.options["stop"]):
            return
        url = self.options["url"] + (f"&from={(page - 1) * PAGE}" if page > 1 else "")
        hits = fetch(url).get("hits", {}).get("hits", [])[:rows]
        for k, hit in enumerate(hits):
            yield page, k, hit.get("_id"), json.dumps(hit.get("_source"), ensure_ascii=False)
