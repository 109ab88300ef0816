"""JSON records of a paged HTTP service as a data source.

    spark.dataSource.register(JsonPages)
    spark.read.format("json_pages").schema("id bigint, name string").options(url="https://host/records?page={page}", pages=40, records="data").load()
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.error import HTTPError, URLError
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


def get_json(url: str, tries: int = 3, least: float = 2.0, most: float = 10.0, timeout: float = 30.0):
    """The parsed answer; a failure is tried again after a wait that doubles from ``least`` to ``most`` seconds, the last one raised."""
    for k in range(tries):
        try:
            with urlopen(url, timeout=timeout) as answer:
                return json.load(answer)
        except (HTTPError, URLError, TimeoutError):
            if k == tries - 1:
                raise
            time.sleep(min(most, least * 2**k))


class JsonPages(DataSource):
    """Options: url (with ``{page}``), pages, first (0), records (path of the list in an answer, dots between names), wait (seconds before the second try).

    One partition for each page, so pages are fetched side by side and a lost task fetches its page alone. Fields that a record lacks
    are null; values are kept as they are or, for a string column, as JSON.
    """

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        first = int(self.options.get("first", 0))
        return [Page(first + i) for i in range(int(self.options.get("pages", 1)))]

    def read(self, partition: Page) -> Iterator[tuple]:
        found = get_json(self.options["url"].replace("{page}", str(partition.number)), least=float(self.options.get("wait", 2.0)))
        for part in filter(None, self.options.get("records", "").split(".")):
            found = found.get(part) or []
        for record in found:
            values = (record.get(f.name) for f in self.schema.fields)
            yield tuple(json.dumps(v) if isinstance(v, (dict, list)) else v for v in values)
