"""Records that a paged HTTP service appends, as a stream.

    spark.dataSource.register(PolledRecords)
    spark.readStream.format("polled_records").schema("seq bigint, name string").options(count_url=..., url="https://host/records?from={from}&to={to}").load()

An offset is the number of records that the service has; a micro-batch is a range of them, which Spark keeps in the checkpoint before it
reads it. So a batch that failed is read again over the same range, whatever came since: no record is lost or taken twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .rest import get_json


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PolledRecords(DataSource):
    """Options: count_url (answers a number, or an object with ``count``), url (with ``{from}`` and ``{to}``, the latter excluded; answers a list), page (records
    of one request, 1000), most (records of one micro-batch, 100000), wait (seconds before the second try)."""

    @classmethod
    def name(cls) -> str:
        return "polled_records"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(schema, dict(self.options))


class _Reader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.page, self.most, self.wait = int(options.get("page", 1000)), int(options.get("most", 100_000)), float(options.get("wait", 2.0))
        self.at = 0

    def initialOffset(self) -> dict:
        return {"seen": 0}

    def latestOffset(self) -> dict:
        found = get_json(self.options["count_url"], least=self.wait)
        count = int(found["count"] if isinstance(found, dict) else found)
        self.at = max(self.at, min(count, self.at + self.most))
        return {"seen": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["seen"])  # after a restart: goes on from the checkpoint
        return [Range(i, min(i + self.page, end["seen"])) for i in range(start["seen"], end["seen"], self.page)]

    def read(self, partition: Range) -> Iterator[tuple]:
        url = self.options["url"].replace("{from}", str(partition.first)).replace("{to}", str(partition.last))
        found = get_json(url, least=self.wait)
        if len(found) != partition.last - partition.first:
            raise ValueError(f"{len(found)} records of {partition.last - partition.first} asked")
        for record in found:
            values = (record.get(f.name) for f in self.schema.fields)
            yield tuple(json.dumps(v) if isinstance(v, (dict, list)) else v for v in values)

    def commit(self, end: dict) -> None:
        pass
