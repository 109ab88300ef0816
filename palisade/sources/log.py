"""An append-only log of records in the shared folder: tasks write files, one manifest makes them part of the log.

    sink = RecordLog(spark, path, "seq bigint, auc double", order="seq")
    sink.append(df); sink.delete(ids, "seq"); sink.tail(20)

A manifest names the files that a change adds and those that it takes away. It is put in place by one rename that fails if its number
is taken, so a change is whole or not there; files of a task that failed or was repeated are in no manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


class Written(WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


class _Writer(DataSourceArrowWriter):
    """Each task writes one file under a name of its own; only the commit, on the driver, names files that count."""

    def __init__(self, options: dict):
        self.path, self.order = options["path"], options.get("order")
        self.drops = json.loads(options.get("drops", "[]"))
        self.version = int(options["version"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = _open(self.path)
        name, n, least, most, sink = f"{uuid.uuid4().hex}.parquet", 0, None, None, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if sink is None:
                    store.create_dir(f"{base}/data", recursive=True)
                    sink = pq.ParquetWriter(f"{base}/data/{name}", batch.schema, filesystem=store)
                sink.write_batch(batch)
                n += batch.num_rows
                if self.order:
                    values = [x for x in batch.column(self.order).to_pylist() if x is not None]
                    least, most = (f([x for x in (old, *values) if x is not None], default=None) for f, old in ((min, least), (max, most)))
        finally:
            if sink is not None:
                sink.close()
        return Written([{"file": name, "rows": n, "least": least, "most": most}] if n else [])

    def commit(self, messages: list) -> None:
        store, base = _open(self.path)
        files = [f for m in messages if m for f in m.files]
        store.create_dir(f"{base}/manifests", recursive=True)
        final, draft = f"{base}/manifests/{self.version:012d}.json", f"{base}/manifests/.{uuid.uuid4().hex}"
        if store.get_file_info(final).type != fs.FileType.NotFound:
            self.abort(messages)
            raise RuntimeError(f"another change was made first: version {self.version} is taken")
        with store.open_output_stream(draft) as out:
            out.write(json.dumps({"adds": files, "drops": self.drops}).encode())
        store.move(draft, final)

    def abort(self, messages: list) -> None:
        store, base = _open(self.path)
        for m in messages:
            for f in m.files if m else []:
                store.delete_file(f"{base}/data/{f['file']}")


class RecordSink(DataSource):
    """Options: path, version (of the manifest to write), order (column whose range a manifest keeps), drops (files that the change takes away)."""

    @classmethod
    def name(cls) -> str:
        return "record_log"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


class RecordLog:
    def __init__(self, spark: SparkSession, path: str, schema: str, order: str):
        self.spark, self.path, self.schema, self.order = spark, path, schema, order
        spark.dataSource.register(RecordSink)

    def files(self) -> tuple[int, list[dict]]:
        """(number of changes, files that count), from the manifests: a few numbers for each file."""
        store, base = _open(self.path)
        found = store.get_file_info(fs.FileSelector(f"{base}/manifests", allow_not_found=True))
        live, names = {}, sorted(x.path for x in found if x.base_name.endswith(".json") and not x.base_name.startswith("."))
        for name in names:
            with store.open_input_stream(name) as stream:
                change = json.loads(stream.read())
            for f in change["drops"]:
                live.pop(f, None)
            live |= {f["file"]: f for f in change["adds"]}
        return len(names), list(live.values())

    def _read(self, files: list[dict]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f['file']}" for f in files])

    def rows(self) -> DataFrame:
        return self._read(self.files()[1])

    def append(self, rows: DataFrame, version: int | None = None, drops: list[str] | None = None) -> None:
        """All of the rows or, if any task fails for good, none. Columns go by name; those beyond the log's are left out."""
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        options = {"path": self.path, "version": str(self.files()[0] if version is None else version), "order": self.order, "drops": json.dumps(drops or [])}
        cast = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], self.schema).schema.fields]
        assert len(names) == len(cast)
        rows.select(*cast).write.format("record_log").options(**options).mode("append").save()

    def delete(self, ids: DataFrame, key: str) -> int:
        """Leaves out the records whose ``key`` is among ``ids`` (its first column); files that hold none stay as they are, the others are written
        anew in the same change. How many files were touched."""
        version, files = self.files()
        gone = ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()
        rows = self._read(files).withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
        touched = {r[0] for r in rows.join(gone, F.col(key) == F.col("_gone"), "left_semi").select("_file").distinct().collect()}  # names of files
        if touched:
            left = self._read([f for f in files if f["file"] in touched]).join(gone, F.col(key) == F.col("_gone"), "left_anti")
            self.append(left, version, sorted(touched))
        return len(touched)

    def tail(self, n: int) -> DataFrame:
        """The ``n`` newest records, newest first; files whose records are all older than those of enough newer files are not read."""
        _, files = self.files()
        ranged = sorted((f for f in files if f["most"] is not None), key=lambda f: f["least"], reverse=True)
        wanted, held, least = [], 0, None
        for f in ranged:
            if held >= n and f["most"] < least:
                continue
            wanted.append(f)
            if held < n:
                held, least = held + f["rows"], f["least"]
        return self._read(wanted).orderBy(F.desc_nulls_last(self.order)).limit(n)
