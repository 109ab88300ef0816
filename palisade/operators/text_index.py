"""A positional inverted index: postings of each term, kept in segments, updated by new segments and lists of removed documents.

Queries read the postings of their terms, which lie together in the files (rows are ranged by term and document, so a scan skips all others),
and no text. A frequent term's postings are dealt over many files, so no task holds them all.
"""

from __future__ import annotations

import dataclasses
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch, written
from .retrieval import tokens

#: Postings of a file, about; segments after which ``compact`` is due.
FILE_ROWS, MANY_SEGMENTS = 2_000_000, 8
#: Documents that a task takes apart at once.
TAKEN = 256
_POSTING = "term string, doc_id {id}, tf int, length int, positions array<int>"


def _take_apart(batches):
    """Postings of documents (doc_id, words) in order of term within a few documents, and a row without term for each, with its length."""
    names = ["term", "doc_id", "tf", "length", "positions"]
    for batch in batches:
        for start in range(0, batch.num_rows, TAKEN):
            part = batch.slice(start, TAKEN)
            ids, lists = part.column(0), part.column(1)
            sizes = pc.list_value_length(lists)
            none = pa.nulls(part.num_rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.nulls(part.num_rows, pa.string()), ids, pa.nulls(part.num_rows, pa.int32()), sizes, none], names=names)
            words = lists.flatten().dictionary_encode()
            if not len(words):
                continue
            n = sizes.fill_null(0).to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            place = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            key = words.indices.to_numpy().astype(np.int64) * len(n) + doc
            order = np.argsort(key, kind="stable")  # of equal keys the places stay in order
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            offsets = pa.array(np.r_[first, len(key)].astype(np.int32))
            of = pa.array(key[first] % len(n))
            columns = [
                words.dictionary.take(pa.array(key[first] // len(n))), ids.take(of), pa.array(np.diff(np.r_[first, len(key)]).astype(np.int32)), sizes.take(of),
                pa.ListArray.from_arrays(offsets, pa.array(place[order])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)


@dataclasses.dataclass(frozen=True)
class TextIndex:
    """Segments (path of postings, path of their documents' lengths), and (segments that were there, path of ids removed from them)."""

    spark: SparkSession
    id_type: str
    segments: tuple[tuple[str, str], ...] = ()
    removed: tuple[tuple[int, str], ...] = ()

    def _left(self, rows: DataFrame, k: int) -> DataFrame:
        """Rows of segment k whose documents were not removed or replaced later."""
        later = [path for at, path in self.removed if at > k]
        if not later:
            return rows
        gone = self.spark.read.schema(f"doc_id {self.id_type}").parquet(*later).distinct().withColumnRenamed("doc_id", "_gone")
        return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> TextIndex:
        """Indexes documents; those whose ids the index has are replaced. A null text has no terms and no length; ids that repeat within ``docs`` are one
        document whose texts follow each other in order of their hash."""
        new = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        repeated = written(new.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_again")), "index-repeated")
        rows = new.select("doc_id", tokens(F.col("text")).alias("t"))
        if not repeated.isEmpty():  # else no text is shuffled
            again = F.col("doc_id").eqNullSafe(F.col("_again"))
            parts = F.expr("array_sort(filter(collect_list(struct(h, t)), x -> x.t is not null))")
            joined = new.join(repeated, again, "left_semi").select("doc_id", F.xxhash64("text").alias("h"), tokens(F.col("text")).alias("t")).groupBy("doc_id").agg(parts.alias("p"))
            rows = rows.join(repeated, again, "left_anti").unionByName(joined.select("doc_id", F.expr("if(size(p) > 0, flatten(transform(p, x -> x.t)), null)").alias("t")))
        # a document's postings are made where it lies, with a row without term for its length
        made = written(rows.mapInArrow(_take_apart, _POSTING.format(id=self.id_type)), "index-postings")
        postings = made.where("term IS NOT NULL")
        path, of_docs = scratch(self.spark, "index-segment"), scratch(self.spark, "index-documents")
        files = max(1, -(-postings.count() // FILE_ROWS))
        postings.repartitionByRange(files, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(path)
        made.where("term IS NULL").select("doc_id", "length").write.parquet(of_docs)
        lengths = self.spark.read.schema(f"doc_id {self.id_type}, length int").parquet(of_docs)
        known = self.remove(lengths) if self.segments else self
        return dataclasses.replace(known, segments=(*self.segments, (path, of_docs)))

    def remove(self, ids: DataFrame) -> TextIndex:
        """Leaves out the documents with these ids (the first column); unknown ids change nothing."""
        path = scratch(self.spark, "index-removed")
        ids.select(F.col(ids.columns[0]).cast(self.id_type).alias("doc_id")).write.parquet(path)
        return dataclasses.replace(self, removed=(*self.removed, (len(self.segments), path)))

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """term, doc_id, tf, length, positions of all documents that the index holds, for these terms or all."""
        schema, parts = _POSTING.format(id=self.id_type), []
        for k, (path, _) in enumerate(self.segments):
            rows = self.spark.read.schema(schema).parquet(path)
            parts.append(self._left(rows.where(F.col("term").isin(terms)) if terms is not None else rows, k))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def documents(self) -> DataFrame:
        """doc_id, length of every document, those without terms too."""
        schema, parts = f"doc_id {self.id_type}, length int", []
        for k, (_, path) in enumerate(self.segments):
            parts.append(self._left(self.spark.read.schema(schema).parquet(path), k))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def rank(self, terms: list[str], k: int) -> DataFrame:
        """doc_id, score: the k documents that hold all terms, by term frequency over log length."""
        wanted = list(dict.fromkeys(terms))
        found = self.postings(wanted).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"), F.first("length").alias("length"))
        score = F.round(F.col("tf") / (1 + F.log(F.col("length").cast("double"))), 6)
        return found.where(F.col("n") == len(wanted)).select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)

    def bm25(self, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """doc_id, score: the k documents of highest BM25 for the terms; document frequencies are those of the postings."""
        found = self.postings(list(dict.fromkeys(terms)))
        stats = self.documents().agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"))
        df = found.groupBy("term").agg(F.count("*").alias("df"))  # a row a term
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        tf = F.col("tf")
        part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
        scored = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"))
        return scored.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)

    def phrase(self, terms: list[str], slop: int = 0) -> DataFrame:
        """doc_id, n, first: the documents that hold the terms one after the other (each at most ``slop`` places later than next to the one
        before), how often a start occurs, and the first start. Only positions are compared."""
        rows = None
        for i, term in enumerate(terms):
            part = self.postings([term]).select("doc_id", F.col("positions").alias(f"p{i}"))
            rows = part if rows is None else rows.join(part.withColumnRenamed("doc_id", "_other"), F.col("doc_id").eqNullSafe(F.col("_other"))).drop("_other")
        # starts and where they have got to: each step keeps the ways that go on
        ways = F.transform("p0", lambda x: F.struct(x.alias("start"), x.alias("at")))
        out = rows.withColumn("_ways", ways)
        for i in range(1, len(terms)):
            step = f"flatten(transform(_ways, w -> transform(filter(sequence(w.at + 1, w.at + 1 + {slop}), x -> array_contains(p{i}, x)), x -> named_struct('start', w.start, 'at', x))))"
            out = out.withColumn("_ways", F.expr(f"array_distinct({step})"))
        starts = F.array_distinct(F.transform("_ways", lambda w: w["start"]))
        return out.select("doc_id", F.size(starts).alias("n"), F.array_min(starts).alias("first")).where("n > 0")

    def compact(self) -> TextIndex:
        """One segment in place of all; due after ``MANY_SEGMENTS``."""
        path, of_docs = scratch(self.spark, "index-segment"), scratch(self.spark, "index-documents")
        postings = written(self.postings(), "index-postings")
        files = max(1, -(-postings.count() // FILE_ROWS))
        postings.repartitionByRange(files, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(path)
        self.documents().write.parquet(of_docs)
        return dataclasses.replace(self, segments=((path, of_docs),), removed=())


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> TextIndex:
    return TextIndex(docs.sparkSession, docs.schema[doc_id].dataType.simpleString()).add(docs, doc_id, text)
