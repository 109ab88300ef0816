"""Token counts of whole texts under a sentence-piece model, by a two-tier map-side lookup.

A BPE model whose pieces hold neither white space after another character nor a
newline never merges across those places, so the count of a text is the sum over its
pre-tokens (a run of spaces with the word after it, or one newline). Frequent
pre-tokens have their count in a table of fixed size that every worker gets; the rest
is encoded in the worker and kept in a cache of bounded size. No pre-token is shuffled:
the table comes from summaries of bounded size, one per input partition.
"""

from __future__ import annotations

import heapq
import pickle
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import LONGEST, text_or_empty

#: Entries of the broadcast table, and of what one partition or merge passes on: none is longer than ``LONGEST``
#: characters, so the table has at most 17 MB of text.
FREQUENT = 65_536
#: Entries that a worker's cache or a partition's running count may hold.
BOUND = 400_000
_PRE = re.compile(r"\n| *[^ \n]+| +")


def pre_tokens(text: str) -> list[str]:
    """Pieces of the marked text, each with its leading spaces; joined they give it back."""
    return _PRE.findall(" " + text.replace("▁", " ")) if text else []


class Encoder:
    """A sentence-piece model as a counter of pre-tokens."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(re.search("[^▁]▁|\n", x) for x in pieces) or len(self.model.encode("a  b")) != len(self.model.encode("a b")) + 1:
            raise ValueError("this model merges across words; its texts cannot be counted by pre-tokens")

    def counts(self, parts: list[str]) -> list[int]:
        # "\n" before a part keeps the model's own leading mark apart from it: two tokens more
        return [len(x) - 2 for x in self.model.encode(["\n" + x for x in parts], num_threads=1)]


def _trimmed(counts: Counter, size: int) -> Counter:
    return Counter(dict(heapq.nlargest(size, counts.items(), key=lambda x: (x[1], x[0])))) if len(counts) > size else counts


def frequent_pre_tokens(df: DataFrame, text: str = "text", size: int = FREQUENT, fan_in: int = 16) -> list[str]:
    """About the ``size`` most frequent pre-tokens of all texts, by a tree of bounded summaries.

    A partition counts all its pre-tokens of up to ``LONGEST`` characters, dropping the rarest half of its entries
    whenever ``BOUND`` is passed, and hands on ``size`` of them; ``fan_in`` summaries merge into one per
    level, the last of at most ``fan_in`` on the driver. Which entries are kept decides speed alone.
    """

    def summary(batches):
        counts: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                counts.update(p for p in pre_tokens(x.as_py()) if len(p) <= LONGEST)
                if len(counts) > BOUND:
                    counts = _trimmed(counts, BOUND // 2)
        yield pa.RecordBatch.from_pydict({"summary": [pickle.dumps(dict(_trimmed(counts, size)))]})

    def merge(parts):
        counts: Counter = Counter()
        for x in parts:
            counts.update(pickle.loads(x))
            counts = _trimmed(counts, BOUND)
        return pickle.dumps(dict(_trimmed(counts, size)))

    summaries = df.select(text_or_empty(text).alias("text")).mapInArrow(summary, "summary binary").rdd.map(lambda r: bytes(r[0]))
    while summaries.getNumPartitions() > fan_in:
        summaries = summaries.repartition(-(-summaries.getNumPartitions() // fan_in)).mapPartitions(lambda it: [merge(it)])
    top = merge(summaries.mapPartitions(lambda it: [merge(it)]).collect())
    return sorted(pickle.loads(top))


def count_tokens(df: DataFrame, model_path: str, limit: int = 4096, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row.

    Null texts count as empty: 0 bytes, 0 tokens. Rows may repeat; other columns are not read.
    """
    spark: SparkSession = df.sparkSession
    keys = frequent_pre_tokens(df, text, frequent)
    table = spark.sparkContext.broadcast(dict(zip(keys, Encoder(model_path).counts(keys), strict=True)))

    def count(batches):
        encoder, known, cache = Encoder(model_path), table.value, {}
        for batch in batches:
            sizes, totals = [], []
            for x in batch.column("text"):
                text = x.as_py()
                sizes.append(len(text.encode()))
                parts = pre_tokens(text)
                found = list(map(known.get, parts))
                if None in found:
                    missing = [p for p, n in zip(parts, found, strict=True) if n is None]
                    if len(cache) > BOUND:
                        cache.clear()
                    new = [p for p in dict.fromkeys(missing) if p not in cache]
                    cache.update(zip(new, encoder.counts(new), strict=True))
                    totals.append(sum(filter(None, found)) + sum(map(cache.get, missing)))
                    for p in new:  # long ones hardly come again
                        if len(p) > LONGEST:
                            del cache[p]
                else:
                    totals.append(sum(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", text_or_empty(text).alias("text")).mapInArrow(
        count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
