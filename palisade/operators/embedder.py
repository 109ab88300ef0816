"""Text embeddings by latent semantics: hashed term vectors reduced by a distributed randomised SVD.

A text is a sparse vector of hashed words and word pairs, weighed by log frequency and by rarity over the corpus. Its embedding is the
projection on the leading right singular vectors of the corpus matrix. They come from a range finder: blocks of sparse rows multiply a thin
matrix and its product goes back through them, summed by ranges of hash buckets; each pass brings ``buckets`` x ``rank`` numbers to
the driver, however many texts there are.
"""

from __future__ import annotations

import dataclasses
import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

BUCKETS, RANK, EXTRA, PASSES, SLICES, TEXTS = 1 << 14, 64, 16, 3, 16, 1024
_WORDS = re.compile(r"[^\W_]+")


def features(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, 1 + log of the counts) of a text's words and pairs of neighbours, in order of buckets."""
    words = _WORDS.findall((text or "").lower())
    counts = Counter(zlib.crc32(x.encode("utf-8", "replace")) % buckets for x in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))])
    at = np.array(sorted(counts), np.int64)
    return at, 1 + np.log(np.array([counts[i] for i in at.tolist()], np.float64))


@dataclasses.dataclass
class Embedder:
    rarity: np.ndarray
    basis: np.ndarray  # buckets x rank
    strength: np.ndarray  # singular values

    def embed(self, texts: list[str | None]) -> np.ndarray:
        """Unit vectors (texts x rank); a text without words, or with none that the corpus has, is all zeros."""
        out = np.zeros((len(texts), self.basis.shape[1]))
        for i, text in enumerate(texts):
            at, weight = features(text, len(self.rarity))
            v = weight * self.rarity[at]
            size = np.sqrt(v @ v)
            if size > 0:
                out[i] = (v / size) @ self.basis[at]
        size = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.where(size > 1e-12, out / np.where(size > 1e-12, size, 1), 0.0)


def _sum_slices(parts: DataFrame, slices: int, width: int) -> np.ndarray:
    """Sum of matrices that come as rows (slice, part: packed doubles of a range of their rows), slice by slice on the executors."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table.column("part"))
        return pa.table({"slice": table.column("slice")[:1].combine_chunks(), "part": pa.array([total.tobytes()], pa.binary())})

    got = {r["slice"]: np.frombuffer(bytes(r["part"])) for r in parts.groupBy("slice").applyInArrow(add, "slice int, part binary").collect()}
    rows = [got[i] for i in range(slices)] if len(got) == slices else []
    return np.concatenate(rows).reshape(-1, width) if rows else np.zeros((0, width))


def _cut(matrix: np.ndarray, slices: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([np.ascontiguousarray(x).tobytes() for x in np.array_split(matrix, slices)], pa.binary())], names=["slice", "part"])


def vectorised(texts: DataFrame, text: str, buckets: int = BUCKETS) -> DataFrame:
    """Blocks of texts as sparse rows: ends, at, weight (packed); a block has ``TEXTS`` texts at most."""

    def run(batches):
        for batch in batches:
            column = batch.column(0).to_pylist()
            for i in range(0, len(column), TEXTS):
                rows = [features(t, buckets) for t in column[i : i + TEXTS]]
                parts = (np.cumsum([len(a) for a, _ in rows]).astype(np.int64), np.concatenate([a for a, _ in rows]).astype(np.int32), np.concatenate([w for _, w in rows]))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["ends", "at", "weight"])

    return written(texts.select(F.col(text)).mapInArrow(run, "ends binary, at binary, weight binary"), "embedder-rows")


def _rows(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.frombuffer(row["ends"], np.int64)
    return np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), np.frombuffer(row["at"], np.int32), np.frombuffer(row["weight"])


def _weighed(row: dict, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, bucket, value, rows) of a block, each row of unit length."""
    of, at, weight = _rows(row)
    n = len(row["ends"]) // 8
    value = weight * rarity[at]
    size = np.sqrt(np.bincount(of, weights=value * value, minlength=n))
    return of, at, value / np.where(size[of] > 0, size[of], 1), n


def fit(texts: DataFrame, text: str, rank: int = RANK, buckets: int = BUCKETS, passes: int = PASSES, seed: int = 42) -> Embedder:
    """An embedder of the corpus. ``passes`` rounds of multiplication sharpen the range; equal seeds give equal results up to rounding."""
    blocks = vectorised(texts, text, buckets)

    def count(batches):
        total = np.zeros((buckets, 2))
        for batch in batches:
            for row in batch.to_pylist():
                total[:, 0] += np.bincount(_rows(row)[1], minlength=buckets)
                total[0, 1] += len(row["ends"]) // 8
        yield _cut(total, SLICES)

    counts = _sum_slices(blocks.mapInArrow(count, "slice int, part binary"), SLICES, 2)
    if not len(counts):
        counts = np.zeros((buckets, 2))
    n = counts[0, 1]
    rarity = np.where(counts[:, 0] > 0, np.log((1 + n) / (1 + counts[:, 0])) + 1, 0.0)
    width = min(rank + EXTRA, buckets)
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(buckets, width)))
    product = np.zeros((buckets, width))
    for _ in range(passes + 1):
        shared = blocks.sparkSession.sparkContext.broadcast((rarity, q))

        def multiply(batches, shared=shared):
            rarity, q = shared.value
            total = np.zeros_like(q)
            for batch in batches:
                for row in batch.to_pylist():
                    of, at, value, n = _weighed(row, rarity)
                    y = np.zeros((n, q.shape[1]))
                    np.add.at(y, of, value[:, None] * q[at])
                    np.add.at(total, at, value[:, None] * y[of])
            yield _cut(total, SLICES)

        got = _sum_slices(blocks.mapInArrow(multiply, "slice int, part binary"), SLICES, width)
        shared.unpersist()
        if not len(got):
            break
        before, product = q, got
        q, _ = np.linalg.qr(product)
    else:
        # product = A'A before: the small matrix of A on that range gives its singular vectors
        small = before.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)[:rank]
        basis = before @ turn[:, order]
        flip = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
        return Embedder(rarity, basis * np.where(flip == 0, 1, flip), np.sqrt(np.maximum(values[order], 0)))
    return Embedder(rarity, np.zeros((buckets, rank)), np.zeros(rank))


def embed(df: DataFrame, model: Embedder, text: str, name: str = "embedding") -> DataFrame:
    """Adds the embedding of the text as an array of floats."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<float>")
    def run(column: pa.Array) -> pa.Array:
        m = shared.value
        found = m.embed(column.to_pylist()).astype(np.float32)
        width = m.basis.shape[1]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * width, pa.int32()), pa.array(found.reshape(-1)))

    return df.withColumn(name, run(F.col(text)))


def as_json(model: Embedder) -> str:
    return json.dumps({"rarity": model.rarity.tolist(), "basis": model.basis.tolist(), "strength": model.strength.tolist()})


def from_json(text: str) -> Embedder:
    return Embedder(**{k: np.array(v) for k, v in json.loads(text).items()})
