"""Quality classifier: kernel ridge scores by random Fourier features, calibrated to probabilities.

Statistics of each text (lengths, shares of kinds of characters, repetition) are
standardised and sent through random cosines, whose inner products approximate a
Gaussian kernel. Each partition of labelled rows sums its part of the normal equations;
the sums merge in a tree, so the driver sees one matrix of fixed size. Scores of rows
that a fold's model did not see fix an isotonic map from score to probability.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import merged, text_or_empty, written

STATISTICS = (
    "log_words", "log_chars", "word_length", "word_length_spread", "symbols", "bars", "digits", "capitals", "stops", "other_ascii",
    "distinct_words", "top_word", "repeated_windows", "echoes", "log_lines", "line_length", "repeated_lines", "no_case",
)
_SYMBOLS, _DIGITS, _CAPITALS, _STOPS = b"#*$%&<>", b"0123456789", bytes(range(65, 91)), b".,;:!?"
_PLAIN = bytes(range(97, 123)) + _SYMBOLS + _DIGITS + _CAPITALS + _STOPS + b"| \t\n\x0b\x0c\r"


def statistics(raw: bytes) -> list[float]:
    """Numbers that describe a text (UTF-8 bytes); zeros for an empty one."""
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    lengths = np.fromiter(map(len, words), np.float64, n)
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    counts = Counter(words)
    # windows of a long text repeat by chance and its vocabulary wears out: rates are over blocks of words
    blocks = range(0, n, 1000)
    distinct = sum(len(set(words[i : i + 1000])) for i in blocks) / n
    windows = max(1, n - 4)
    again = 1 - len(set(zip(words, words[1:], words[2:], words[3:], words[4:]))) / windows if n > 4 else 0.0
    echoes = sum(map(bytes.__eq__, words, words[1:])) / n
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    ascii_rest = len(raw.translate(None, _PLAIN + bytes(range(128, 256)))) / size
    return [
        math.log1p(n), math.log1p(size), float(lengths.mean()), float(lengths.std()), share(_SYMBOLS), share(b"|"), share(_DIGITS),
        share(_CAPITALS), share(_STOPS), ascii_rest, distinct, counts.most_common(1)[0][1] / n, again, echoes,
        math.log1p(len(lines)), math.log1p(size / len(lines)), 1 - len(set(lines)) / len(lines), share(bytes(range(128, 256))),
    ]


def fold_of(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % 3


@dataclass
class Model:
    """Standardisation, random features, ridge weights and the calibration steps."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: dict[int, np.ndarray]
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        waves = np.cos(z @ self.waves + self.phases) * math.sqrt(2 / len(self.phases))
        return np.hstack([np.ones((len(x), 1)), waves])

    def raw(self, x: np.ndarray, which: int = -1) -> np.ndarray:
        return self.features(x) @ self.weights[which]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0)


def isotonic(good: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Non-decreasing means of good / n that fit best; pools neighbours that violate the order."""
    blocks: list[list[float]] = []
    for g, k in zip(good, n, strict=True):
        blocks.append([g, k, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, k2, c2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + k2, blocks[-1][2] + c2]
    return np.concatenate([np.full(int(c), g / k) for g, k, c in blocks])


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the array ``stats`` of every row; null texts count as empty."""

    def run(batches):
        for batch in batches:
            rows = [statistics(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", text_or_empty(text).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, stats array<double>")


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(-1, len(STATISTICS))


def fit(stats: DataFrame, labels: DataFrame, features: int = 256, ridge: float = 1.0, width: float = 0.25, bins: int = 400, seed: int = 42) -> Model:
    """Model from the rows of ``stats`` with a quality label and a fold other than 1.

    ``labels`` may hold ids without text, null labels and repeated ids (each counts). With no labels
    every score is 0.5, with one class it is that class.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("y"))
    rows = written(stats.join(known, "doc_id").where(fold_of() != 1).select(fold_of().cast("int").alias("fold"), "stats", "y"), "classifier-rows")

    def moments(batches):
        total = None
        for batch in batches:
            x = _matrix(batch.column("stats"))
            got = (np.array([float(len(x))]), x.sum(axis=0), (x * x).sum(axis=0))
            total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": [pickle.dumps(total)]})

    got = merged(rows.mapInArrow(moments, "part binary"))
    rng = np.random.default_rng(seed)
    waves = rng.normal(size=(len(STATISTICS), features)) * width
    phases = rng.uniform(0, 2 * math.pi, features)
    zero = np.zeros(features + 1)
    if got is None:
        return Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), waves, phases, {-1: zero}, (np.zeros(1), np.full(1, 0.5)))
    n, sums, squares = got
    mean = sums / n
    scale = np.sqrt(np.maximum(squares / n - mean**2, 1e-8))
    model = Model(mean, scale, waves, phases, {-1: zero}, (np.zeros(1), np.full(1, 0.5)))

    def equations(batches):
        total = None
        for batch in batches:
            fold, y = batch.column("fold").to_numpy(), batch.column("y").to_numpy(zero_copy_only=False)
            z = model.features(_matrix(batch.column("stats")))
            got = sum(((z[fold == k].T @ z[fold == k], z[fold == k].T @ y[fold == k]) for k in (0, 2)), ())
            total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": [pickle.dumps(total)]})

    a0, b0, a2, b2 = merged(rows.mapInArrow(equations, "part binary"))
    penalty = ridge * np.diag([1e-6] + [1.0] * features)
    solve = lambda a, b: np.linalg.solve(a + penalty, b)
    # 0 and 2: trained on the other fold, for scores of rows unseen
    model.weights = {-1: solve(a0 + a2, b0 + b2), 0: solve(a2, b2), 2: solve(a0, b0)}
    low, high = -0.5, 1.5

    def histogram(batches):
        total = None
        for batch in batches:
            fold, y, x = batch.column("fold").to_numpy(), batch.column("y").to_numpy(zero_copy_only=False), _matrix(batch.column("stats"))
            s = np.where(fold == 0, model.raw(x, 0), model.raw(x, 2))
            at = np.clip(((s - low) / (high - low) * bins).astype(int), 0, bins - 1)
            got = (np.bincount(at, weights=y, minlength=bins), np.bincount(at, minlength=bins).astype(float))
            total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": [pickle.dumps(total)]})

    good, count = merged(rows.mapInArrow(histogram, "part binary"))
    used = count > 0
    centres = low + (np.arange(bins) + 0.5) * (high - low) / bins
    model.knots = (centres[used], isotonic(good[used], count[used]))
    return model


def score_documents(df: DataFrame, labels: DataFrame, text: str = "text", **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Empty and null texts get the score of their (zero) statistics. Repeated rows are scored each.
    """
    stats = written(text_statistics(df, text), "classifier-stats")
    model = df.sparkSession.sparkContext.broadcast(fit(stats, labels, **how))

    def run(batches):
        for batch in batches:
            score = model.value.score(_matrix(batch.column("stats"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kind = df.schema["doc_id"].dataType.simpleString()
    return stats.select("doc_id", (fold_of() == 1).alias("held_out"), "stats").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def keep_good(df: DataFrame, labels: DataFrame, text: str = "text", sample_rows: int = 16_384, **how) -> DataFrame:
    """The rows of ``df`` whose score is 0.5 or more, columns as they were.

    The model is fitted on ``sample_rows`` labelled ids at most, those of the least hashes, so
    the ids that are sent to find their texts have a fixed bound and no text is shuffled; then
    each text is scored where it lies.
    """
    own = df.columns
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(fold_of() != 1).select("doc_id").distinct()
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    labelled = df.select("doc_id", F.col(text).alias("text")).join(F.broadcast(sample), "doc_id", "left_semi")
    model = df.sparkSession.sparkContext.broadcast(fit(written(text_statistics(labelled), "classifier-stats"), labels, **how))
    place = len(own)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t.as_py()) for t in batch.column(place)], np.float64)
                batch = batch.filter(pa.array(model.value.score(x) >= 0.5))
            yield pa.RecordBatch.from_arrays(batch.columns[:place], schema=pa.schema([batch.schema.field(i) for i in range(place)]))

    raw = text_or_empty(text).cast("binary").alias("palisade_raw_text")
    return df.select("*", raw).mapInArrow(run, df.schema)
