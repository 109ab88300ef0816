"""Nearest vectors by cosine: exact by matrix products, and an inverted-file index over coarse centroids.

Scores are products of packed matrices inside tasks; a task keeps the k best of each query, so no pairs are shuffled or sorted.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch, written

#: Queries of one broadcast block, vectors multiplied at once, rows of a list and queries of a list that one task holds.
BLOCK, TILE, PART_ROWS, PART_QUERIES = 4096, 1024, 32_768, 4096
#: Scores of a matrix product that the exact search holds at once.
TILE_SCORES = 1 << 20
#: Vectors that centroids are fitted on at most for each list, and lists at most: 4,096 lists of 1,024 numbers take 32 MB.
SAMPLE_PER_LIST, MOST_LISTS = 64, 4096


def matrix_of(column) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(c)
    flat = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n and len(flat) % n:
        raise ValueError("vectors of unequal length")
    return flat.reshape(n, len(flat) // n if n else 0)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows divided by their length; a vector of zeros stays and is like nothing (score 0)."""
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(size > 0, size, 1.0)


class Best:
    """The k best of many queries, by score (six digits) and then id."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.least = np.full(len(query_ids), -np.inf)
        self.q, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` (queries x vectors), from which at most the k best of each query and their equals are taken on (and its own, which is none)."""
        scores = np.round(scores, 6)
        scores += 0.0
        wanted = scores >= self.least[:, None]
        if scores.shape[1] > self.k + 1 and np.count_nonzero(wanted) > 4 * (self.k + 1) * len(scores):
            last = np.partition(np.where(wanted, scores, -np.inf), -(self.k + 1), axis=1)[:, -(self.k + 1)]
            wanted &= scores >= last[:, None]
        rows, columns = np.nonzero(wanted)
        other = self.query_ids[rows] != ids[columns]
        rows, columns = rows[other], columns[other]
        self.q, self.ids, self.scores = np.r_[self.q, rows], np.r_[self.ids, ids[columns]], np.r_[self.scores, scores[rows, columns]]
        self.trim()

    def trim(self) -> None:
        order = np.lexsort((self.ids, -self.scores, self.q))
        q = self.q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = order[place < self.k]
        self.q, self.ids, self.scores = self.q[keep], self.ids[keep], self.scores[keep]
        last = place[place < self.k] == self.k - 1
        self.least[self.q[last]] = self.scores[last]


_FOUND = "query_id bigint, id bigint, score double"


def _top(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("place", F.expr("row_number() over (partition by query_id order by score desc, id)"))
    return ranked.where(F.col("place") <= k)


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, id, score, place: the k vectors most like each query, other than itself.

    Queries are packed in blocks of ``BLOCK``, one broadcast at a time, whose size the block bounds; each makes one pass over the vectors, and a
    task passes on k rows a query. Null vectors neither ask nor answer; equal scores go by id.
    """
    spark = vectors.sparkSession
    q = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v"))
    n = q.count()
    blocks = max(1, -(-n // BLOCK))
    q = written(q.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks))), "vector-queries")
    v = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v"))
    kind = np.float32 if q.schema["v"].dataType.simpleString() == "array<float>" else np.float64  # sent as they are, as a worker keeps what it was sent
    out = None
    for i in range(blocks):
        part = q.where(F.col("b") == i).select("id", "v").toArrow()
        shared = spark.sparkContext.broadcast((part.column("id").to_numpy(), matrix_of(part.column("v")).astype(kind)))
        found = v.mapInArrow(lambda batches, s=shared: _scan(batches, s, k), _FOUND)
        out = found if out is None else out.unionByName(found)
    return _top(out, k)


def _scan(batches, shared, k):
    ids, q = shared.value
    q = unit(q.astype(np.float64))
    best = Best(ids, k)
    tile = max(1, min(TILE, TILE_SCORES // max(1, len(ids))))
    for batch in batches:
        for i in range(0, batch.num_rows, tile):
            part = batch.slice(i, tile)
            if len(ids):
                best.add(q @ unit(matrix_of(part.column("v"))).T, part.column("id").to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(ids[best.q], pa.int64()), pa.array(best.ids, pa.int64()), pa.array(best.scores)], names=["query_id", "id", "score"])


@dataclasses.dataclass
class InvertedFile:
    """Vectors in lists by their nearest centroid: a table list, part, id, v for each batch that was added, and removed ids."""

    centroids: np.ndarray
    paths: list[str]
    #: (batches that were there, path of the ids removed from them)
    removed: list[tuple[int, str]]
    spark: SparkSession

    def rows(self) -> DataFrame:
        """Every vector of the index: the newest of an id, unless it was removed after that."""
        schema = "list int, part int, id bigint, v array<float>"
        out = None
        for k, path in enumerate(self.paths):
            rows = self.spark.read.schema(schema).parquet(path)
            later = [p for at, p in self.removed if at > k]
            if later:
                rows = rows.join(self.spark.read.schema("id bigint").parquet(*later).distinct(), "id", "left_anti").select("list", "part", "id", "v")
            out = rows if out is None else out.unionByName(rows)
        return out

    def add(self, vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> InvertedFile:
        """Adds vectors; those of ids that the index has replace them. Null vectors are left out."""
        v = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))
        shared = self.spark.sparkContext.broadcast(self.centroids)
        kind = v.schema["v"].dataType.simpleString()

        def place(batches):
            for batch in batches:
                m = unit(matrix_of(batch.column("v")))
                at = np.concatenate([(m[i : i + TILE] @ shared.value.T).argmax(axis=1) for i in range(0, len(m), TILE)]) if len(m) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column("id"), batch.column("v")], names=["list", "id", "v"])

        placed = written(v.mapInArrow(place, f"list int, id bigint, v {kind}"), "vector-lists")
        sizes = placed.groupBy("list").agg(F.count("*").alias("n"))  # at most a row a list
        parts = F.greatest(F.lit(1), F.ceil(F.col("n") / PART_ROWS))
        dealt = placed.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), "id", "v")
        path = scratch(self.spark, "vector-index")
        dealt.repartition("list", "part").sortWithinPartitions("list", "part").write.parquet(path)
        known = self.remove(placed.select("id")) if self.paths else self
        return dataclasses.replace(known, paths=[*self.paths, path])

    def remove(self, ids: DataFrame) -> InvertedFile:
        """Leaves out the vectors with these ids."""
        path = scratch(self.spark, "vector-removed")
        ids.select(F.col(ids.columns[0]).cast("bigint").alias("id")).write.parquet(path)
        return dataclasses.replace(self, removed=[*self.removed, (len(self.paths), path)])

    def search(self, queries: DataFrame, k: int, probes: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """query_id, id, score, place among the vectors of the ``probes`` lists whose centroids are nearest to each query.

        Queries meet the lists they probe by a shuffle. A list is dealt in parts of about ``PART_ROWS`` vectors and ``PART_QUERIES`` queries, every part
        of the one with every part of the other, so a hot list is held by no task as a whole.
        """
        asked, found = self._meeting(queries, probes, id_col, vector)

        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            ids = left.column("id").to_numpy()
            best = Best(ids, k)
            if left.num_rows and right.num_rows:
                q, m, of = unit(matrix_of(left.column("v"))), unit(matrix_of(right.column("v"))), right.column("id").to_numpy()
                for i in range(0, len(m), TILE):
                    best.add(q @ m[i : i + TILE].T, of[i : i + TILE])
            return pa.table({"query_id": pa.array(ids[best.q], pa.int64()), "id": pa.array(best.ids, pa.int64()), "score": pa.array(best.scores)})

        on = ["list", "part", "qpart"]
        return _top(asked.groupBy(*on).cogroup(found.groupBy(*on)).applyInArrow(run, _FOUND), k)

    def _meeting(self, queries, probes, id_col, vector):
        shared = self.spark.sparkContext.broadcast(self.centroids)
        probes = min(probes, len(self.centroids))

        def nearest(batches):
            for batch in batches:
                m = unit(matrix_of(batch.column("v")))
                lists = []
                for i in range(0, len(m), TILE):
                    s = -(m[i : i + TILE] @ shared.value.T)
                    lists.append(np.argpartition(s, probes - 1, axis=1)[:, :probes])
                at = np.concatenate(lists).reshape(-1) if lists else np.zeros(0, np.int64)
                rows = pa.array(np.repeat(np.arange(len(m)), probes))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column("id").take(rows), batch.column("v").take(rows)], names=["list", "id", "v"])

        q = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))
        asked = q.mapInArrow(nearest, "list int, id bigint, v array<float>")
        rows = self.rows()
        v_parts = rows.groupBy("list").agg((F.max("part") + 1).alias("v_parts"))
        q_parts = asked.groupBy("list").agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("q_parts"))
        parts = F.broadcast(v_parts.join(q_parts, "list"))  # at most a row a list
        asked = asked.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("v_parts") - 1)).alias("part"), F.pmod(F.xxhash64("id"), F.col("q_parts")).cast("int").alias("qpart"), "id", "v")
        found = rows.join(parts, "list").select("list", "part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)).alias("qpart"), "id", "v")
        return asked, found

    def probed_share(self, queries: DataFrame, probes: int, id_col: str = "vec_id", vector: str = "embedding") -> float:
        """Vectors that a query is compared with, as a share of all, in the mean over the queries."""
        shared = self.spark.sparkContext.broadcast((self.centroids, min(probes, len(self.centroids))))

        @F.arrow_udf("array<int>")
        def lists(v: pa.Array) -> pa.Array:
            c, n = shared.value
            at = np.argpartition(-(unit(matrix_of(v)) @ c.T), n - 1, axis=1)[:, :n]
            return pa.array(at.tolist(), pa.list_(pa.int32()))

        q = queries.where(F.col(vector).isNotNull()).select(F.explode(lists(F.col(vector).cast("array<float>"))).alias("list"))
        sizes = self.rows().groupBy("list").agg(F.count("*").alias("n"))
        got = q.groupBy("list").agg(F.count("*").alias("asked")).join(sizes, "list").agg(F.sum(F.col("asked") * F.col("n"))).collect()[0][0] or 0
        total, asked = self.rows().count(), queries.where(F.col(vector).isNotNull()).count()
        return got / (total * asked) if total and asked else 0.0


def build_index(vectors: DataFrame, lists: int | None = None, id_col: str = "vec_id", vector: str = "embedding", seed: int = 42) -> InvertedFile:
    """An index of all vectors. Centroids come from k-means by cosine on an even sample of at most about ``SAMPLE_PER_LIST`` vectors a list;
    ``lists`` is the square root of the number of vectors unless given, ``MOST_LISTS`` at most."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    known = vectors.where(F.col(vector).isNotNull())
    n = known.count()
    lists = max(1, min(lists or round(n**0.5), MOST_LISTS, max(n, 1)))
    share = min(1.0, SAMPLE_PER_LIST * lists / max(n, 1))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    sample = drawn.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features")).where(F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x * x) > 0)
    if sample.isEmpty():
        dim = len(known.select(vector).first()[0]) if n else 1
        centroids = np.zeros((1, dim))
    else:
        fitted = KMeans(k=lists, seed=seed, distanceMeasure="cosine", maxIter=15).fit(sample)
        centroids = unit(np.array(fitted.clusterCenters(), np.float64))
    return InvertedFile(centroids, [], [], spark).add(vectors, id_col, vector)


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """n_wanted, n_found, recall: of the exact search's pairs, how many the index found."""
    pairs = wanted.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return pairs.agg(F.count("*").alias("n_wanted"), F.count("hit").alias("n_found"), (F.count("hit") / F.count("*")).alias("recall"))


def probes_for(index: InvertedFile, vectors: DataFrame, k: int, least: float = 0.95, sample: int = 200, id_col: str = "vec_id", vector: str = "embedding", seed: int = 7) -> int:
    """The fewest probes, in doubling steps, whose recall on at most about ``sample`` vectors asked as queries is ``least`` or more."""
    n = vectors.count()
    drawn = written(vectors.where(F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 20)) < F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 20)))), "vector-sample")
    wanted = written(exact_top_k(drawn, vectors, k, id_col, vector), "vector-wanted")
    probes = 1
    while probes < len(index.centroids):
        got = recall(index.search(drawn, k, probes, id_col, vector), wanted).collect()[0]
        if not got["n_wanted"] or got["recall"] >= least:
            return probes
        probes *= 2
    return len(index.centroids)
