"""Exact nearest vectors and the inverted-file index against brute force."""

import numpy as np
import pytest
from palisade.operators import vectors as V
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def rows(n=600, dim=12, seed=2):
    """Clusters of uneven size; a third of all vectors are one vector; zeros, repeated rows and nulls."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim))
    out = [(i, (centers[i % 12 if i % 3 else 0] + (rng.normal(0, 0.35, dim) if i % 3 else 0)).astype("f4").tolist(), i % 4) for i in range(n)]
    return [*out, (n, [0.0] * dim, 0), (n + 20, None, 0), (None, out[4][1], 1), out[7], out[7]]


def brute(rows, asked, k):
    """(query, score) lists per query: ids may differ among ties of repeated rows, scores may not."""
    known = [(i, np.array(v, np.float64)) for i, v, _ in rows if v is not None]
    size = lambda v: np.sqrt((v * v).sum())
    out = {}
    for q, v in known:
        if q in asked:
            found = sorted(((round(float(v @ w) / (size(v) * size(w)) if size(v) * size(w) else 0.0, 6) + 0.0, j) for j, w in known if j is not None and j != q), key=lambda x: (-x[0], x[1]))
            out[q] = found[:k]
    return out


@pytest.fixture(scope="module")
def table(spark):
    data = [r for r in rows() if r[0] is not None]
    return spark.createDataFrame(data, SCHEMA).withColumn("list", F.lit("clash")).withColumn("place", F.lit(0)).repartition(4), data


def got(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.place, r.score, r.id))
    return {q: [(s, i) for _, s, i in sorted(x)] for q, x in out.items()}


@pytest.mark.parametrize("block", [4096, 7])
def test_exact(table, monkeypatch, block):
    df, data = table
    monkeypatch.setattr(V, "BLOCK", block)
    asked = {i for i, *_ in data if i % 20 == 0}
    want = brute(data, asked, 5)
    assert got(V.exact_top_k(df.where("vec_id % 20 = 0"), df, 5)) == want
    assert (V.exact_top_k(df.where("vec_id < 0"), df, 5)).collect() == [] and V.exact_top_k(df, df.where("vec_id < 0"), 5).collect() == []


def test_index_with_all_lists_is_exact_and_splits_hot_lists(table, monkeypatch):
    df, data = table
    monkeypatch.setattr(V, "PART_ROWS", 40)
    monkeypatch.setattr(V, "PART_QUERIES", 9)
    index = V.build_index(df, lists=10)
    stored = index.rows()
    sizes = stored.groupBy("list", "part").count().collect()
    assert stored.count() == sum(v is not None for _, v, _ in data) and max(r["part"] for r in sizes) >= 4
    assert max(r["count"] for r in sizes) < 90  # of 200 equal vectors
    queries = df.where("vec_id % 20 = 0")
    assert got(index.search(queries, 5, 99)) == brute(data, {i for i, *_ in data if i % 20 == 0}, 5)
    assert index.probed_share(queries, 99) == pytest.approx(1.0)


def test_recall_and_probed_share(table):
    df, data = table
    index = V.build_index(df)
    queries = df.where("vec_id % 20 = 0")
    probes = V.probes_for(index, df, 5)
    found = V.recall(index.search(queries, 5, probes), V.exact_top_k(queries, df, 5)).collect()[0]
    assert found.n_wanted >= 150 and found.recall >= 0.9 and index.probed_share(queries, probes) < 0.7
    assert 1 <= probes <= len(index.centroids)


def test_add_replace_and_remove(table, spark):
    df, data = table
    index = V.build_index(df, lists=6)
    new = spark.createDataFrame([(3, data[10][1], 0), (9001, data[10][1], 0)], SCHEMA)
    index = index.add(new).remove(spark.createDataFrame([(10,), (777777,)], "id bigint"))
    now = [r for r in data if r[0] not in (3, 10)] + [(3, data[10][1], 0), (9001, data[10][1], 0)]
    asked = spark.createDataFrame([(-1, data[10][1], 0)], SCHEMA)
    found = got(index.search(asked, 4, 99))[-1]
    want = brute([*now, (-1, data[10][1], 0)], {-1}, 4)[-1]
    assert found == want and {3, 9001} <= {i for _, i in found}
    again = index.add(spark.createDataFrame([(10, data[10][1], 0)], SCHEMA))  # comes back after its removal
    assert 10 in {i for _, i in got(again.search(asked, 4, 99))[-1]}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    index = V.build_index(empty)
    assert index.rows().count() == 0 and index.search(empty, 3, 2).collect() == [] and index.probed_share(empty, 2) == 0.0
