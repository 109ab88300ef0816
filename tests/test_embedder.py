"""The embedder against a dense SVD of the same matrix."""

import random

import numpy as np
import pytest
from palisade.operators import embedder as E
from palisade.operators import vectors

TOPICS = ["goal assist point scorer winger shot", "save net glove goalie shutout pad", "hit block defend penalty pair blue", "skate speed edge stride pace turn"]


def texts():
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(TOPICS[i % 4].split(), k=rng.randint(4, 14)))) for i in range(160)]
    return [*rows, (200, None), (201, ""), (202, "!!! ..."), (203, rows[0][1]), (203, rows[0][1]), (204, "Goal assist, POINT " * 2000), (205, "Ünïcode 中文 words"), (None, "save net")]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(texts(), "id bigint, text string").repartition(5)


def dense(rarity, buckets):
    rows = []
    for _, t in texts():
        at, w = E.features(t, buckets)
        v = np.zeros(buckets)
        v[at] = w * rarity[at]
        rows.append(v / (np.sqrt(v @ v) or 1))
    return np.array(rows)


def test_equals_a_dense_svd(df):
    buckets, rank = 256, 6
    model = E.fit(df, "text", rank=rank, buckets=buckets, passes=6)
    matrix = dense(model.rarity, buckets)
    seen = np.array([sum(b in E.features(t, buckets)[0] for _, t in texts()) for b in range(buckets)])
    assert np.allclose(model.rarity, np.where(seen > 0, np.log((1 + len(texts())) / (1 + seen)) + 1, 0))
    _, strength, v = np.linalg.svd(matrix)
    assert np.allclose(model.strength, strength[:rank], rtol=1e-3)
    assert np.allclose(np.abs((v[:3] * model.basis.T[:3]).sum(axis=1)), 1, atol=1e-3)
    assert np.allclose(model.basis.T @ model.basis, np.eye(rank), atol=1e-9)
    want = matrix @ v[:rank].T
    want /= np.maximum(np.sqrt((want * want).sum(axis=1, keepdims=True)), 1e-12)
    found = {r.id: np.array(r.embedding) for r in E.embed(df, model, "text").collect()}
    got = np.array([found[i] for i, _ in texts()])
    near, wanted = got[:160] @ got[:160].T, want[:160] @ want[:160].T  # the same neighbours, whatever the signs
    assert np.abs(near - wanted).max() < 0.02
    assert not got[160].any() and not got[161].any() and not got[162].any()


def test_neighbours_share_a_topic(df):
    model = E.fit(df, "text", rank=4, buckets=1 << 12)
    rows = E.embed(df.where("id < 160"), model, "text")
    best = vectors.exact_top_k(rows, rows, 3, "id", "embedding").collect()
    assert len(best) == 480 and np.mean([r.query_id % 4 == r.id % 4 for r in best]) > 0.95
    again = E.fit(df.repartition(2), "text", rank=4, buckets=1 << 12)
    assert np.allclose(again.basis, model.basis, atol=1e-6) and np.allclose(E.from_json(E.as_json(model)).basis, model.basis)


def test_no_texts(spark):
    empty = spark.createDataFrame([], "id bigint, text string")
    model = E.fit(empty, "text", rank=4, buckets=64)
    assert E.embed(empty, model, "text").collect() == [] and not model.embed(["word"]).any()
