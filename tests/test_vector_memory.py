"""What the exact search holds in a task."""

import tracemalloc
import types

import numpy as np
import pyarrow as pa
from palisade.operators import vectors as V


def test_exact_search_holds_few_scores_at_once():
    rng = np.random.default_rng(8)
    q, m = rng.normal(size=(4096, 8)), np.r_[rng.normal(size=(1500, 8)), np.full((1, 8), np.nan)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(m))), pa.array(m.tolist())], names=["id", "v"])
    tracemalloc.start()
    found = list(V._scan([batch], types.SimpleNamespace(value=(np.arange(4096) * 20, q)), 5))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6
    scores = np.round(V.unit(q) @ V.unit(m).T, 6) + 0.0
    for i in range(0, 4096, 400):
        want = sorted((-s, j) for j, s in enumerate(scores[i]) if j != 20 * i and not np.isnan(s))[:5]
        assert sorted((-r["score"], r["id"]) for r in found.to_pylist() if r["query_id"] == 20 * i) == want


def test_equal_scores_across_a_tile_go_by_id():
    best = V.Best(np.array([3, 999]), 2)
    best.add(np.ones((2, 600)), np.arange(600)[::-1].copy())
    assert sorted(zip(best.q.tolist(), best.ids.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 0), (1, 1)]
