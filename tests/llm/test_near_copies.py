"""The pipeline's near-duplicate stage against all pairs of texts."""

import random

import corpus_pipeline
import numpy as np
import pytest
from palisade.llm import near_copies


def _altered(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return out


def _rows():
    rng = random.Random(8)
    rows = [(None, ""), (1, ""), (2, " \n"), (3, "a b"), (4, "a  B"), (5, "a b c"), (None, "a b c d e f g")]
    for _ in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(120, 300))]
        rows += [(len(rows) + k, " ".join(x)) for k, x in enumerate([base, base, *(_altered(rng, base, n) for n in (1, 2, 3, 5, 8, 14))])]
    return rows


def _grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


@pytest.mark.parametrize("how", [{}, {"split": 4, "heavy": 600}])
def test_stage_links_by_jaccard(spark, tmp_path, how):
    rows = _rows()
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    grams, up = [_grams(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(grams):
        for j, b in enumerate(grams[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                up[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(doc_id)
    want = sorted((min((x for x in v if x is not None), default=None) for v in groups.values()), key=str)
    df = spark.read.parquet(path)
    kept = near_copies.drop_near_copies(df, **how) if how else corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        n, found = 1000, []
        for _ in range(30):
            x = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            both = round(2 * n * share / (1 + share))
            a, b = np.unique(x[:n]), np.unique(x[n - both : 2 * n - both])
            found.append((near_copies.signature(a, 138) == near_copies.signature(b, 138)).mean() - near_copies.jaccard(a, b))
        assert abs(np.mean(found)) < 0.03
