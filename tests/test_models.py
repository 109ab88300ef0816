"""The ranker, clusters and sampled drafts against plain versions; the paged source against a server that fails at first."""

import itertools
import json
import random
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
from palisade.operators import evaluate, profiles, simulate, training
from palisade.sources.rest import JsonPages
from pyspark.sql import functions as F


def test_ranker_minimises_the_weighted_loss(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)) * [1, 2, 0.5, 1, 3] + [0.5, 0, 0.2, -0.3, 0]
    w = rng.uniform(0.5, 4, 400)
    names = [f"f{i}" for i in range(5)]
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, w, strict=True)], [*names, "w"])
    got = evaluate.pairwise_ranker(df, names, "w", ridge=1e-2)
    theta = np.zeros(5)
    for _ in range(50):  # Newton on mean weighted log(1 + exp(-x theta)) + ridge / 2 |theta|^2
        p = 1 / (1 + np.exp(x @ theta))
        gradient = -(w * p) @ x / w.sum() + 1e-2 * theta
        hessian = (x.T * (w * p * (1 - p))) @ x / w.sum() + 1e-2 * np.eye(5)
        theta -= np.linalg.solve(hessian, gradient)
    assert np.allclose([got[n] for n in names], theta, atol=1e-4)


def test_better_from_counts_every_pair():
    rng = random.Random(2)
    for n in (1, 2, 3, 64, 100, 257):
        pick, quality = np.array(rng.sample(range(1000), n), float), np.array([rng.randrange(20) / 20 for _ in range(n)])
        slot, than = np.array([rng.randrange(1010) for _ in range(80)], float), np.array([rng.randrange(21) / 20 for _ in range(80)])
        want = [int(((pick >= s) & (quality > q)).sum()) for s, q in zip(slot, than, strict=True)]
        assert training.better_from(pick, quality, slot, than).tolist() == want


def test_clusters_find_planted_styles(spark):
    rng, rows = random.Random(4), []
    for k, (eur, top2) in enumerate(profiles.CENTROIDS.values()):
        rows += [(100 * k + i, eur + rng.gauss(0, 0.004), top2 + rng.gauss(0, 0.004)) for i in range(40)]
    df = spark.createDataFrame(rows, "gm bigint, eur_share double, top2 double")
    got = {r.gm: r.archetype for r in profiles.archetype_clusters(df, n=5, seeds=(1, 2, 3, 4)).collect()}
    names = list(profiles.CENTROIDS)
    assert np.mean([got[gm].split("_")[0] == names[gm // 100] for gm, *_ in rows]) > 0.75
    assert len({frozenset(g for g in got if got[g] == a) for a in set(got.values())}) == len(set(got.values()))


def test_sampled_drafts_follow_their_odds(spark):
    rows = [(i, i + 1, 1 - i * 0.02, i % 6, "C") for i in range(12)]
    pool = spark.createDataFrame(rows, "id bigint, rank int, base double, need int, position string")
    order = [1, 2, 3]
    n, t = 4000, 0.25
    drawn = Counter(r.id for r in simulate.sampled_drafts(pool, n, order, t).where("pick = 1").collect())
    value = np.array([r[2] + 0.15 * (r[3] == 1) for r in rows])
    best = np.sort(value)[::-1]
    odds = np.exp((value - best[0]) / (t * max(0.01, (1 - (best[0] - best[1])) ** 2)))
    odds /= odds.sum()
    assert all(abs(drawn[i] / n - odds[i]) < 5 * np.sqrt(odds[i] * (1 - odds[i]) / n) for i in range(12))
    cold = simulate.sampled_drafts(pool, 3, order, 1e-6).select("pick", "id").distinct()
    assert {tuple(r) for r in cold.collect()} == {(r.pick, r.id) for r in simulate.draft(pool, [], order).collect()}


def test_pages_are_fetched_again_after_a_failure(spark):
    tries = itertools.count()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.rsplit("=", 1)[1])
            if page == 1 and next(tries) < 2:
                self.send_response(503)
                self.end_headers()
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"data": {"rows": [{"id": page * 10 + i, "name": {"default": "x"} if i else "y"} for i in range(3)]}}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(JsonPages)
    url = f"http://127.0.0.1:{server.server_port}/r?page={{page}}"
    got = spark.read.format("json_pages").schema("id bigint, name string, gone int").options(url=url, pages=3, records="data.rows", wait=0.1).load()
    rows = {r.id: (r.name, r.gone) for r in got.withColumn("id", F.col("id")).collect()}
    server.shutdown()
    assert rows == {p * 10 + i: ('{"default": "x"}' if i else "y", None) for p in range(3) for i in range(3)}
